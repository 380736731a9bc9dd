"""SimHash near-duplicate detection by a self-join of binary tries.

Every distinct fingerprint is a leaf of a binary trie whose level *d* is bit
*d* from the top.  The join walks pairs of nodes together from the root: a pair
holds the number of bits in which the two prefixes differ, its four pairs of
children add 0 or 1, and a pair over the error budget is dropped with all
leaves below it.  Pairs of small nodes are settled by counting bits.

The work is dealt out by turned tries.  With a budget of *k* bits, the 64 bits
fall into *k* + 1 segments, and two fingerprints within the budget agree in one
of them at least.  Each fingerprint goes once to each of the *k* + 1 tries that
begin with a segment, to the subtree of its first bits there; a task joins one
subtree with itself.  So what is shuffled is *k* + 1 times the fingerprints at
any size of the corpus.  A subtree that is too large for a task is cut into
parts, a task for each pair.  A task returns a spanning forest of the links it
found, never all of them, and skips pairs of nodes that are already connected
as a whole, so a dense group costs little more than its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.blocks import deal, gather, large_blocks, tasks
from spanlens.llm.components import connected_components
from spanlens.llm.rowmarks import FILE, ROW, Placed
from spanlens.llm.shingles import SKETCH, shingle_set, similar_groups, sketch
from spanlens.llm.storage import materialize
from spanlens.llm.textbytes import blank_words, map_texts, tidy, utf8

_LEAF_PRODUCT = 64
_CHUNK = 1 << 19
#: Fingerprints of a subtree, about, and of a part of one that is too large for a task.
SUBTREE, PART = 4096, 1 << 16


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without words."""
    return _fingerprint(blank_words((text or "").encode("utf-8", "surrogatepass")), width, seed)


def _fingerprint(words: list[bytes], width: int, seed: int) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, stops[width - 1 :])])
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(table), 60_000):
        counts += np.add.reduce(np.unpackbits(table[at : at + 60_000], axis=1), axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * counts > len(table)).tobytes(), "big")


def fingerprints(rows: DataFrame, width: int = 4, sketched: int | None = None) -> DataFrame:
    """``(doc_id, text, ..long columns)`` to ``(doc_id, fp, ..)``, a row for each row; ``fp`` holds the 64 bits.

    With ``sketched``, a width in words, also the sketch of the text's set of shingles of that width.
    """
    carried = rows.columns[2:]
    names = ["doc_id", "fp", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sketches = np.zeros(batch.num_rows, np.uint64), []
            for k, text in enumerate(utf8(batch.column(1))):
                words = blank_words(text)
                found[k] = _fingerprint(words, width, 42)
                if sketched:
                    sketches.append(sketch(shingle_set(words, sketched)))
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            if sketched:
                ids, keys, minima = zip(*sketches) if sketches else ((), (), ())
                columns += [pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(["shingle_id", "keys", "minima"] if sketched else [])])

    schema = ", ".join(f"{c} long" for c in names)
    return map_texts(rows, run, f"{schema}, {SKETCH}" if sketched else schema)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of ``a[i]`` and ``b[i]`` for every i."""
    parent = np.arange(len(labels))
    la, lb = labels[a], labels[b]
    while True:
        la, lb = parent[la], parent[lb]
        apart = la != lb
        if not apart.any():
            return parent[labels]
        la, lb = la[apart], lb[apart]
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


class TrieJoin:
    """Links between two sorted arrays of distinct fingerprints, or within one."""

    def __init__(self, left: np.ndarray, right: np.ndarray | None, budget: int):
        self.own = right is None
        self.left = left
        self.right = left if right is None else right
        self.base = 0 if self.own else len(left)
        self.all = left if self.own else np.concatenate([left, right])
        self.budget = budget
        self.labels = np.arange(len(self.all))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.left) and len(self.right):
            self._neighbours()
            one = np.zeros(1, np.int64)
            stack = [(0, one, one + len(self.left), one, one + len(self.right), one)]
            while stack:
                stack.extend(self._step(*stack.pop()))
        if not self.edges:
            return self.all[:0], self.all[:0]
        a, b = (np.concatenate(x) for x in zip(*self.edges))
        return self.all[a], self.all[b]

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Record links between positions of ``all`` as far as they connect something new."""
        la, lb = self.labels[a], self.labels[b]
        new = la != lb
        if not new.any():
            return
        a, b, la, lb = a[new], b[new], la[new], lb[new]
        key = np.minimum(la, lb) * len(self.labels) + np.maximum(la, lb)
        first = np.unique(key, return_index=True)[1]
        a, b = a[first], b[first]
        self.edges.append((a, b))
        self.labels = _merge(self.labels, a, b)
        change = np.ones(len(self.labels), np.int64)
        change[1:] = self.labels[1:] != self.labels[:-1]
        self.runs = np.cumsum(change)

    def _neighbours(self) -> None:
        """Links between neighbours in sorted order of some rotations: most of a dense group."""
        self.runs = np.arange(len(self.all))
        for turn in range(0, 64, 8):
            turned = self.all if turn == 0 else (self.all << np.uint64(turn)) | (self.all >> np.uint64(64 - turn))
            order = np.argsort(turned, kind="stable")
            a, b = order[:-1], order[1:]
            near = np.bitwise_count(self.all[a] ^ self.all[b]) <= self.budget
            self._link(a[near], b[near])

    def _split(self, keys: np.ndarray, lo: np.ndarray, bit: int) -> np.ndarray:
        """Where the half with the given bit set begins, for nodes that begin at ``lo``."""
        mark = np.uint64(1 << bit)
        return np.searchsorted(keys, (keys[lo] & ~np.uint64((1 << bit) - 1)) | mark)

    def _step(self, depth, alo, ahi, blo, bhi, diff):
        la, lb = self.labels, self.base
        same = (self.runs[alo] == self.runs[ahi - 1]) & (self.runs[blo + lb] == self.runs[bhi - 1 + lb])
        go = ~(same & (la[alo] == la[blo + lb]))
        if not go.all():
            alo, ahi, blo, bhi, diff = (x[go] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            return
        small = ((ahi - alo) * (bhi - blo) <= _LEAF_PRODUCT) | (depth >= 64)
        if small.any():
            self._leaves(*(x[small] for x in (alo, ahi, blo, bhi)))
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            return
        bit = 63 - depth
        amid = np.clip(self._split(self.left, alo, bit), alo, ahi)
        bmid = np.clip(self._split(self.right, blo, bit), blo, bhi)
        parts = []
        for x, (xl, xh) in enumerate(((alo, amid), (amid, ahi))):
            for y, (yl, yh) in enumerate(((blo, bmid), (bmid, bhi))):
                d = diff + (x != y)
                live = (xh > xl) & (yh > yl) & (d <= self.budget)
                if self.own:  # one order of each pair of different nodes
                    live &= xl <= yl
                parts.append(tuple(v[live] for v in (xl, xh, yl, yh, d)))
        merged = [np.concatenate(v) for v in zip(*parts)]
        for at in range(0, len(merged[0]), _CHUNK):
            yield (depth + 1, *(v[at : at + _CHUNK] for v in merged))

    def _leaves(self, alo, ahi, blo, bhi) -> None:
        """Settle pairs of small nodes by counting the bits of all their pairs of leaves."""
        wide = bhi - blo
        for at, to in _runs((ahi - alo) * wide, 1 << 21):
            w = wide[at:to]
            size = (ahi[at:to] - alo[at:to]) * w
            owner = np.repeat(np.arange(to - at), size)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            step = w[owner]
            a = alo[at:to][owner] + k // step
            b = blo[at:to][owner] + k % step
            near = np.bitwise_count(self.left[a] ^ self.right[b]) <= self.budget
            a, b = a[near], b[near] + self.base
            self._link(a, b)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of an array into runs whose sizes sum to about ``most``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield at, to
        at = to


def _turned(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def links(classes: DataFrame, budget: int = 4) -> DataFrame:
    """Distinct ``fp`` values to ``(u, v)`` links that connect all within ``budget`` bits.

    The links span every component of the graph of all pairs at ``budget`` or
    fewer differing bits.  Only the number of fingerprints reaches the driver.
    """
    n = classes.count()
    tables = budget + 1
    bits = min(64 // tables, max(0, math.ceil(math.log2(max(1, n / SUBTREE)))))
    starts = [64 * t // tables for t in range(tables)] if bits else [0]
    keyed = [F.struct(F.lit(t).alias("tab"), _turned(F.col("fp"), s).alias("key")) for t, s in enumerate(starts)]
    spread = classes.select(F.explode(F.array(*keyed)).alias("k")).select("k.tab", "k.key")
    spread = spread.select("tab", (F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)).alias("block"), "key")
    large = large_blocks(spread, ["tab", "block"], PART) if n > PART else None
    dealt = gather(deal(spread, ["tab", "block"], "key", large), ["tab", "block"], n * len(starts), 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tasks(batches, ["tab", "block"]):
            key, side = table.column("key").to_numpy().view(np.uint64), table.column("side").to_numpy()
            left, right = (np.sort(key[side == 0]), np.sort(key[side == 1])) if table.column("mixed")[0].as_py() else (np.sort(key), None)
            by = np.uint64(starts[table.column("tab")[0].as_py()])
            u, v = (x >> by | x << np.uint64(64) - by if by else x for x in TrieJoin(left, right, budget).run())
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(tidy(run), "u long, v long")


def _grouped(prints: DataFrame, budget: int) -> DataFrame:
    """Rows of ``prints`` with ``root``, which names the group, and ``component_id``."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(links(classes.select("fp"), budget))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = rooted.join(least, "root").select(F.col("fp").alias("class_fp"), "root", "component_id")
    by_class = materialize(by_class, "groups")
    return prints.join(by_class, prints.fp == by_class.class_fp).drop("class_fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    Rows whose fingerprints differ in ``budget`` or fewer bits are linked;
    ``component_id`` is the smallest id reachable.  Null and empty texts, and
    texts of white space, have fingerprint zero and are linked like any other.
    Shorter texts than a shingle are one shingle.  Repeated rows stay repeated.
    Rows with a null id are kept; a group of such rows alone has a null
    component.  Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = _grouped(materialize(fingerprints(rows, width), "fingerprints"), budget)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, similar: tuple[int, float] | None = None
) -> DataFrame:
    """One row of every group of near-duplicates, with all columns unchanged; texts are not shuffled.

    The row with the smallest id stays, of rows that repeat it the first by
    place; a row with a null id stays only where its group has no other.  With
    ``similar``, a width in words and a least Jaccard similarity, groups that hold
    a pair of texts with so similar sets of shingles are one group too.
    """
    rows = Placed(docs)
    named = rows.select(doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    prints = materialize(fingerprints(named, width, similar and similar[0]), "fingerprints")
    found = _grouped(prints, budget)
    if similar:
        found = _joined(rows, found, text_col, *similar)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)).alias("first")
    kept = found.groupBy("root").agg(first).select(f"first.{FILE}", f"first.{ROW}", F.lit(1).alias("copies"))
    return rows.take(kept)


def _joined(rows: Placed, found: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """``found`` with one ``root`` for groups that hold a pair of similar texts."""
    found = materialize(found.drop("fp", "component_id"), "rooted")
    joined = connected_components(similar_groups(rows, found, text_col, width, least)).withColumnRenamed("node", "old")
    both = found.join(joined, found.root == joined.old, "left")
    return both.select("doc_id", F.coalesce("component", "root").alias("root"), FILE, ROW)
