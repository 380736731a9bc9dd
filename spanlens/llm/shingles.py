"""Exact similarity of word shingles between groups of documents that SimHash left apart.

Minima of ``BANDS * ROWS`` hashes of a text's shingles make the keys of
``BANDS`` tables; documents of different groups that share a key may be similar.
The minima also estimate how similar two texts are, and pairs that share a key
and reach ``LEAST_ESTIMATE`` join into candidate groups.  Within these every pair
of different groups is settled by the Jaccard similarity of the two whole sets of
shingles, so only true pairs become links.  A pair at similarity 0.8 shares a key
with probability 0.9998 and reaches the estimate with 0.9999; at 0.9 neither
misses in a million.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.blocks import deal, gather, large_blocks, tasks
from spanlens.llm.components import connected_components
from spanlens.llm.rowmarks import FILE, ROW, Marks, Placed, write_marks
from spanlens.llm.storage import materialize, new_folder
from spanlens.llm.textbytes import map_texts, tidy, utf8

BANDS, ROWS = 24, 5
#: Least share of equal minima of a pair that is settled: four standard deviations below 0.8.
LEAST_ESTIMATE = 0.65
#: Most sketches, and most sets of shingles, of a part; a task settles two parts.
SKETCH_PART, SET_PART = 8192, 1000
_BLOCK = 256

SKETCH = "shingle_id long, keys array<long>, minima binary"


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 7)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_digest
    held = b"".join([digest(joined[a:b], 7) for a, b in zip(starts, stops[width - 1 :])])
    return np.unique(np.frombuffer(held, ">u8").astype(np.uint64))


@lru_cache(maxsize=1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    a, b = rng.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
    return a | np.uint64(1), b


def sketch(values: np.ndarray) -> tuple[int, list[int], bytes]:
    """Name of a set of shingles, its key in each table, and 16 bits of each minimum; an empty set has no keys."""
    if not len(values):
        return 0, [], b""
    a, b = _mixers()
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(values), 2048):
        least = np.minimum(least, ((values[None, at : at + 2048] ^ b) * a).min(axis=1))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) - 2**63 for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return xxhash.xxh64_intdigest(values.tobytes()) - 2**63, keys, least.astype("<u2").tobytes()


def _alike(minima: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(minima.to_pylist()), "<u2").reshape(len(minima), -1)


def estimated_pairs(minima: np.ndarray, group: np.ndarray, side: np.ndarray, mixed: bool, least: float = LEAST_ESTIMATE):
    """Pairs ``i < j`` of different groups (and sides, if mixed) whose minima agree often enough, block by block."""
    need = int(np.ceil(least * minima.shape[1]))
    for at in range(0, len(minima), _BLOCK):
        own = slice(at, at + _BLOCK)
        for to in range(at, len(minima), 4 * _BLOCK):
            rest = slice(to, to + 4 * _BLOCK)
            may = group[own, None] != group[None, rest]
            if mixed:
                may &= side[own, None] != side[None, rest]
            i, j = np.nonzero(may)
            i, j = i + at, j + to
            i, j = i[i < j], j[i < j]
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                near = (minima[a] == minima[b]).sum(1, dtype=np.int16) >= need
                yield from zip(a[near].tolist(), b[near].tolist())


class Groups:
    """Groups joined as links are found, so that what is joined need not be settled again."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while root in up:
            root = up[root]
        while x != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def similar_pairs(sets: list[np.ndarray], pairs, group: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of candidate ``pairs`` of places, those whose sets are similar; what they join counts as one group from there on."""
    joined, found = Groups(), []
    for i, j in pairs:
        small, large = sorted((len(sets[i]), len(sets[j])))
        if small < least * large or joined.find(int(group[i])) == joined.find(int(group[j])):
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if both >= least * (small + large - both):
            joined.join(int(group[i]), int(group[j]))
            found.append((i, j))
    return found


def _sets(rows: Placed, text_col: str, places: DataFrame, width: int) -> DataFrame:
    """``(__file, __row, shingles)`` of the rows at some places, read where they lie."""
    folder = new_folder(rows.spark, "candidates")
    write_marks(places.select(FILE, ROW, F.lit(1).alias("copies")), folder)

    def run(batches):
        marks = Marks(folder)
        for batch in batches:
            file, row = batch.column(1), batch.column(2)
            some = batch.filter(pa.array(marks.copies(file.to_numpy(), row.to_numpy()) > 0))
            held = [shingle_set(t.lower().split(), width).tobytes() for t in utf8(some.column(0))]
            yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(held, pa.binary())], names=[FILE, ROW, "shingles"])

    return map_texts(rows.select(text=F.col(text_col)), run, f"{FILE} long, {ROW} long, shingles binary")


def _candidates(nodes: DataFrame) -> DataFrame:
    """``(u, v)`` links between nodes that connect all pairs of different roots with a common key and a like sketch."""
    held = nodes.select("node", "root", F.explode("keys").alias("key"))
    mixed = held.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    met = materialize(held.join(mixed.select("key"), "key").select("key", "node"), "met")
    large = large_blocks(met, ["key"], SKETCH_PART)
    sketched = met.join(nodes.select("node", "root", "minima"), "node")
    dealt = gather(deal(sketched, ["key"], "node", large), ["key"], met.count(), 300)

    def run(batches):
        for table in tasks(batches, ["key"]):
            node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
            joined = Groups()
            pairs = estimated_pairs(_alike(table.column("minima")), root, side, table.column("mixed")[0].as_py())
            found = [(int(node[i]), int(node[j])) for i, j in pairs if joined.join(i, j)]
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(tidy(run), "u long, v long")


def similar_groups(rows: Placed, found: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """``(u, v)`` links between ``root`` groups that hold a pair of similar documents.

    ``found`` has a row for each row of ``rows``: ``root``, its place, and its sketch.
    """
    alike = found.where(F.size("keys") > 0).groupBy("shingle_id", "root")
    nodes = alike.agg(F.min(F.struct(FILE, ROW)).alias("at"), F.first("keys").alias("keys"), F.first("minima").alias("minima"))
    name = F.xxhash64("shingle_id", "root").alias("node")
    nodes = materialize(nodes.select(name, "root", f"at.{FILE}", f"at.{ROW}", "keys", "minima"), "sketches")
    members = materialize(nodes.drop("keys").join(connected_components(_candidates(nodes)), "node"), "members")
    n = members.count()
    sets = _sets(rows, text_col, members, width)
    large = large_blocks(members, ["component"], SET_PART)
    dealt = deal(sets.join(members, [FILE, ROW]).drop(FILE, ROW), ["component"], "node", large)

    def run(batches):
        for table in tasks(batches, ["component"]):
            root, side = table.column("root").to_numpy(), table.column("side").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            pairs = estimated_pairs(_alike(table.column("minima")), root, side, table.column("mixed")[0].as_py())
            links = np.array(similar_pairs(sets, pairs, root, least), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(root[links[:, 0]]), pa.array(root[links[:, 1]])], names=["u", "v"])

    return gather(dealt, ["component"], n, 4000).mapInArrow(tidy(run), "u long, v long")
