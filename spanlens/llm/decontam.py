"""Benchmark decontamination with an FM-index for each shard of documents.

A shard is a bounded run of documents.  Its words are told by 64-bit hashes, and
those that the benchmark has become the shard's own symbols; every other word
separates.  Runs shorter than the shortest phrase cannot hold one and are left
out.  Over the rest the shard builds, once, a suffix array with unique
separators, the Burrows-Wheeler transform, a wavelet matrix for ranks and a
sample of suffix positions.  The benchmark's phrases lie in blocks of bounded
size, which tasks write; a shard looks for one block after the other, searching
its phrases backwards in step, locates the occurrences through the sample, and
merges the spans for each document.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.storage import new_folder, open_store, publish
from spanlens.llm.textbytes import alnum_words, map_texts, utf8

WINDOW = 13
SHARD_WORDS = 2_000_000
#: Bytes of text of a block of items, about.
BLOCK_BYTES = 1 << 20
SAMPLE = 16


class WaveletMatrix:
    """Rank and access over small non-negative symbols, all queries in step."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            high = bit.astype(bool)
            self.zeros.append(int(len(now) - high.sum()))
            now = np.concatenate([now[~high], now[high]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol[i]`` stands before position ``upto[i]``."""
        lo, hi = np.zeros_like(upto), upto
        for k, ones in enumerate(self.ones):
            high = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo = np.where(high, self.zeros[k] + a, lo - a)
            hi = np.where(high, self.zeros[k] + b, hi - b)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        lo, hi = np.zeros_like(at), at
        for k, ones in enumerate(self.ones):
            high = ones[hi + 1] > ones[hi]
            a, b = ones[lo], ones[hi]
            lo = np.where(high, self.zeros[k] + a, lo - a)
            hi = np.where(high, self.zeros[k] + b, hi - b)
            symbol = symbol * 2 + high
        return symbol, hi - lo


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; each 0 is a separator of its own, ordered by place."""
    n = len(symbols)
    separator = symbols == 0
    rank = np.where(separator, np.cumsum(separator) - 1, symbols + int(separator.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Backward search and locating over symbols in which 0 separates."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        order = suffix_array(symbols)
        before = symbols[order - 1] if n else symbols  # the first symbol is a separator
        self.n = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.bwt = WaveletMatrix(before, size)
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, a phrase in each row of the table."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.first[c] + self.bwt.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in the given rows."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            k = self.sampled[at]
            here = self.sampled[at + 1] > k
            out[todo[here]] = self.positions[k[here]] + steps
            todo, at = todo[~here], at[~here]
            symbol, rank = self.bwt.access_rank(at)
            at = self.first[symbol] + rank
            steps += 1
        return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Phrases:
    """Distinct phrases of a block of items, by length, as hashes of words, and the items of each."""

    def __init__(self, tables: list[np.ndarray], owners: list[list[np.ndarray]], ids: list[str]):
        self.tables, self.owners, self.ids = tables, owners, ids

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int) -> Phrases:
        grams: dict[int, list[np.ndarray]] = {}
        whose: dict[int, list[np.ndarray]] = {}
        for k, (_, text) in enumerate(items):
            line = word_hashes(alnum_words(text))
            n = min(window, len(line))
            if n:
                held = np.lib.stride_tricks.sliding_window_view(line, n)
                grams.setdefault(n, []).append(held)
                whose.setdefault(n, []).append(np.full(len(held), k))
        tables, owners = [], []
        for n in sorted(grams):
            distinct, at = np.unique(np.concatenate(grams[n]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([at.reshape(-1), np.concatenate(whose[n])], 1), axis=0)
            tables.append(distinct)
            owners.append(np.split(pairs[:, 1], np.flatnonzero(np.diff(pairs[:, 0])) + 1))
        return cls(tables, owners, [i for i, _ in items])

    def words(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *[t.reshape(-1) for t in self.tables]]))

    def dump(self, out) -> None:
        data = {"ids": np.array(self.ids, dtype=str)}
        for k, (table, owner) in enumerate(zip(self.tables, self.owners)):
            data[f"table{k}"] = table
            data[f"owner{k}"] = np.concatenate(owner)
            data[f"count{k}"] = np.array([len(o) for o in owner])
        buffer = io.BytesIO()
        np.savez(buffer, **data)
        out.write(buffer.getvalue())

    @classmethod
    def load(cls, path: str) -> Phrases:
        data = np.load(io.BytesIO(_read(path)))
        lengths = range(sum(name.startswith("table") for name in data.files))
        owners = [np.split(data[f"owner{k}"], np.cumsum(data[f"count{k}"])[:-1]) for k in lengths]
        return cls([data[f"table{k}"] for k in lengths], owners, data["ids"].tolist())


def _read(path: str) -> bytes:
    store, inner = open_store(path)
    with store.open_input_stream(inner) as source:
        return source.read()


def _long_runs(codes: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all runs of at least ``least`` vocabulary words within a document, each
    after a separator, and the place of each symbol among the shard's words."""
    inside = codes != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[starts[starts < len(codes)]] |= inside[starts[starts < len(codes)]]
    first = np.flatnonzero(begin)
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    last = np.flatnonzero(end) + 1
    keep = last - first >= least
    first, size = first[keep], (last - first)[keep] + 1
    owner_at = np.cumsum(size) - size
    place = np.repeat(first - 1 - owner_at, size) + np.arange(int(size.sum()))
    symbols = np.zeros(len(place), np.int64)
    real = np.ones(len(place), bool)
    real[owner_at] = False
    symbols[real] = codes[place[real]]
    return symbols, place


class Shard:
    """An index over documents, in which blocks of phrases are looked for."""

    def __init__(self, docs: list[np.ndarray], vocabulary: np.ndarray, least: int):
        """``docs`` are hashes of words; ``vocabulary`` the sorted hashes of the benchmark's; ``least`` its shortest phrase."""
        hashes = np.concatenate([np.zeros(0, np.uint64), *docs])
        self.starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        #: the words of the benchmark that the shard has; a word's code is its place, from 1
        self.held = np.unique(hashes[known])
        codes = np.zeros(len(hashes), np.int64)
        codes[known] = np.searchsorted(self.held, hashes[known]) + 1
        symbols, self.place = _long_runs(codes, self.starts[:-1], least)
        self.index = FMIndex(symbols, len(self.held) + 1) if len(symbols) else None
        self.level = np.zeros(len(hashes) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in docs]

    def find(self, phrases: Phrases) -> None:
        """Note where phrases of a block occur, and in which documents their items."""
        if self.index is None:
            return
        for table, owner in zip(phrases.tables, phrases.owners):
            at = np.minimum(np.searchsorted(self.held, table), len(self.held) - 1)
            may = np.flatnonzero((self.held[at] == table).all(1))  # the others hold a word that the shard does not
            if not len(may):
                continue
            lo, hi = self.index.search(at[may] + 1)
            some = np.flatnonzero(hi > lo)
            count = (hi - lo)[some]
            rows = np.repeat(lo[some] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            begin = self.place[self.index.locate(rows)]
            np.add.at(self.level, begin, 1)
            np.add.at(self.level, begin + table.shape[1], -1)
            doc = np.searchsorted(self.starts, begin, side="right") - 1
            pairs = np.unique(np.stack([doc, np.repeat(may[some], count)], 1), axis=0)
            for d, p in pairs.tolist():
                self.items[d].update(phrases.ids[i] for i in owner[p].tolist())

    def spans(self) -> list[np.ndarray]:
        """For each document its merged hit spans, an n x 2 table."""
        starts = self.starts
        covered = np.cumsum(self.level)[:-1] > 0
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        inner = starts[:-1][starts[:-1] < len(covered)]
        edge[inner] |= covered[inner]
        begin = np.flatnonzero(edge)
        stop = covered.copy()
        stop[:-1] &= ~covered[1:] | edge[1:]
        finish = np.flatnonzero(stop) + 1
        doc = np.searchsorted(starts, begin, side="right") - 1
        out = [np.zeros((0, 2), np.int64)] * (len(starts) - 1)
        for d in np.unique(doc):
            own = doc == d
            out[d] = np.stack([begin[own], finish[own]], 1) - starts[d]
        return out


@dataclass(frozen=True)
class Blocks:
    """Files of phrases, the file of all their words' hashes, and the shortest phrase's words."""

    paths: list[str]
    vocabulary: str
    least: int


def phrase_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write the benchmark's phrases as block files of bounded size, a task for each block.

    Rows are dealt in turn, so an item id that many rows share is no hot block.
    """
    spark = benchmark.sparkSession
    folder = new_folder(spark, "phrases")
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[str, bytes]] = []
        held, part = 0, 0
        task = TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            phrases, path = Phrases.of(items, window), f"{folder}/block-{task}-{part}.npz"
            publish(path, phrases.dump)
            publish(path + ".words", lambda out: out.write(phrases.words().tobytes()))
            least = min((t.shape[1] for t in phrases.tables), default=window)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([least], pa.int32())], names=["path", "least"])

        for batch in batches:
            for item in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                items.append(item)
                held += len(item[1])
                if held >= block_bytes:
                    yield close()
                    items, held, part = [], 0, part + 1
        if items:
            yield close()

    blocks = max(1, math.ceil(size / block_bytes))
    made = sorted(map_texts(rows.repartition(blocks), run, "path string, least int").collect())
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(_read(r.path + ".words"), np.uint64) for r in made]]))
    publish(f"{folder}/words", lambda out: out.write(words.tobytes()))
    return Blocks([r.path for r in made], f"{folder}/words", min((r.least for r in made), default=window))


class Scanner:
    """Looks for the phrases of all blocks in texts; loads a block once for each shard."""

    def __init__(self, blocks: Blocks, shard_words: int = SHARD_WORDS):
        self.blocks, self.shard_words = blocks, shard_words
        self.vocabulary = np.frombuffer(_read(blocks.vocabulary), np.uint64)
        self.only = Phrases.load(blocks.paths[0]) if len(blocks.paths) == 1 else None

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """``(words, spans, items)`` of each text, shard by shard."""
        docs: list[np.ndarray] = []
        size = 0
        for text in texts:
            docs.append(word_hashes(alnum_words(text)))
            size += len(docs[-1])
            if size >= self.shard_words:
                yield from self._shard(docs)
                docs, size = [], 0
        if docs:
            yield from self._shard(docs)

    def _shard(self, docs: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        shard = Shard(docs, self.vocabulary, self.blocks.least)
        for path in self.blocks.paths:
            shard.find(self.only or Phrases.load(path))
        return zip(map(len, docs), shard.spans(), map(sorted, shard.items))


def hit_words(spans: np.ndarray) -> int:
    return int((spans[:, 1] - spans[:, 0]).sum())


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans, contaminated)``, a row for each row of ``docs``.

    ``spans`` are merged word ranges ``[start, stop)`` covered by a window of an
    item: ``window`` consecutive words, or the whole of a shorter item.
    Words are runs of letters, digits and non-ASCII after lower-casing A-Z.
    Null and empty texts have no words and are never contaminated; items without
    words match nothing; a null item id counts as the empty string; rows with
    the same item id are one item.  Repeated documents are judged each.
    """
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window)
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long>>, contaminated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(blocks)
        for batch in batches:
            rows = list(scanner.scan(utf8(batch.column(1))))
            n_words = [n for n, _, _ in rows]
            n_hit = [hit_words(s) for _, s, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([i for _, _, i in rows], pa.list_(pa.string())),
                    pa.array([[{"start": a, "stop": b} for a, b in s.tolist()] for _, s, _ in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array([is_contaminated(n, h) for n, h in zip(n_words, n_hit)], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"],
            )

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged and with all columns; no shuffle."""
    blocks = phrase_blocks(benchmark, window=window)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(blocks)
        for batch in batches:
            keep = [not is_contaminated(n, hit_words(s)) for n, s, _ in scanner.scan(utf8(batch.column(at)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, run, docs.schema)
