"""Cross-entropy difference of two word n-gram models that share one vocabulary.

The vocabulary is every word of the corpus, and with it every pair of words in a
row: what is counted grows with the corpus.  For each order, 1 and 2, the target
model counts the n-grams of the target's rows and the background model those of
all rows, scaled to the target's size, so that the two are matched; both add
``DELTA`` to every count.  With the same size and vocabulary, the loss of an
n-gram under the target model less that under the background model is ::

    log((scale * background + DELTA) / (target + DELTA))

where a document's own counts are left out of both, so that no document is
scored by a model that has seen it.  A document's score is the mean over its
words and both orders: the lower, the more it reads like the target.

Counting and scoring are one exchange.  A task deals the pairs (n-gram, document)
of a chunk of documents by hash of the n-gram, packed; the task that gets a range
of hashes adds up the counts of all chunks and sends each chunk one sum for each
of its documents.  An n-gram of many documents of a chunk stays there: the chunk
sends its counts and gets the totals, so that not even the most frequent word
makes a hot task.  No table of the model is ever in one place.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.blocks import PARTITION_BYTES
from spanlens.llm.rowmarks import FILE, ROW, Marks, Placed, write_marks
from spanlens.llm.storage import new_folder
from spanlens.llm.textbytes import alnum_words, map_texts, tidy, utf8

ORDERS = 2
DELTA = 0.5
_BITS = 48
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Sizes:
    """Words and documents of a chunk, and n-grams of a range of hashes, about.

    An n-gram of ``heavy`` documents of a chunk is counted there and not dealt by document.
    """

    words: int = 1 << 20
    docs: int = 1 << 16
    grams: int = 2 << 20
    heavy: int = 16


def gram_codes(words: list[bytes]) -> np.ndarray:
    """48-bit hashes of a text's words, and of each word with the one before it (the first has a start mark)."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    before = np.concatenate([np.zeros(1, np.uint64), own[:-1]])
    both = (before ^ before >> np.uint64(31)) * _ODD[0] + own
    mixed = np.concatenate([own * _ODD[0] + np.uint64(1), both])
    mixed = (mixed ^ mixed >> np.uint64(29)) * _ODD[1]
    return (mixed ^ mixed >> np.uint64(32)) >> np.uint64(64 - _BITS)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: how many, then each one's type and length, then what they hold."""
    head = b"".join(struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)) for a in arrays)
    return b"".join([bytes([len(arrays)]), head, *[a.tobytes() for a in arrays]])


def unpack(data: bytes) -> list[np.ndarray]:
    heads = [struct.unpack_from("<cBQ", data, 1 + 10 * k) for k in range(data[0])]
    at, out = 1 + 10 * len(heads), []
    for kind, width, n in heads:
        out.append(np.frombuffer(data, f"<{kind.decode()}{width}", n, at))
        at += width * n
    return out


def _halves(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high bits of sorted hashes; the high ones hardly change and compress to little."""
    return (grams & np.uint64(0xFFFFFFFF)).astype("<u4"), (grams >> np.uint64(32)).astype("<u2")


class _Chunk:
    """Documents of one task until they are dealt."""

    def __init__(self, sizes: Sizes):
        self.sizes = sizes
        self.keys: list[np.ndarray] = []
        self.docs: list[tuple[int, bool, int, bool]] = []  # id, whether it is null, words, whether of the target
        self.words = 0

    def add(self, doc_id: int | None, words: list[bytes], target: bool) -> None:
        self.keys.append(gram_codes(words) << np.uint64(16) | np.uint64(len(self.docs)))
        self.docs.append((doc_id or 0, doc_id is None, len(words), target))
        self.words += len(words)

    def full(self) -> bool:
        return self.words >= self.sizes.words or len(self.docs) >= self.sizes.docs

    def rows(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        """``(range, data)``: what each range of hashes gets, and (as range -1) what stays with the chunk."""
        ids, missing, n_words, target = (np.array(v) for v in zip(*self.docs))
        key, n = np.unique(np.concatenate(self.keys), return_counts=True)
        gram, doc = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype("<u2")
        cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]])) if len(gram) else np.zeros(1, np.int64)
        many = np.diff(cut) >= self.sizes.heavy
        heavy = np.repeat(many, np.diff(cut))
        place = np.repeat(np.cumsum(many) - 1, np.diff(cut))[heavy].astype("<u4")
        held_doc, held_n = doc[heavy], n[heavy]
        held = gram[cut[:-1]][many]
        all_n = np.bincount(place, held_n, len(held)).astype("<i8")
        target_n = np.bincount(place, held_n * target[held_doc], len(held)).astype("<i8")
        yield -1, pack(ids.astype("<i8"), missing.astype("<u1"), n_words.astype("<i8"), target.astype("<u1"), place, held_doc, held_n.astype("<u4"))
        light = ~heavy
        gram, doc, n = gram[light], doc[light], n[light]
        said = (2 * n + target[doc]).astype("<u4")
        edges = (np.arange(ranges + 1, dtype=object) << _BITS) // ranges
        edges = np.array([min(e, 2**63 - 1) for e in edges], np.uint64)
        at, held_at = np.searchsorted(gram, edges), np.searchsorted(held, edges)
        for k in range(ranges):
            lo, hi, a, b = at[k], at[k + 1], held_at[k], held_at[k + 1]
            if hi > lo or b > a:
                yield k, pack(*_halves(gram[lo:hi]), doc[lo:hi], said[lo:hi], *_halves(held[a:b]), target_n[a:b], all_n[a:b])


def _dealt(folder: str, ranges: int, sizes: Sizes):
    """Rows ``(doc_id, text, file, row)`` to ``(range, chunk, data)``; target rows are those with a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, task, number = Marks(folder), TaskContext.get().partitionId(), 0

        def close(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
            for k, data in chunk.rows(ranges):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task << 32 | number]), pa.array([data], pa.binary())], names=["range", "chunk", "data"])

        chunk = _Chunk(sizes)
        for batch in batches:
            target = marks.copies(batch.column(2).to_numpy(), batch.column(3).to_numpy()) > 0
            for doc_id, text, flag in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), target.tolist()):
                chunk.add(doc_id, alnum_words(text), flag)
                if chunk.full():
                    yield from close(chunk)
                    chunk, number = _Chunk(sizes), number + 1
        if chunk.docs:
            yield from close(chunk)

    return run


def _losses(target: np.ndarray, background: np.ndarray, own_target: np.ndarray, own: np.ndarray, scale: float) -> np.ndarray:
    """Loss differences of n-grams that a document holds ``own`` times, its own counts left out."""
    return np.log((scale * (background - own) + DELTA) / (target - own_target + DELTA))


def _groups(batches: Iterator[pa.RecordBatch], key: Callable[[tuple], object]) -> Iterator[list[tuple]]:
    """Rows of a sorted partition in runs of equal keys."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and key(row) != key(held[0]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _counted(scale: float):
    """Rows ``(range, chunk, data)`` by range to ``(range, chunk, data)``: sums by document, and totals of heavy n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, lambda r: r[:2] if r[0] < 0 else r[0]):
            found = [rows[0][2]] if rows[0][0] < 0 else _range_sums([unpack(r[2]) for r in rows], scale)
            for (k, chunk, _), data in zip(rows, found):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk]), pa.array([data], pa.binary())], names=["range", "chunk", "data"])

    return run


def _range_sums(parts: list[list[np.ndarray]], scale: float) -> list[bytes]:
    gram = np.concatenate([p[k].astype(np.uint64) | p[k + 1].astype(np.uint64) << np.uint64(32) for p in parts for k in (0, 4)])
    _, at = np.unique(gram, return_inverse=True)
    del gram
    target = np.bincount(at, np.concatenate([x for p in parts for x in ((p[3] >> 1) * (p[3] & 1), p[6])]))
    background = np.bincount(at, np.concatenate([x for p in parts for x in (p[3] >> 1, p[7])]))
    out, here = [], 0
    for p in parts:
        light, heavy = np.split(at[here : here + len(p[0]) + len(p[4])], [len(p[0])])
        here += len(p[0]) + len(p[4])
        n, flag = (p[3] >> 1).astype(float), p[3] & 1
        loss = n * _losses(target[light], background[light], n * flag, n, scale)
        docs = np.unique(p[2])
        sums = np.bincount(p[2], loss, int(docs[-1]) + 1 if len(docs) else 0)[docs]
        out.append(pack(docs, sums, target[heavy], background[heavy]))
    return out


def _scored(scale: float):
    """Rows ``(range, chunk, data)`` by chunk, in order of range, to a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, lambda r: r[1]):
            ids, missing, n_words, is_target, place, doc, n = unpack(rows[0][2])
            total = np.zeros(len(ids))
            target, background = [np.zeros(0)], [np.zeros(0)]
            for _, _, data in rows[1:]:
                docs, sums, t, b = unpack(data)
                total[docs] += sums
                target.append(t)
                background.append(b)
            target, background = np.concatenate(target), np.concatenate(background)
            n = n.astype(float)
            total += np.bincount(doc, n * _losses(target[place], background[place], n * is_target[doc], n, scale), len(ids))
            score = total / np.maximum(ORDERS * n_words, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(n_words), pa.array(score)], names=["doc_id", "n_tokens", "difference"])

    return run


def _word_counts(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(folder)
        for batch in batches:
            target = marks.copies(batch.column(1).to_numpy(), batch.column(2).to_numpy()) > 0
            n = np.array([len(alnum_words(t)) for t in utf8(batch.column(0))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(n[target].sum())]), pa.array([int(n.sum())])], names=["target", "background"])

    return run


def cross_entropy_difference(docs: Placed, target_rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """``(doc_id, n_tokens, difference)``, a row for each row of ``docs``; ``target_rows`` are places of the target's rows.

    Losses are in nats; ``difference`` is the mean over the words of the whole text and both orders of target
    loss less background loss.  A null text is an empty one; a text without words scores 0.  Repeated rows
    count each and score alike; null ids are kept.  Without target words every score is 0.
    """
    folder = new_folder(docs.spark, "target")
    write_marks(target_rows.select(FILE, ROW, F.lit(1).alias("copies")), folder)
    counted = map_texts(docs.select(text=F.col(text_col)), _word_counts(folder), "target long, background long")
    target, background = (n or 0 for n in counted.agg(F.sum("target"), F.sum("background")).first())
    scale = target / max(background, 1)
    ranges = max(1, math.ceil(ORDERS * background / sizes.grams))
    schema = "range int, chunk long, data binary"
    rows = docs.select(doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    parts = max(int(docs.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(ORDERS * background * 8 / PARTITION_BYTES))
    # what stays with a chunk goes by the chunk, all else by the range
    dealt = map_texts(rows, _dealt(folder, ranges, sizes), schema)
    by_range = dealt.repartition(parts, "range", F.when(F.col("range") < 0, F.col("chunk"))).sortWithinPartitions("range", "chunk")
    sums = by_range.mapInArrow(tidy(_counted(scale)), schema)
    by_chunk = sums.repartition(parts, "chunk").sortWithinPartitions("chunk", "range")
    return by_chunk.mapInArrow(tidy(_scored(scale)), "doc_id long, n_tokens long, difference double")


def score_against_labelled(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """Scores with the rows labelled 1 as target and all rows as background.

    A document counts as target if any of its labels is 1; null labels and ids count nothing.
    """
    good = labels.where((F.col(label_col) == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("target_id")).distinct()
    rows = Placed(docs)
    target = rows.select(id=F.col(id_col).cast("long")).join(good, F.col("id") == F.col("target_id"))
    return cross_entropy_difference(rows, target, id_col, text_col, sizes)
