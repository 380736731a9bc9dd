"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins and owns a lookup table of one number
for each bin; a few pairs of features own a table over both their bins.  Training
boosts shallow trees on one feature at a time, in turn, and adds every tree to
the table, so the model stays a sum of tables.  Scoring adds up the looked-up
numbers of a whole batch at once and applies the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.textbytes import map_texts, utf8

#: Most labelled rows that training takes, by smallest hash of the id.
MOST_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "symbols", "upper", "digits", "stops", "exclaim", "pipes", "non_ascii", "spaces", "word_length", "short_words",
    "log_words", "distinct_words", "log_line_words", "distinct_lines", "words_per_stop", "long_words",
)


def _mask(text: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(text.encode())] = 1
    return out


_SYMBOL, _STOP = _mask("#$%&*@^~=+<>{}[]\\/_`|"), _mask(".,;:?")
_CLASSES = np.stack(
    [
        _SYMBOL,
        _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _mask("abcdefghijklmnopqrstuvwxyz"),
        _mask("0123456789"),
        _STOP,
        _mask("!"),
        _mask("|"),
        np.arange(256) >= 128,
        _mask(" \t\r\x0b\x0c"),
        _mask(".?!"),
    ]
).T


def features(texts: list[bytes]) -> np.ndarray:
    """A row of ``FEATURES`` for each whole text; all are finite, also for empty texts."""
    hist = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 6))
    for k, text in enumerate(texts):
        if not text:
            continue
        hist[k] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lines = [x for x in text.split(b"\n") if x]
        rest[k] = len(words), len(set(words)), (lengths <= 3).sum(), (lengths >= 12).sum(), len(lines), len(set(lines))
    size = np.maximum(hist.sum(1), 1)
    symbol, upper, lower, digit, stop, exclaim, pipe, high, blank, ends = (hist @ _CLASSES).T
    words, distinct, short, long, lines, distinct_lines = rest.T
    n = np.maximum(words, 1)
    inked = np.maximum(size - blank - hist[:, 10], 1)
    return np.stack(
        [
            symbol / inked,
            upper / np.maximum(upper + lower, 1),
            digit / inked,
            stop / n,
            exclaim / n,
            pipe / n,
            high / inked,
            blank / size,
            inked / n,
            short / n,
            np.log1p(words),
            distinct / n,
            np.log1p(words / np.maximum(lines, 1)),
            distinct_lines / np.maximum(lines, 1),
            np.log1p(words / (ends + 1)),
            long / n,
        ],
        1,
    )


@dataclass
class Additive:
    """Bin edges and a table for each feature, and tables for pairs of features."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(column) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray, damp: float) -> np.ndarray:
    return g * g / (h + damp)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, damp: float) -> np.ndarray:
    """Leaf values by bin of a shallow tree on one feature's sums of gradients and curvatures."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        all_g, all_h = g.sum(), h.sum()
        gain = _gain(left_g, left_h, damp) + _gain(all_g - left_g, all_h - left_h, damp)
        cut = int(np.argmax(gain))
        if gain[cut] > _gain(all_g, all_h, damp) + 1e-12:
            return np.concatenate([_tree(g[: cut + 1], h[: cut + 1], depth - 1, damp), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1, damp)])
    return np.full(len(g), g.sum() / (h.sum() + damp))


def _quadrants(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, np.ndarray]:
    """The best cut of a pair's bins into four quadrants: its gain and the leaf values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    if g.shape[0] < 2 or g.shape[1] < 2:
        return 0.0, np.zeros_like(g)
    a, b = (c[:-1, :-1] for c in (cg, ch))
    top_g, top_h = cg[:-1, -1:], ch[:-1, -1:]
    side_g, side_h = cg[-1:, :-1], ch[-1:, :-1]
    parts = [(a, b), (top_g - a, top_h - b), (side_g - a, side_h - b), (total_g - top_g - side_g + a, total_h - top_h - side_h + b)]
    gain = sum(_gain(x, y, damp) for x, y in parts)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    leaf = [float(x[i, j] / (y[i, j] + damp)) for x, y in parts]
    values = np.empty_like(g)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j] - _gain(total_g, total_h, damp)), values


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 12, rounds: int = 250, pair_rounds: int = 80, n_pairs: int = 6, rate: float = 0.08, depth: int = 2, damp: float = 2.0
) -> Additive:
    """Train on rows ``x`` with labels ``y`` from 0 to 1.

    Without rows the model is the constant 0.5; with one class it is that
    class's damped share.
    """
    mean = float((y.sum() + 1) / (len(y) + 2))
    intercept = float(np.log(mean / (1 - mean)))
    width = x.shape[1]
    edges = [_edges(x[:, j], bins) for j in range(width)]
    coarse = [_edges(x[:, j], coarse_bins) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Additive(edges, coarse, tables, [], [], intercept)
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    total = np.full(len(y), intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):  # each feature in turn
            g, h = slope()
            n = len(tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), depth, damp)
            tables[j] += step
            total += step[at[j]]

    cell = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    wide = [len(c) + 1 for c in coarse]

    def sums(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(cell[i] * wide[j] + cell[j], values, wide[i] * wide[j]).reshape(wide[i], wide[j])

    g, h = slope()
    ranked = sorted(((_quadrants(sums(i, j, g), sums(i, j, h), damp)[0], i, j) for i in range(width) for j in range(i + 1, width)), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(i, j) for gain, i, j in ranked[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slope()
            step = rate * _quadrants(sums(i, j, g), sums(i, j, h), damp)[1]
            model.pair_tables[k] += step
            total += step[cell[i], cell[j]]
    return model


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Additive:
    """Fit on labelled rows that are not held out, at most ``most_rows`` of them by hash.

    Ids with several labels count with their mean; null labels and ids count
    nothing.  The driver receives features only, ``most_rows`` rows at most.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label_col).cast("double").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("k"))).groupBy("k").agg(F.avg("y").alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(most_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text")).join(F.broadcast(known), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "y", "x"])

    measured = map_texts(rows.select("k", "text", "y"), run, "k long, y double, x array<double>")
    table = measured.orderBy(F.xxhash64("k"), "k", "x").limit(most_rows).toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, table.column("y").to_numpy())


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``.

    Only the whole text is an input of the score; a null text is an empty one,
    and empty texts get the score of their features like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(utf8(batch.column(1)))))], names=["doc_id", "score"])

    rows = map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Additive, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with at least the threshold's score, unchanged; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(utf8(batch.column(at)))) >= threshold))

    return map_texts(docs, run, docs.schema)
