"""Near-duplicate vectors by cross-polytope hashing.

A hash turns a vector by a pseudo-random rotation (three rounds of random signs
and a fast Hadamard transform) and takes the nearest signed axis.  A bucket of a
table is the pair of two such hashes.  Each vector lies in its own bucket of
each table and also probes the buckets that it misses by least.  Pairs that
meet are verified by cosine in double precision; one that meets several times
counts where it meets first.  Equal vectors are one class with a multiplicity, so
copies never form pairs; a bucket beyond ``PART`` rows is cut into parts, and
each pair of parts is a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.components import connected_components
from spanlens.llm.simhash import _merge
from spanlens.llm.storage import materialize

TABLES, PROBES, SEED = 4, 5, 11
ALTERNATIVES = 4
PART = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


class CrossPolytope:
    """Bucket codes of vectors of one width: own bucket and probes for each table."""

    def __init__(self, width: int, tables: int, probes: int, seed: int):
        self.width, self.tables, self.probes = width, tables, probes
        self.padded = 1 << max(1, math.ceil(math.log2(max(2, width))))
        random = np.random.default_rng([seed, width])
        self.signs = random.choice([-1.0, 1.0], (tables, 2, 3, self.padded))

    def _nearest(self, x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for flip in signs:
            x = hadamard(x * flip)
        size = np.abs(x)
        order = np.argsort(-size, axis=1, kind="stable")[:, :ALTERNATIVES]
        value = np.take_along_axis(x, order, 1)
        size = np.abs(value)
        return order * 2 + (value < 0), (size[:, :1] - size) ** 2

    def codes(self, x: np.ndarray) -> np.ndarray:
        """For unit rows ``x``: a table (row, table, 1 + probes) of codes, own bucket first."""
        x = np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))
        out = np.empty((len(x), self.tables, 1 + self.probes), np.int32)
        for t in range(self.tables):
            (a, loss_a), (b, loss_b) = (self._nearest(x, self.signs[t, k]) for k in range(2))
            code = (a[:, :, None] * (2 * self.padded) + b[:, None, :]).reshape(len(x), -1)
            loss = (loss_a[:, :, None] + loss_b[:, None, :]).reshape(len(x), -1)
            pick = np.argsort(loss, axis=1, kind="stable")[:, : 1 + self.probes]
            got = np.take_along_axis(code, pick, 1)
            out[:, t, : got.shape[1]] = got
            out[:, t, got.shape[1] :] = -1
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _hashed(tables: int, probes: int, seed: int, kind: str | None):
    """Rows of `_spread`, with vectors as bytes of ``kind``; without a kind, buckets only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CrossPolytope] = {}
        for batch in batches:
            ids, mult = (batch.column(k).to_numpy() for k in (0, 1))
            vectors = batch.column(2).to_pylist()
            widths = np.array([len(v) for v in vectors])
            for width in np.unique(widths):
                coder = made.setdefault(int(width), CrossPolytope(int(width), tables, probes, seed))
                same = np.flatnonzero(widths == width)
                for lo in range(0, len(same), 2048):
                    at = same[lo : lo + 2048]
                    x = np.array([vectors[k] for k in at], np.float64)
                    yield from _spread(ids[at], mult[at], x, coder.codes(_unit(x)), int(width), kind)

    return run


def _spread(ids: np.ndarray, mult: np.ndarray, x: np.ndarray, codes: np.ndarray, width: int, kind: str | None) -> Iterator[pa.RecordBatch]:
    tables = codes.shape[1]
    vector = pa.array([v.tobytes() for v in x.astype(kind or "<f8")], pa.binary())
    packed = pa.array([c.tobytes() for c in codes], pa.binary())
    for t in range(tables):
        row, which = np.nonzero(codes[:, t] >= 0)
        take = pa.array(row)
        if kind is None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), width * tables + t, np.int32)), pa.array(codes[row, t, which])], names=["tab", "bucket"])
            continue
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), width * tables + t, np.int32)),
                pa.array(codes[row, t, which]),
                pa.array(which == 0),
                pa.array(ids[row]),
                pa.array(mult[row]),
                packed.take(take),
                vector.take(take),
            ],
            names=["tab", "bucket", "own", "cls", "mult", "codes", "vector"],
        )


def _met_before(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether rows of codes ``a`` and ``b``, which meet in table ``t``, meet in an earlier one."""
    out = np.zeros(len(a), bool)
    for s in range(t):
        out |= (a[:, s] == b[:, s, :1]).any(1) | (b[:, s] == a[:, s, :1]).any(1)
    return out


def _verify(tables: int, threshold: float, kind: str):
    """Rows sorted by task to ``(kind, a, b)``: 0 links of class a, 1 edge of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            key = _task_key(held)
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield from work(held.slice(0, last), key[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from work(held, _task_key(held))

    def work(table: pa.Table, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        own = table.column("own").to_numpy()
        cls, mult = table.column("cls").to_numpy(), table.column("mult").to_numpy()
        tab, bucket = table.column("tab").to_numpy(), table.column("bucket").to_numpy()
        side, pair = table.column("side").to_numpy(), table.column("mixed").to_numpy()
        codes = table.column("codes").combine_chunks()
        vector = table.column("vector").combine_chunks()
        links, edges = [], []
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi - lo < 2 or not own[lo:hi].any():
                continue
            x = _unit(np.frombuffer(b"".join(vector.slice(lo, hi - lo).to_pylist()), kind).reshape(hi - lo, -1))
            c = np.frombuffer(b"".join(codes.slice(lo, hi - lo).to_pylist()), np.int32).reshape(hi - lo, tables, -1)
            t, b = int(tab[lo]) % tables, int(bucket[lo])
            home, left = own[lo:hi], side[lo:hi] == 0
            found = []
            index = np.flatnonzero(home)
            for at in range(0, len(index), 1024):  # blocks of own rows against all rows of the task
                i = index[at : at + 1024]
                near = x[i] @ x.T >= threshold
                near &= ~(home[None, :] & (i[:, None] >= np.arange(hi - lo)[None, :]))
                if pair[lo]:  # pairs between two parts only
                    near &= left[i][:, None] != left[None, :]
                r, j = np.nonzero(near)
                found.append((i[r], j))
            i, j = (np.concatenate(v) for v in zip(*found))
            if not len(i):
                continue
            root = _merge(np.arange(hi - lo), i, j)
            moved = np.flatnonzero(root != np.arange(hi - lo))
            edges.append((cls[lo:hi][moved], cls[lo:hi][root[moved]]))
            first = ~_met_before(c[i], c[j], t)
            # a pair of one row's probe and the other's own may also meet the other way round
            both = ~home[j] & (c[i, t, 1:] == c[j, t, :1]).any(1)
            first &= ~(both & (c[j, t, 0] < b))
            i, j = i[first], j[first]
            links.append((cls[lo:hi][i], mult[lo:hi][j]))
            links.append((cls[lo:hi][j], mult[lo:hi][i]))
        if links:
            a, n = (np.concatenate(v) for v in zip(*links))
            names, at = np.unique(a, return_inverse=True)
            total = np.zeros(len(names), np.int64)
            np.add.at(total, at, n)
            yield _out(0, names, total)
        if edges:
            yield _out(1, *(np.concatenate(v) for v in zip(*edges)))

    return run


def _task_key(table: pa.Table) -> np.ndarray:
    """A number that rises with each task in the sorted rows."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    columns = [table.column(c).to_numpy() for c in ("tab", "bucket", "task")]
    new = np.zeros(table.num_rows, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "a", "b"])


def near_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = TABLES, probes: int = PROBES, seed: int = SEED, part: int = PART
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``embeddings``.

    Two rows link if their cosine is at least ``threshold``; ``n_links`` counts
    the other rows linked directly, copies included.  Null, empty and zero
    vectors, and those with null or non-finite numbers, link with nothing; so do
    vectors of different lengths.  A null id is never the component's; a row with
    a null id is not kept.  Labels and other columns are not read.
    """
    vector = F.col("vector")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    keyed = rows.select("vec_id", F.when(_usable(vector), vector).alias("vector"))
    keyed = keyed.withColumns({"h1": F.when(vector.isNotNull(), F.xxhash64(vector)), "h2": F.when(vector.isNotNull(), F.xxhash64(F.lit(1), vector))})
    classes = keyed.where(vector.isNotNull()).groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")

    schema = "tab int, bucket int, own boolean, cls long, mult long, codes binary, vector binary"
    # floats travel as floats; hashing twice costs less than keeping all copies of the vectors
    kind = "<f4" if embeddings.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    hashed = classes.select("cls", "mult", "vector")
    large = _large(hashed.mapInArrow(_hashed(tables, probes, seed, None), "tab int, bucket int"), part)
    dealt = _deal(hashed.mapInArrow(_hashed(tables, probes, seed, kind), schema), large)
    ordered = dealt.repartition("tab", "bucket", "task").sortWithinPartitions("tab", "bucket", "task")
    found = materialize(ordered.mapInArrow(_verify(tables, threshold, kind), "kind int, a long, b long"), "links")

    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    roots = connected_components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = classes.select("h1", "h2", "cls", "least", "mult")
    known = known.join(counts, known.cls == counts.a, "left").join(roots, F.col("cls") == F.col("node"), "left")
    known = known.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cls").alias("root"))
    smallest = known.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    known = known.join(smallest, known.root == smallest.r).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n_links", "component_id")
    known = materialize(known, "classes")
    # rows without a usable vector have no class; a key of their own keeps them apart
    keyed = keyed.select("vec_id", F.coalesce("h1", F.xxhash64("vec_id")).alias("h1"), F.coalesce("h2", F.lit(0)).alias("h2"), vector.isNotNull().alias("usable"))
    joined = keyed.join(known, (keyed.h1 == known.k1) & (keyed.h2 == known.k2) & keyed.usable, "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _large(buckets: DataFrame, part: int) -> DataFrame:
    """``(t, b, parts)`` of the buckets beyond ``part`` rows."""
    large = buckets.groupBy("tab", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > part)
    large = large.select(F.col("tab").alias("t"), F.col("bucket").alias("b"), F.ceil(F.col("n") / part).cast("int").alias("parts"))
    return materialize(large, "large-buckets")


def _deal(spread: DataFrame, large: DataFrame) -> DataFrame:
    """Rows with their task in the bucket; rows of a large bucket go to a task for each pair of parts."""
    if large.isEmpty():
        return spread.withColumns({"task": F.lit(0), "side": F.lit(0), "mixed": F.lit(False)})
    joined = spread.join(large, (spread.tab == large.t) & (spread.bucket == large.b), "left")
    joined = joined.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    other = joined.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("s", "o"), F.greatest("s", "o")
    return other.select(
        *spread.columns, (low * F.col("parts") + high).alias("task"), (F.col("s") == high).cast("int").alias("side"), (low != high).alias("mixed")
    )
