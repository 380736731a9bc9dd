"""Rows that must meet in a task: blocks by key, with blocks beyond a size cut into parts.

A block is all rows with the same key columns.  One of bounded size is one task.
A larger one is cut into parts by a hash, and every pair of parts is a task, so
all its rows still meet and none is ever in one task alone with all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.storage import materialize

#: Bytes of shuffled rows that one partition gets.
PARTITION_BYTES = 64 << 20


def large_blocks(rows: DataFrame, keys: list[str], part: int) -> DataFrame:
    """``(k0, k1, .., parts)`` of the blocks that hold more than ``part`` rows."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > part)
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    return materialize(counted.select(*named, F.ceil(F.col("n") / part).cast("int").alias("parts")), "large")


def deal(rows: DataFrame, keys: list[str], by: str, large: DataFrame | None) -> DataFrame:
    """``rows`` with ``task``, ``side`` and ``mixed``; a row of a large block goes to one task for each part.

    In a task with ``mixed``, only pairs of rows from different sides are to meet.
    """
    if large is None or large.isEmpty():
        return rows.withColumns({"task": F.lit(0).cast("long"), "side": F.lit(0), "mixed": F.lit(False)})
    same = [F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)]
    joined = rows.join(large, same, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    joined = joined.withColumn("s", F.pmod(F.xxhash64(F.lit(5), by), F.col("parts")).cast("int"))
    other = joined.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("s", "o"), F.greatest("s", "o")
    task = low.cast("long") * F.col("parts") + high
    return other.select(*rows.columns, task.alias("task"), (F.col("s") == high).cast("int").alias("side"), (low != high).alias("mixed"))


def gather(dealt: DataFrame, keys: list[str], n_rows: int, row_bytes: int) -> DataFrame:
    """Rows of each task next to each other; as many partitions as about ``n_rows`` rows need."""
    conf = dealt.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows * row_bytes / PARTITION_BYTES))
    return dealt.repartition(parts, *keys, "task").sortWithinPartitions(*keys, "task")


def tasks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each task of `gather`, task by task, from a partition's batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "task")]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:]):
            now = tuple(c[lo] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)
