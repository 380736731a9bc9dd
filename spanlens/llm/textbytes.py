"""UTF-8 bytes of Arrow columns, and words of texts as bytes.

Working on bytes keeps every step linear and in C: lower-casing A-Z and turning
separators into spaces is one table lookup for each byte.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z; ASCII other than letters and digits to a space; other bytes stay.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes; nulls as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z."""
    return text.translate(ALNUM).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text after lower-casing A-Z."""
    return text.lower().split()


#: Most bytes of an Arrow batch; texts can be long, so a count of rows bounds nothing.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def hold_batches(spark: SparkSession) -> None:
    """Arrow batches of the session are of ``BATCH_BYTES`` at most from here on."""
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(_LIMIT)) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Run) -> Run:
    """``run`` that gives memory back when its task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_texts(rows: DataFrame, run: Run, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded size; a task gives its memory back."""
    hold_batches(rows.sparkSession)
    return rows.mapInArrow(tidy(run), schema)
