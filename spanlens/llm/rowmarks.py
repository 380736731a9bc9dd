"""Decisions on rows, applied where the rows lie: no shuffle of texts.

A row of a Parquet table is named by its place: a hash of the file's path and
the row's index in it.  An operator decides on places and writes, for each run of
``CHUNK`` rows of a file, how often each row is taken.  A second scan of the
table reads the marks of the rows it meets and drops or repeats them, so only
the decisions are shuffled, never the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.storage import materialize, new_folder, open_store, publish
from spanlens.llm.textbytes import BATCH_BYTES, map_texts, tidy

FILE, ROW = "__file", "__row"
CHUNK = 1 << 20
MARK = np.dtype("<u4")


def is_plain_scan(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a Parquet file, and a second scan finds the same rows.

    Only projections and filters may lie over the scan: anything else (a join,
    ``explode``, a union) can make several rows of one, or rows of no file.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation") and plan.nodeName() != "Relation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


class Placed:
    """A table whose rows have places; one that is no plain scan is first written to the shared folder.

    The table's own columns are never mixed with the places by name, so they may have any names.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs if is_plain_scan(docs) else materialize(docs, "rows")
        self.spark = docs.sparkSession

    def _place(self, file: str = FILE, row: str = ROW) -> list[Column]:
        hidden = self.docs.metadataColumn("_metadata")
        return [F.xxhash64(hidden.getField("file_path")).alias(file), hidden.getField("row_index").alias(row)]

    def select(self, **columns: Column) -> DataFrame:
        """Columns by new names, and the place ``(__file, __row)`` of each row."""
        return self.docs.select(*[c.alias(n) for n, c in columns.items()], *self._place())

    def _free(self, name: str) -> str:
        """A name that no column of the table has."""
        taken = {c.lower() for c in self.docs.columns}
        while name in taken:
            name += "_"
        return name

    def take(self, decisions: DataFrame) -> DataFrame:
        """The table's rows as often as ``decisions`` ``(__file, __row, copies)`` say, with all columns unchanged."""
        folder = new_folder(self.spark, "marks")
        write_marks(decisions, folder)
        width = len(self.docs.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = Marks(folder)
            for batch in batches:
                copies = marks.copies(batch.column(width).to_numpy(), batch.column(width + 1).to_numpy())
                kept = batch.select(range(width))
                order = np.repeat(np.arange(len(copies)), copies)  # copies side by side, in batches that do not grow
                ends = np.cumsum(_row_bytes(kept)[order])
                for part in np.split(order, np.searchsorted(ends, np.arange(BATCH_BYTES, int(ends[-1]) if len(ends) else 0, BATCH_BYTES), side="right")):
                    yield kept.take(pa.array(part))

        return map_texts(self.docs.select("*", *self._place(self._free(FILE), self._free(ROW))), run, self.docs.schema)


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row takes."""
    size = np.full(batch.num_rows, 16 * (batch.num_columns + 1), np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return size


def _runs(file: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of rows of the same chunk begin and end."""
    if len(file):
        cut = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (chunk[1:] != chunk[:-1]), [True]]))
        yield from zip(cut[:-1].tolist(), cut[1:].tolist())


def _path(folder: str, file: int, chunk: int) -> str:
    return f"{folder}/{file & (2**64 - 1):016x}-{chunk}.bin"


def write_marks(decisions: DataFrame, folder: str) -> None:
    """Write ``(__file, __row, copies)``; rows that are not there are taken 0 times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, copies = None, [], []

        def close() -> None:
            if now is not None:
                row, n = np.concatenate(rows), np.concatenate(copies)
                marks = np.zeros(int(row.max()) + 1, MARK)
                marks[row] = n
                publish(_path(folder, *now), lambda out: out.write(marks.tobytes()))

        for batch in batches:
            file, row, n = (batch.column(k).to_numpy() for k in range(3))
            chunk = row // CHUNK
            for lo, hi in _runs(file, chunk):
                key = (int(file[lo]), int(chunk[lo]))
                if key != now:
                    close()
                    now, rows, copies = key, [], []
                rows.append(row[lo:hi] % CHUNK)
                copies.append(n[lo:hi])
        close()
        yield pa.RecordBatch.from_arrays([pa.array([True])], names=["done"])

    taken = decisions.where("copies > 0").select(FILE, ROW, F.col("copies").cast("long")).withColumn("c", F.floor(F.col(ROW) / CHUNK))
    ordered = taken.repartition(FILE, "c").sortWithinPartitions(FILE, "c").drop("c")
    ordered.mapInArrow(tidy(run), "done boolean").agg(F.count("*")).collect()


class Marks:
    """How often rows are taken, read from the files of `write_marks` as a scan meets them."""

    def __init__(self, folder: str):
        self.folder = folder
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def _of(self, file: int, chunk: int) -> np.ndarray:
        if (file, chunk) not in self.held:
            self.held.clear()  # a scan goes through a file in order
            store, inner = open_store(_path(self.folder, file, chunk))
            data = b""
            if store.get_file_info(inner).is_file:
                with store.open_input_stream(inner) as source:
                    data = source.read()
            self.held[file, chunk] = np.frombuffer(data, MARK)
        return self.held[file, chunk]

    def copies(self, file: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row), np.int64)
        chunk = row // CHUNK
        for lo, hi in _runs(file, chunk):
            known = self._of(int(file[lo]), int(chunk[lo]))
            at = row[lo:hi] % CHUNK
            inside = at < len(known)
            out[lo:hi][inside] = known[at[inside]]
        return out
