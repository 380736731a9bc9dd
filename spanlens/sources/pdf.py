"""PDF files as positioned items, where a PDF library is installed (PyMuPDF).

Without it the source of layout is any table of items, as `operators.layout`
describes; importing this module needs nothing.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.sources.documents import read_binary_files

SCHEMA = "doc_id long, page_no int, item_no int, str string, transform array<double>, width double, height double, page_width double, page_height double"


def available() -> bool:
    return importlib.util.find_spec("fitz") is not None


def _pages(content: bytes) -> Iterator[tuple[int, int, str, list[float], float, float, float, float]]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        for page_no, page in enumerate(document, 1):
            number = 0
            for block in page.get_text("dict")["blocks"]:
                for line in block.get("lines", []):
                    for span in line["spans"]:
                        left, _, right, _ = span["bbox"]
                        size = float(span["size"])
                        place = [size, 0.0, 0.0, size, float(left), float(page.rect.height - span["origin"][1])]
                        yield page_no, number, span["text"], place, float(right - left), size, float(page.rect.width), float(page.rect.height)
                        number += 1


def read_pdf_items(spark: SparkSession, path: str) -> DataFrame:
    """Raw items of all pages of the PDF files at ``path``; files beyond the size limit are left out.

    The id is a hash of the file's path.  ``normalize_items`` and ``page_text`` take it from here.
    """
    if not available():
        raise ImportError("reading PDF files needs PyMuPDF; without it, give positioned items as a table")
    files = read_binary_files(spark, path).select(F.xxhash64("path").alias("doc_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), *[pa.float64()] * 4]
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(doc_id, *r) for r in _pages(content)]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.mapInArrow(run, SCHEMA)
