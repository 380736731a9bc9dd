"""Documents in and findings out: text files, guards, fenced prompts, Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions.text import SPACE, is_blank, lines_of, trim
from spanlens.operators.clean import clean_text

#: Fixed value: the largest file that is read.
MOST_BYTES = 25 * 1024 * 1024
FENCE = "```"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, path, text)`` of whole UTF-8 files; the id is a hash of the path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, content)``; content of files beyond the limit is never loaded."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.where(F.col("length") <= MOST_BYTES)


def size_guard(files: DataFrame, length: Column) -> DataFrame:
    """Rows with ``accepted``: at most ``MOST_BYTES``."""
    return files.withColumn("accepted", length <= MOST_BYTES)


def strict_size(length: Column) -> Column:
    """The length, or an error for a file beyond the limit."""
    return F.when(length > MOST_BYTES, F.raise_error(F.lit("file is larger than 25 MiB"))).otherwise(length)


def load_text(docs: DataFrame) -> DataFrame:
    """Pasted or extracted text, cleaned; texts without any content are left out."""
    return accepted(docs).withColumn("text", clean_text(F.col("text")))


def accepted(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def reject_no_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, reason)`` of documents that hold no text."""
    return docs.where(F.col("text").isNull() | is_blank(F.col("text"))).select("doc_id", F.lit("sem-texto").alias("reason"))


def extract_fenced(markdown: Column) -> Column:
    """The first fenced block, trimmed; to the end where it is not closed; all where there is none."""
    lines = lines_of(markdown)
    is_fence = F.transform(lines, lambda x: F.regexp_replace(x, f"{SPACE}+\\z", "") == FENCE)
    start = F.array_position(is_fence, True)
    rest = F.slice(lines, (start + 1).cast("int"), F.greatest(F.size(lines) - start, F.lit(0)).cast("int"))
    marks = F.slice(is_fence, (start + 1).cast("int"), F.greatest(F.size(lines) - start, F.lit(0)).cast("int"))
    stop = F.array_position(marks, True)
    body = F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(rest)
    return trim(F.when(start > 0, F.array_join(body, "\n")).otherwise(markdown))


def write_dossiers(dossiers: DataFrame, path: str) -> None:
    """One Markdown text for each document; readable by `read_dossiers`."""
    dossiers.select("doc_id", "markdown").write.mode("overwrite").parquet(path)


def write_markdown(dossiers: DataFrame, path: str, buckets: int = 256) -> None:
    """Plain text below ``bucket=...`` folders, a file with many documents in each.

    Every document is headed by a line ``<!-- document <id> -->``; the number of files is bounded
    by ``buckets``, not by the documents.
    """
    marked = F.concat(F.lit("<!-- document "), F.col("doc_id").cast("string"), F.lit(" -->\n"), F.col("markdown"))
    rows = dossiers.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", marked.alias("value"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").drop("doc_id").write.mode("overwrite").partitionBy("bucket").text(path)


def read_dossiers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
