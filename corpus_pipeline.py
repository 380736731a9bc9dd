"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before kept.  All but the last return rows of ``docs`` with all their columns;
the last writes token files and returns what they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlens.llm import decontam, mixing, quality, simhash, token_output
from spanlens.llm.queries import table, tokenizer_path
from spanlens.llm.storage import materialize, new_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on labelled rows of this stage's input."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Groups by fingerprint are joined where two texts' sets of five-word shingles are similar by 0.8.
    """
    return simhash.keep_one(docs, similar=(5, 0.8))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold: ``(doc_id, start, n_tokens, ids_crc32)``."""
    return token_output.tokenize(docs, new_folder(spark, "tokens"), tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mix_stage),
    ("token-ID output", token_stage),
]

#: Boosted tables, SimHash, the cube method and BPE have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
