"""The queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary; another file can be named by SPANLENS_TOKENIZER."""
    if "SPANLENS_TOKENIZER" in os.environ:
        return os.environ["SPANLENS_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: The rules that op2 judges by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.url_filter import Rule, judge, rules_frame

    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, [Rule(*r) for r in URL_RULES]))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.col("base.start")
    base = F.array_distinct(F.col("base.label"))
    both = F.array_distinct(F.concat(F.col("base.label"), F.col("spans.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        "score",
    )


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.storage import new_folder
    from spanlens.llm.token_output import tokenize

    return tokenize(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), tokenizer_path())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.storage import new_folder
    from spanlens.llm.warc import archive

    records = archive(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    found = records.where(F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.lm_score import score_against_labelled

    return score_against_labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlens.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_mixing": op3_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_token_output": op5_token_output,
    "op6_warc": op6_warc,
    "op7_lm_score": op7_lm_score,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_decontaminate": op10_decontaminate,
}

_OP2_SQL = """
WITH rules(rhost, rpath, act) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT p.*, rhost || rpath AS rule, act, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM parts p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM fits WHERE k = 1
"""

_OP6_SQL = """
WITH p AS (SELECT row_number() OVER () AS n, page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT n, page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first_id FROM p),
q AS (SELECT n, i, CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER) AS v FROM d, range(8) AS r(i)),
l AS (SELECT n, 4 * i + k AS place, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> CAST(15 - 5 * k AS INTEGER)) & 31) + 1, 1) AS c FROM q, range(4) AS r(k)),
b AS (SELECT n, string_agg(c, '' ORDER BY place) AS payload_digest FROM l GROUP BY n)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN b USING (n)
"""

_OP10_SQL = """
WITH words AS (
  SELECT 0 AS is_item, row_number() OVER () AS n, doc_id AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
phrases AS (
  SELECT DISTINCT id AS item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM words WHERE is_item = 1 AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
grams AS (
  SELECT n, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE is_item = 0 AND len(w) >= size)),
hits AS (SELECT n, i, g.size, item FROM grams g JOIN phrases p ON g.size = p.size AND g.gram = p.gram),
hit_words AS (SELECT n, count(DISTINCT k) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS k FROM hits) GROUP BY n),
hit_items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT n, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY n)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN hit_words USING (n) LEFT JOIN hit_items USING (n) WHERE d.is_item = 0
"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": _OP2_SQL,
    "op6_warc": _OP6_SQL,
    "op10_decontaminate": _OP10_SQL,
}
