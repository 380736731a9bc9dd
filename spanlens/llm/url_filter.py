"""Allow and block rules for URLs: blocked Bloom filters, then exact hash joins.

Only DataFrame functions run here.  A rule is a canonical host and a prefix of
the path.  A URL's host and the hosts above it are probed in a Bloom filter of
the rules' hosts; the few that pass are joined to the exact hosts, which list the
lengths of path that their rules have.  The prefixes of these lengths are probed
in a second filter, of whole rules, and only those that pass are joined to the
rules.  False positives end at the joins, and all else never reaches them.  The
plan is the same for any number of rules and of their shapes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"

WORDS = 8  # of 64 bits: one block is one cache line
BITS_PER_RULE = 16
MOST_BLOCKS = 1 << 17  # 8 MiB, whatever the number of rules
BROADCAST_BYTES = 16 << 20  # of rules; beyond, the exact joins shuffle


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str  # allow or block


def host_of(url: Column) -> Column:
    """Lower-case host; empty for a null URL or one without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A rule list as a frame ``(host, path, action)``; larger lists can come from any table."""
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS action WHERE false")
    quoted = ", ".join("(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in (r.host, r.path, r.action)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(host, path, action)")


def _block(key: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(blocks).cast("long"))


def _masks(key: list[Column]) -> Column:
    """One bit in each word of the block, from six bits each of a second hash."""
    second = F.xxhash64(*key, F.lit(1))
    return F.array(*[F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(WORDS)])


def n_blocks(count: int) -> int:
    """Blocks of a filter for ``count`` keys: a power of two, at most ``MOST_BLOCKS``."""
    blocks = 1
    while blocks * WORDS * 64 < count * BITS_PER_RULE and blocks < MOST_BLOCKS:
        blocks *= 2
    return blocks


def bloom_blocks(keys: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """``(block, w0..w7)`` of the keys that some columns make, a row for each block in use."""
    key = [F.col(c) for c in columns]
    masked = keys.select(_block(key, blocks).alias("block"), _masks(key).alias("m"))
    return masked.groupBy("block").agg(*[F.bit_or(F.col("m")[i]).alias(f"w{i}") for i in range(WORDS)])


def may_be_listed(rows: DataFrame, columns: list[str], filled: DataFrame, blocks: int) -> DataFrame:
    """The ``rows`` whose key the filter does not rule out."""
    key = [F.col(c) for c in columns]
    mask = F.col("mask")
    may = F.lit(True)
    for i in range(WORDS):
        may = may & (F.col(f"w{i}").bitwiseAND(mask[i]) == mask[i])
    probed = rows.withColumns({"block": _block(key, blocks), "mask": _masks(key)})
    return probed.join(F.broadcast(filled), "block").where(may).select(*rows.columns)


def _suffixes(host: Column, most: int) -> Column:
    """The host and the hosts above it, of at most ``most`` labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, a row for each row of ``pages``.

    A rule fits its host and all subdomains where the path starts with its own.
    Of several the longest decides (then the one with the longer host); of two
    actions for the same rule, block.  Without a rule, ``rule`` is null and the
    verdict is ``default``.  Null URLs and URLs without ``://`` have an empty
    host and path, which no rule fits; a rule without a host or with a null
    fits nothing.  Null ids, repeated rows and other columns are no matter: a
    verdict belongs to a host and path, and every row gets its own.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    named = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action")
    listed = named.where("rule_host <> '' AND rule_path IS NOT NULL AND action IS NOT NULL")
    listed = listed.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))  # block sorts last
    width = F.octet_length("rule_host") + F.octet_length("rule_path") + F.octet_length("action") + 64
    count, labels, size = listed.agg(F.count("*"), F.max(F.size(F.split("rule_host", r"\."))), F.sum(width)).first()
    if not count:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    small = F.broadcast if size <= BROADCAST_BYTES else lambda frame: frame
    blocks = n_blocks(count)
    hosts = listed.groupBy("rule_host").agg(F.collect_set(F.char_length("rule_path")).alias("lengths"))

    tried = base.where("host <> ''").select("host", "path", F.explode(_suffixes(F.col("host"), labels)).alias("rule_host"))
    near = may_be_listed(tried, ["rule_host"], bloom_blocks(hosts, ["rule_host"], blocks), blocks).join(small(hosts), "rule_host")
    length = F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n")
    prefixes = near.select("host", "path", "rule_host", length).select("host", "path", "rule_host", F.substring("path", F.lit(1), F.col("n")).alias("rule_path"))
    met = may_be_listed(prefixes, ["rule_host", "rule_path"], bloom_blocks(listed, ["rule_host", "rule_path"], blocks), blocks)
    met = met.join(small(listed), ["rule_host", "rule_path"])
    chars = F.char_length("rule_host")
    best = F.max(F.struct((chars + F.char_length("rule_path")).alias("n"), chars.alias("host_chars"), F.concat("rule_host", "rule_path").alias("rule"), "action"))
    fits = met.groupBy("host", "path").agg(best.alias("best"))
    judged = base.join(fits, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
