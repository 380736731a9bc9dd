"""Passages that stand in more than one section, through an index of eight-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions.text import MARK, collapse, flat
from spanlens.operators.sections import SECTION_LABEL

K, LEAST_CHARS = 8, 60
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}.,]*"


def tokens(sections: DataFrame) -> DataFrame:
    """Rows ``(doc_id, sec, text)`` to ``(doc_id, sec, i, key, start, stop)``, a row for each token.

    Places are running sums over the exploded pieces, so a long text costs in
    proportion to its length.
    """
    pieces = F.split(F.regexp_replace(F.translate("text", MARK, " "), TOKEN, f"{MARK}$0{MARK}"), MARK, -1)
    rows = sections.select("doc_id", "sec", F.posexplode(pieces).alias("piece", "token"))
    order = Window.partitionBy("doc_id", "sec").orderBy("piece")
    stop = F.sum(F.char_length("token")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    rows = rows.withColumn("stop", stop).where(F.col("piece") % 2 == 1)
    return rows.select(
        "doc_id", "sec", ((F.col("piece") - 1) / 2).cast("int").alias("i"), flat(F.col("token")).alias("key"), (F.col("stop") - F.char_length("token")).alias("start"), "stop"
    )


def shingles(rows: DataFrame) -> DataFrame:
    """Tokens with ``shingle``, the keys from here to seven on, and where the last of them ends."""
    order = Window.partitionBy("doc_id", "sec").orderBy("i")
    last = F.lead("stop", K - 1).over(order)
    joined = F.concat_ws(" ", *[F.lead("key", n).over(order) for n in range(K)])
    return rows.withColumns({"last": last, "shingle": joined}).where("last IS NOT NULL").drop("key", "stop")


def shared_shingles(found: DataFrame) -> DataFrame:
    """``(doc_id, shingle, secs)`` of shingles in several sections of a document."""
    secs = F.array_sort(F.collect_set("sec"))
    return found.groupBy("doc_id", "shingle").agg(secs.alias("secs")).where(F.size("secs") > 1)


def shingle_counts(found: DataFrame) -> DataFrame:
    """``(doc_id, shingle, n_secs)`` of shared shingles, for any number of sections: no set of them is gathered."""
    once = found.select("doc_id", "sec", "shingle").distinct()
    return once.groupBy("doc_id", "shingle").agg(F.count("*").alias("n_secs")).where("n_secs > 1")


def kind_sections(blocks: DataFrame) -> DataFrame:
    """``(doc_id, sec, kind, text)``: all blocks of a kind as one, in order of first appearance."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    text = F.array_join(F.transform(ordered, lambda s: F.concat(F.lit("\n"), s["text"])), "")
    merged = blocks.groupBy("doc_id", "kind").agg(F.min("block_no").alias("first"), text.alias("text"))
    return merged.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).alias("sec"), "kind", "text")


def repeating(sections: DataFrame) -> DataFrame:
    """The ``sections`` of documents in which some shingle stands in two of them, told by hashes.

    Most documents repeat nothing; only the others need a row for each token.
    """
    said = sections.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), " ").alias("said"))
    keys = said.select("doc_id", F.split(flat(F.col("said")), " ", -1).alias("keys"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("keys") - K), lambda i: F.xxhash64(F.slice("keys", i + 1, K)))
    own = keys.select("doc_id", F.when(F.size("keys") >= K, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>")).alias("own"))
    both = own.groupBy("doc_id").agg(F.flatten(F.collect_list("own")).alias("h"))
    some = both.where(F.size("h") > F.size(F.array_distinct("h"))).select("doc_id")
    return sections.join(some, "doc_id", "left_semi")


def repeated_lines(sections: DataFrame) -> DataFrame:
    """``(doc_id, sec, ord, quote, secs)``: runs of shared shingles, told from the first section that has them.

    Partners are the union over a run; a run is told only where all partners come
    later; a passage of less than ``LEAST_CHARS`` or told before is left out.
    """
    found = shingles(tokens(sections))
    shared = found.join(shared_shingles(found), ["doc_id", "shingle"])
    run = F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "sec").orderBy("i"))
    runs = shared.withColumn("run", run).groupBy("doc_id", "sec", "run").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("secs")))).alias("secs")
    )
    runs = runs.where(F.array_min("secs") == F.col("sec"))
    quoted = runs.join(sections.select("doc_id", "sec", "text"), ["doc_id", "sec"])
    quoted = quoted.withColumn("quote", collapse(F.call_function("substring", F.col("text"), F.col("start") + 1, F.col("last") - F.col("start"))))
    quoted = quoted.where(F.char_length("quote") >= LEAST_CHARS)
    first = F.row_number().over(Window.partitionBy("doc_id", "quote").orderBy("sec", "start")) == 1
    told = quoted.withColumn("told", first).where("told")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec", "start"))
    return told.select("doc_id", "sec", order.alias("ord"), "quote", "secs")


def section_names(repeated: DataFrame, sections: DataFrame) -> DataFrame:
    """``(doc_id, ord, quote, kinds, names)`` with the sections' kinds and their joined names."""
    parts = repeated.select("doc_id", "ord", "quote", F.posexplode("secs").alias("k", "sec"))
    named = parts.join(sections.select("doc_id", "sec", "kind"), ["doc_id", "sec"])
    label = F.create_map(*[F.lit(x) for pair in SECTION_LABEL.items() for x in pair])
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("k", "kind"))), lambda s: s["kind"])
    rows = named.groupBy("doc_id", "ord", "quote").agg(kinds.alias("kinds"))
    return rows.select("doc_id", "ord", "quote", F.array_join("kinds", ",").alias("kinds"), F.array_join(F.transform("kinds", lambda k: label[k]), " e ").alias("names"))
