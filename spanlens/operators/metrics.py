"""Results stated without a number, and periods without a description.

The bounds and the rules for paragraphs here are this engine's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions.text import pattern, trim
from spanlens.operators.sections import by_line, so_far
from spanlens.operators.stints import classed_lines

LEAST_CHARS = 40
OPEN_CARDS = 7
BULLET = r"\A\s*(?:[•·▪●◦‣*–—-]|\d{1,2}[.)])\s+"

#: What to ask for where a number is missing, by topic.
QUESTIONS = (
    ("quantidade", "Quantos itens, pessoas ou clientes isso envolveu?"),
    ("resultado", "Quanto mudou, comparado com antes?"),
    ("prazo", "Em quanto tempo, ou com que frequência?"),
)


def sentences(paragraph: Column) -> Column:
    """Sentences with their final mark; only white space after a mark or a line break cuts."""
    cut = F.split(paragraph, pattern(r"(?<=[.;!?])\s+|\n+"), -1)
    return F.filter(F.transform(cut, trim), lambda s: s != "")


def paragraphs(lines: DataFrame) -> DataFrame:
    """``(doc_id, para_no, line_no, text, is_header)``: wrapped lines joined by a space.

    A blank line, a bullet, a heading, a period or a location ends a paragraph.
    Up to two label lines right above a period are headers, and so is a label
    line in capitals right below one.
    """
    line = F.col("line")
    rows = classed_lines(lines)
    ahead = lambda n: F.lead("sort", n).over(by_line())
    behind = F.lag("sort").over(by_line())
    marked = line.rlike(pattern(BULLET))
    over = (ahead(1) == "period") | (ahead(1).isin("label", "duration") & (ahead(2) == "period"))
    under = (behind == "period") & (F.upper(line) == line) & (F.lower(line) != line)
    header = (F.col("sort") == "label") & ~marked & (F.coalesce(over, F.lit(False)) | F.coalesce(under, F.lit(False)))
    wall = F.col("sort").isin("blank", "period", "duration") | F.col("heading") | F.col("place")
    rows = rows.withColumns({"wall": wall, "header": header & ~wall, "marked": marked})
    lag = lambda c: F.lag(c).over(by_line())
    opens = F.col("marked") | F.coalesce(lag("wall"), F.lit(True)) | (F.col("header") != F.coalesce(lag("header"), F.lit(False)))
    rows = rows.withColumn("opens", opens & ~F.col("wall"))
    rows = rows.withColumn("para_no", F.sum(F.col("opens").cast("int")).over(so_far()).cast("int")).where(~F.col("wall"))
    body = trim(F.regexp_replace("line", pattern(BULLET), ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("line")))), lambda s: s["line"]), " ")
    found = rows.groupBy("doc_id", "para_no").agg(F.min("line_no").alias("line_no"), joined.alias("text"), F.max("header").alias("is_header"))
    return found.where("text <> ''")


def described(paras: DataFrame) -> DataFrame:
    """Sentences of `paragraphs` that are no headers: ``(doc_id, line_no, ord, quote)``."""
    rows = paras.where(~F.col("is_header"))
    return rows.select("doc_id", "line_no", F.posexplode_outer(sentences(F.col("text"))).alias("ord", "quote")).where("quote IS NOT NULL")


def _as_of(rows: DataFrame, stints: DataFrame) -> DataFrame:
    """Each row with the last stint at or before its line, by one union and one window."""
    marks = stints.select("doc_id", "line_no", F.lit(0).alias("after"), F.struct("pos", "label", "start_ym").alias("stint"), F.lit(None).alias("own"))
    own = rows.select("doc_id", "line_no", F.lit(1).alias("after"), F.lit(None).alias("stint"), F.struct(*[c for c in rows.columns if c != "doc_id"]).alias("own"))
    order = Window.partitionBy("doc_id").orderBy("line_no", "after", F.col("stint.pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(own).withColumn("stint", F.last("stint", ignorenulls=True).over(order))
    return both.where("after = 1").select("doc_id", "own.*", "stint")


def missing_metrics(paras: DataFrame, stints: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``(doc_id, ord, quote, label, metric_key)``: sentences of `paragraphs` of some length without a digit.

    Those of the latest period come first, in order of the document; those
    without a period come last.
    """
    found = described(paras).where((F.char_length("quote") >= least) & ~F.col("quote").rlike("[0-9]"))
    rows = _as_of(found, stints)
    order = Window.partitionBy("doc_id").orderBy(F.col("stint.start_ym").desc_nulls_last(), F.col("stint.pos").asc_nulls_last(), "line_no", "ord")
    return rows.select(
        "doc_id",
        F.row_number().over(order).alias("ord"),
        "quote",
        F.col("stint.label").alias("label"),
        metric_key(F.col("stint.label"), F.col("quote")).alias("metric_key"),
    )


def metric_key(label: Column, quote: Column) -> Column:
    return F.concat_ws("\x01", F.coalesce(label, F.lit("")), quote)


def silent_stints(paras: DataFrame, stints: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Stints without one of `paragraphs` of some length before the next period: a left anti join."""
    texts = paras.where(~F.col("is_header") & (F.char_length("text") >= least)).select("doc_id", "line_no", "para_no")
    spoken = _as_of(texts, stints).where("stint IS NOT NULL").select("doc_id", F.col("stint.pos").alias("pos"))
    return stints.join(spoken, ["doc_id", "pos"], "left_anti")


def metric_answers(metrics: DataFrame, answers: DataFrame) -> DataFrame:
    """Findings with the answer to each, empty where none was given."""
    given = answers.groupBy("doc_id", "metric_key").agg(F.max("answer").alias("answer"))
    return metrics.join(given, ["doc_id", "metric_key"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def metric_cards(metrics: DataFrame, most: int = OPEN_CARDS) -> DataFrame:
    """Findings with whether they are shown open: the first ``most`` of a document."""
    return metrics.withColumn("shown", F.col("ord") <= most)


def metric_questions(cards: DataFrame) -> DataFrame:
    """``(doc_id, ord, k, topic, question)``: what to ask for each finding of `metric_cards` that is shown open."""
    asked = F.array(*[F.struct(F.lit(topic).alias("topic"), F.lit(question).alias("question")) for topic, question in QUESTIONS])
    rows = cards.where("shown").select("doc_id", "ord", F.posexplode(asked).alias("k", "q"))
    return rows.select("doc_id", "ord", "k", "q.topic", "q.question")
