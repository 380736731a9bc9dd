"""Employer and role labels around each period, by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions.text import SPACE, SPACES, collapse, first_replaced, flat, is_blank, let, pattern, strip_accents, words
from spanlens.operators.clean import is_location
from spanlens.operators.periods import has_period
from spanlens.operators.sections import by_line, detect_heading

#: Bounds of a label, lines that only state a duration, words that label nothing.
LABEL_CHARS = (2, 80)
DURATION_ONLY = r"\A(?:\d+\s*anos?(?:\s*(?:e\s*)?\d+\s*mes(?:es)?)?|\d+\s*mes(?:es)?)$"
BOILERPLATE = ("periodo", "duracao", "data", "de", "ate", "desde", "presente")
_BARS = "|•-–—:"
_FIELD = rf"(?:{SPACE}|[|•\-–—])*\b(?:per[íi]odo|data|dura[çc][ãa]o)\b(?:{SPACE}|[:.])*$"


def clean_label(line: Column) -> Column:
    """Without bars, dashes, colons and white space at the ends, and single spaces within."""
    return collapse(F.btrim(line, F.lit(SPACES + _BARS)))


def _is_prose(text: Column) -> Column:
    return text.endswith(";") | (text.endswith(".") & (F.size(words(text)) > 6))


def _names_nothing(text: Column) -> Column:
    return flat(text).isin(list(BOILERPLATE))


def _fits(text: Column) -> Column:
    return F.char_length(text).between(*LABEL_CHARS)


def is_label_line(line: Column) -> Column:
    """A short line that could be an employer or a role: no period, prose, heading or field name."""
    return let(clean_label(line), lambda label: _is_label(label, has_period(line)))


def _is_label(label: Column, has_one: Column) -> Column:
    shaped = _fits(label) & ~_is_prose(label)
    return F.when(shaped & ~has_one, detect_heading(label).isNull() & ~_names_nothing(label)).otherwise(False)


def same_line_label(line: Column, quote: Column) -> Column:
    """What stands beside the period on its own line; null if nothing that could be a label."""
    rest = first_replaced(line, quote)
    rest = F.regexp_replace(rest, pattern(r"\(\s*\d[^()]*\)\s*$"), "")
    label = clean_label(F.regexp_replace(rest, pattern(_FIELD), ""))
    return F.when(_fits(label) & ~_names_nothing(label), label)


def classed_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``label`` (cleaned), ``sort``: blank, period, duration, label or other, and ``heading`` and ``place``.

    The patterns of periods and headings make this the dearest step on lines; lines that have
    been classified are taken as they are.
    """
    if "sort" in lines.columns:
        return lines
    rows = lines.withColumns({"heading": detect_heading(F.col("line")).isNotNull(), "place": is_location(F.col("line"))})
    rows = rows.withColumns({"label": clean_label(F.col("line")), "has_one": has_period(F.col("line"))})
    rows = rows.withColumn("labels", _is_label(F.col("label"), F.col("has_one")))
    sort = (
        F.when(is_blank(F.col("line")), "blank")
        .when(F.col("has_one"), "period")
        .when(strip_accents(F.col("label")).rlike(pattern(DURATION_ONLY)), "duration")
        .when(F.col("labels"), "label")
        .otherwise("other")
    )
    return rows.withColumn("sort", sort).drop("has_one")


def job_stints(lines: DataFrame, periods: DataFrame) -> DataFrame:
    """``(doc_id, pos, label, company, start_ym, end_ym, quote, idx, line_no)`` for periods with a label.

    Of up to two label lines right above a period (lines that only state a
    duration are skipped) the nearer is the role, the farther the company,
    which holds for later periods until a blank line.  Else what stands beside
    the period is the label, else the role, else a label line below.  A company
    is never guessed.
    """
    classed = classed_lines(lines)
    below = F.lead(F.struct("label", "labels")).over(by_line())
    end = F.coalesce(F.lead("start_off").over(by_line()), F.lit(2**31 - 1))
    blanks = F.sum((F.col("sort") == "blank").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = classed.withColumns({"below": below, "stop_off": end, "blanks": blanks}).where("sort <> 'duration'")
    above = lambda n: F.lag(F.struct("sort", "label"), n).over(by_line())
    role = F.when(above(1)["sort"] == "label", above(1)["label"])
    firm = F.when(role.isNotNull() & (above(2)["sort"] == "label"), above(2)["label"])
    rows = rows.withColumns({"role": role, "firm": firm}).where("sort = 'period'")
    at = periods.alias("p").join(
        rows.alias("l"), (F.col("p.doc_id") == F.col("l.doc_id")) & (F.col("p.idx") >= F.col("l.start_off")) & (F.col("p.idx") < F.col("l.stop_off"))
    )
    at = at.select("p.*", "l.line", "l.line_no", "l.role", "l.firm", "l.below", "l.blanks")
    since_blank = Window.partitionBy("doc_id", "blanks").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumns({"beside": same_line_label(F.col("line"), F.col("quote")), "held": F.last("firm", ignorenulls=True).over(since_blank)})
    company = F.when(F.col("firm").isNotNull(), F.col("firm")).when(F.col("beside").isNull() & F.col("role").isNotNull(), F.col("held"))
    under = F.when(F.col("below.labels"), F.col("below.label"))
    label = (
        F.when(F.col("firm").isNotNull(), F.concat_ws(" — ", "firm", "role", "beside"))
        .when(F.col("beside").isNotNull(), F.concat_ws(" — ", "role", "beside"))
        .when(F.col("role").isNotNull(), F.concat_ws(" — ", "held", "role"))
        .otherwise(under)
    )
    found = at.withColumns({"company": company, "label": label}).where(F.col("label").isNotNull() & (F.col("label") != ""))
    return found.select("doc_id", "pos", "label", "company", "start_ym", "end_ym", "quote", "idx", "line_no")
