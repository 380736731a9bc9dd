"""Interval algebra over periods: gaps, overlaps, unions, durations, timelines.

All functions take rows ``(doc_id, pos, start_ym, end_ym)``, where a null end runs
to ``now_ym``; order is by start and then ``pos``, so ties are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

GAP_MONTHS, OVERLAP_MONTHS, SHORT_MONTHS = 4, 2, 12
BIN_MONTHS = 12


def by_start() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("start_ym", "pos")


def until(now_ym: int) -> Column:
    return F.coalesce(F.col("end_ym"), F.lit(now_ym))


def duration(start: Column, end: Column) -> Column:
    """Months from start to end, both counted."""
    return F.greatest(F.lit(0), end - start + 1)


def with_duration(periods: DataFrame, now_ym: int) -> DataFrame:
    return periods.withColumn("months", duration(F.col("start_ym"), until(now_ym)))


def chronological(periods: DataFrame) -> DataFrame:
    """Rows with ``seq`` from 1 in order of start."""
    return periods.withColumn("seq", F.row_number().over(by_start()))


def _covered(now_ym: int) -> Column:
    return F.max(until(now_ym)).over(by_start().rowsBetween(Window.unboundedPreceding, -1))


def gaps(periods: DataFrame, now_ym: int, least: int = GAP_MONTHS) -> DataFrame:
    """``(doc_id, from_ym, to_ym, months)`` between the latest end so far and the next start."""
    swept = periods.select("doc_id", _covered(now_ym).alias("from_ym"), F.col("start_ym").alias("to_ym"))
    return swept.withColumn("months", F.col("to_ym") - F.col("from_ym")).where(F.col("months") >= least)


def overlaps(periods: DataFrame, now_ym: int, least: int = OVERLAP_MONTHS) -> DataFrame:
    """``(doc_id, a_pos, b_pos, a_start, b_start, a_end, b_end, months)`` for every two that share ``least`` months.

    The earlier period is dealt to every year it covers and the later one to the
    year it starts in, so pairs meet by document and year, not by document
    alone, and a long history is no single hot key.
    """
    rows = periods.select("doc_id", "pos", "start_ym", F.col("end_ym").alias("own_end"), until(now_ym).alias("end"))
    year = lambda c: F.floor(F.col(c) / BIN_MONTHS)
    a = rows.where("end >= start_ym").select(
        "doc_id", F.col("pos").alias("a_pos"), F.col("start_ym").alias("a_start"), F.col("own_end").alias("a_end"), F.col("end").alias("a_until"),
        F.explode(F.sequence(year("start_ym"), year("end"))).alias("bin"),
    )
    b = rows.select(
        "doc_id", F.col("pos").alias("b_pos"), F.col("start_ym").alias("b_start"), F.col("own_end").alias("b_end"), F.col("end").alias("b_until"), year("start_ym").alias("bin")
    )
    before = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_pos") < F.col("b_pos")))
    months = F.least("a_until", "b_until") - F.col("b_start") + 1
    paired = a.join(b, ["doc_id", "bin"]).where(before & (months >= least))
    return paired.select("doc_id", "a_pos", "b_pos", "a_start", "a_end", "b_start", "b_end", months.alias("months"))


def short_tenures(periods: DataFrame, now_ym: int, most: int = SHORT_MONTHS) -> DataFrame:
    """Ended periods of less than ``most`` months."""
    return with_duration(periods, now_ym).where(F.col("end_ym").isNotNull() & (F.col("months") < most))


def total_months(periods: DataFrame, now_ym: int) -> DataFrame:
    """``(doc_id, total_months)``: months of the union; a shared month counts once, gaps not at all."""
    swept = periods.select("doc_id", "start_ym", until(now_ym).alias("end"), _covered(now_ym).alias("covered"))
    apart = F.col("covered").isNull() | (F.col("start_ym") > F.col("covered"))
    new = F.when(apart, F.col("end") - F.col("start_ym") + 1).otherwise(F.col("end") - F.col("covered"))
    return swept.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), new)).cast("int").alias("total_months"))


def next_delta(periods: DataFrame) -> DataFrame:
    """Months from the end of each period to the start of the very next, where there are any."""
    rows = periods.select("doc_id", "pos", (F.lead("start_ym").over(by_start()) - F.col("end_ym")).alias("months"))
    return rows.where("months > 0")


def _frame(periods: DataFrame, now_ym: int) -> DataFrame:
    return periods.groupBy("doc_id").agg(F.min("start_ym").alias("from_ym"), F.max(until(now_ym)).alias("to_ym"))


def timeline_span(periods: DataFrame, now_ym: int) -> DataFrame:
    """``(doc_id, from_ym, to_ym, months)`` of each document that has periods."""
    return _frame(periods, now_ym).withColumn("months", F.greatest(F.lit(1), F.col("to_ym") - F.col("from_ym")))


def _place(start: Column, end: Column) -> tuple[Column, Column]:
    left = (start - F.col("from_ym")) / F.col("span") * 100
    width = F.greatest(F.lit(1.0), (end - start) / F.col("span") * 100)
    return left.alias("left_pct"), width.alias("width_pct")


def timeline_bars(periods: DataFrame, now_ym: int) -> DataFrame:
    """``(doc_id, ord, pos, left_pct, width_pct, months)``, bars in order of start."""
    whole = Window.partitionBy("doc_id")
    span = F.greatest(F.lit(1), F.max(until(now_ym)).over(whole) - F.min("start_ym").over(whole))
    rows = periods.withColumns({"from_ym": F.min("start_ym").over(whole), "span": span, "ord": F.row_number().over(by_start())})
    months = duration(F.col("start_ym"), until(now_ym)).alias("months")
    return rows.select("doc_id", "ord", "pos", *_place(F.col("start_ym"), until(now_ym)), months)


def timeline_gaps(periods: DataFrame, now_ym: int) -> DataFrame:
    """``(doc_id, ord, left_pct, width_pct, months)`` of the gaps on the same scale."""
    found = gaps(periods, now_ym).withColumnsRenamed({"from_ym": "gap_from", "to_ym": "gap_to"})
    span = timeline_span(periods, now_ym).select("doc_id", "from_ym", F.col("months").alias("span"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("gap_from", "gap_to"))
    rows = found.join(span, "doc_id").withColumn("ord", order)
    return rows.select("doc_id", "ord", *_place(F.col("gap_from"), F.col("gap_to")), "months")


def timeline_rows(periods: DataFrame, now_ym: int) -> DataFrame:
    """Bars and gaps in one relation, in order from the left, with a short duration text."""
    bars = timeline_bars(periods, now_ym).select("doc_id", F.lit("bar").alias("row_kind"), "left_pct", "width_pct", "months", "ord")
    holes = timeline_gaps(periods, now_ym).select("doc_id", F.lit("gap").alias("row_kind"), "left_pct", "width_pct", "months", "ord")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("left_pct", "row_kind", "ord"))
    years, rest = F.floor(F.col("months") / 12), F.col("months") % 12
    short = F.concat_ws(" ", F.when(years > 0, F.concat(years.cast("string"), F.lit("a"))), F.when(rest > 0, F.concat(rest.cast("string"), F.lit("m"))))
    rows = bars.unionByName(holes).withColumn("ord", order)
    return rows.withColumn("short", F.when(short == "", "<1m").otherwise(short))


def marker_rows(stints: DataFrame, now_ym: int) -> DataFrame:
    """One row for each stint: place, whether it still runs, and the length and start of its motion."""
    rows = with_duration(stints, now_ym).withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    length = F.least(F.lit(40.0), F.greatest(F.lit(10.0), F.col("months") / 2))
    return rows.select("doc_id", "row", "label", F.col("end_ym").isNull().alias("loop"), length.alias("seconds"), (-length / 2).alias("delay"))
