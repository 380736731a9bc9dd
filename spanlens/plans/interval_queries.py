"""Queries on periods: from columns, and from text that was rendered from them.

The SQL computes periods from the tables' columns alone, so where a query reads
them back from text, the whole way through the text is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.operators import intervals
from spanlens.operators.periods import format_duration, format_month, parse_token
from spanlens.plans.career import NOW_YM, career_documents, order_periods, table
from spanlens.plans.engine import Analysis

COLUMNS = ["doc_id", "pos", "start_ym", "end_ym"]


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_periods(spark, sf_dir).select(*COLUMNS)


def _parsed(spark: SparkSession, sf_dir: str, keep: bool = False) -> Analysis:
    """Analysis of the rendered text; ``keep`` where several branches share relations."""
    return Analysis(career_documents(spark, sf_dir), NOW_YM, keep=keep)


def parse_periods(spark, sf_dir):
    return _parsed(spark, sf_dir).periods.select("doc_id", "pos", "start_ym", "end_ym", "precision")


def periods_chrono(spark, sf_dir):
    return intervals.chronological(_periods(spark, sf_dir)).select("doc_id", "pos", "seq")


def career_gaps(spark, sf_dir):
    return intervals.gaps(_periods(spark, sf_dir), NOW_YM)


def period_overlaps(spark, sf_dir):
    return intervals.overlaps(_periods(spark, sf_dir), NOW_YM).select("doc_id", "a_pos", "b_pos", "months")


def short_tenures(spark, sf_dir):
    return intervals.short_tenures(_periods(spark, sf_dir), NOW_YM).select("doc_id", "pos", "months")


def total_experience(spark, sf_dir):
    return _parsed(spark, sf_dir).totals


def next_period_delta(spark, sf_dir):
    return intervals.next_delta(_periods(spark, sf_dir))


def duration_months(spark, sf_dir):
    return intervals.with_duration(_periods(spark, sf_dir), NOW_YM).select("doc_id", "pos", "months")


def months_between(spark, sf_dir):
    """Months from an order's month to each of its lines' shipment, and both months in words."""
    ym = lambda c: (F.year(c) * 12 + F.month(c) - 1).cast("int")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_orderkey", "l_linenumber", ym("o_orderdate").alias("a"), ym("l_shipdate").alias("b"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("b") - F.col("a")).alias("months"), format_month(F.col("a")).alias("from_month"), format_month(F.col("b")).alias("to_month"))


def format_durations(spark, sf_dir):
    rows = intervals.with_duration(_periods(spark, sf_dir), NOW_YM)
    return rows.select("doc_id", "pos", format_duration(F.col("months")).alias("said"), format_duration(F.col("months") - 1).alias("said_less"))


def parse_tokens(spark, sf_dir):
    """Dates of all orders in five written forms, read back."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))
    pt = F.array(*[F.lit(x) for x in ("janeiro", "fev.", "Março", "ABRIL", "mai", "junho", "Jul", "agosto", "set", "outubro", "nov", "dezembro")])
    en = F.array(*[F.lit(x) for x in ("January", "feb", "March", "apr.", "May", "june", "jul", "August", "sept", "Oct", "november", "DEC")])
    forms = F.array(
        F.format_string("%02d/%02d/%d", "d", "m", "y"),
        F.format_string("%d/%d", "m", "y"),
        F.concat(F.element_at(pt, F.col("m")), F.lit(" de "), F.col("y").cast("string")),
        F.concat(F.element_at(en, F.col("m")), F.lit(" "), F.col("y").cast("string")),
        F.col("y").cast("string"),
        F.format_string("%d/%d", F.col("m") + 12, F.col("y")),
        F.concat(F.lit("0"), F.col("d").cast("string"), F.lit("00")),
    )
    rows = rows.select("o_orderkey", F.posexplode(forms).alias("form", "token"))
    read = rows.withColumn("p", parse_token(F.col("token")))
    return read.select("o_orderkey", "form", F.col("p.ym").alias("ym"), F.col("p.precision").alias("precision"))


def timeline_bars(spark, sf_dir):
    rows = intervals.timeline_bars(_periods(spark, sf_dir), NOW_YM)
    return rows.select("doc_id", "ord", "pos", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct"), "months")


def timeline_gaps(spark, sf_dir):
    rows = intervals.timeline_gaps(_periods(spark, sf_dir), NOW_YM)
    return rows.select("doc_id", "ord", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct"), "months")


def timeline_rows(spark, sf_dir):
    rows = intervals.timeline_rows(_periods(spark, sf_dir), NOW_YM)
    return rows.select("doc_id", "ord", "row_kind", F.round("left_pct", 6).alias("left_pct"), "months", "short")


def job_stints(spark, sf_dir):
    return _parsed(spark, sf_dir, keep=True).stints.select("doc_id", "pos", "label", "company", "start_ym", "end_ym")


def marker_rows(spark, sf_dir):
    return intervals.marker_rows(_parsed(spark, sf_dir, keep=True).stints, NOW_YM)


def missing_metrics(spark, sf_dir):
    return _parsed(spark, sf_dir, keep=True).missing_metrics.select("doc_id", "ord", "quote", "label")


def metric_cards(spark, sf_dir):
    from spanlens.operators.metrics import metric_cards as cards

    rows = cards(_parsed(spark, sf_dir, keep=True).missing_metrics)
    return rows.groupBy("doc_id").agg(F.sum(F.col("shown").cast("long")).alias("n_shown"), F.sum((~F.col("shown")).cast("long")).alias("n_rest"))


def silent_stints(spark, sf_dir):
    return _parsed(spark, sf_dir, keep=True).silent_stints.select("doc_id", "pos", "label")


QUERIES = {
    "parse_periods": parse_periods,
    "parse_token": parse_tokens,
    "months_between": months_between,
    "duration_months": duration_months,
    "periods_chrono": periods_chrono,
    "career_gaps": career_gaps,
    "period_overlaps": period_overlaps,
    "short_tenures": short_tenures,
    "total_experience": total_experience,
    "next_period_delta": next_period_delta,
    "format_duration": format_durations,
    "timeline_bars": timeline_bars,
    "timeline_gaps": timeline_gaps,
    "timeline_rows": timeline_rows,
    "job_stints": job_stints,
    "marker_rows": marker_rows,
    "missing_metrics": missing_metrics,
    "metric_cards": metric_cards,
    "silent_stints": silent_stints,
}

#: ``o`` orders with their months, ``p`` periods as `order_periods`, ``c`` with the latest end so far.
PERIODS = """
WITH o AS (
  SELECT o_custkey AS doc_id, o_orderkey, o_orderstatus, o_orderpriority, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS s, greatest(e0, year(o_orderdate) * 12 + month(o_orderdate) - 1) AS e
  FROM orders JOIN (SELECT l_orderkey, max(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS e0 FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey),
p AS (
  SELECT doc_id, o_orderkey, o_orderstatus, o_orderpriority, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
    CAST(CASE WHEN o_orderkey % 13 = 0 THEN (s // 12) * 12 ELSE s END AS INTEGER) AS start_ym,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN (e // 12) * 12 + 11 ELSE e END AS INTEGER) AS end_ym,
    o_orderkey % 13 = 0 AS years_only
  FROM o),
q AS (SELECT *, coalesce(end_ym, 24319) AS till FROM p),
c AS (SELECT *, max(till) OVER (PARTITION BY doc_id ORDER BY start_ym, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered,
        row_number() OVER (PARTITION BY doc_id ORDER BY start_ym, pos) AS seq,
        min(start_ym) OVER (PARTITION BY doc_id) AS from_ym, greatest(1, max(till) OVER (PARTITION BY doc_id) - min(start_ym) OVER (PARTITION BY doc_id)) AS span FROM q),
g AS (SELECT doc_id, covered AS gap_from, start_ym AS gap_to, start_ym - covered AS months, from_ym, span FROM c WHERE start_ym - covered >= 4),
st AS (
  SELECT *, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Companhia Urgente' WHEN '2' THEN 'Companhia Alta' WHEN '3' THEN 'Companhia Media' WHEN '4' THEN 'Companhia Comum' ELSE 'Companhia Baixa' END AS company,
    'Analista ' || o_orderstatus AS role FROM q)
"""
_SAY = """CASE WHEN {n} // 12 > 0 AND {n} % 12 > 0 THEN concat({y}, ' e ', {m}) WHEN {n} // 12 > 0 THEN {y} WHEN {n} % 12 > 0 THEN {m} ELSE 'menos de um mês' END"""


def said_sql(n: str) -> str:
    """A duration in words, in SQL."""
    y = f"(CAST({n} // 12 AS VARCHAR) || CASE WHEN {n} // 12 = 1 THEN ' ano' ELSE ' anos' END)"
    m = f"(CAST({n} % 12 AS VARCHAR) || CASE WHEN {n} % 12 = 1 THEN ' mês' ELSE ' meses' END)"
    return _SAY.format(n=n, y=y, m=m)


_MONTH = "(lpad(CAST({0} % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST({0} // 12 AS VARCHAR))"
_BAR = "round((start_ym - from_ym) / span * 100, 6) AS left_pct, round(greatest(1.0, (till - start_ym) / span * 100), 6) AS width_pct, CAST(greatest(0, till - start_ym + 1) AS INTEGER) AS months"
_SHORT = "CASE WHEN months < 1 THEN '<1m' ELSE concat_ws(' ', CASE WHEN months // 12 > 0 THEN CAST(months // 12 AS VARCHAR) || 'a' END, CASE WHEN months % 12 > 0 THEN CAST(months % 12 AS VARCHAR) || 'm' END) END"

ORACLE_SQL = {
    "parse_periods": PERIODS + "SELECT doc_id, pos, start_ym, end_ym, CASE WHEN years_only THEN 'year' ELSE 'month' END AS precision FROM p",
    "parse_token": """
SELECT o_orderkey, CAST(form AS INTEGER) AS form,
  CAST(CASE WHEN form < 4 THEN year(o_orderdate) * 12 + month(o_orderdate) - 1 WHEN form = 4 THEN year(o_orderdate) * 12 END AS INTEGER) AS ym,
  CASE WHEN form < 4 THEN 'month' WHEN form = 4 THEN 'year' END AS precision
FROM orders, range(7) AS f(form)""",
    "months_between": f"""
SELECT l_orderkey, l_linenumber, CAST(b - a AS INTEGER) AS months, {_MONTH.format('a')} AS from_month, {_MONTH.format('b')} AS to_month
FROM (SELECT l_orderkey, l_linenumber, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS a, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "duration_months": PERIODS + "SELECT doc_id, pos, CAST(greatest(0, till - start_ym + 1) AS INTEGER) AS months FROM q",
    "periods_chrono": PERIODS + "SELECT doc_id, pos, CAST(seq AS INTEGER) AS seq FROM c",
    "career_gaps": PERIODS + "SELECT doc_id, CAST(gap_from AS INTEGER) AS from_ym, CAST(gap_to AS INTEGER) AS to_ym, CAST(months AS INTEGER) AS months FROM g",
    "period_overlaps": PERIODS + """
SELECT a.doc_id, a.pos AS a_pos, b.pos AS b_pos, CAST(least(a.till, b.till) - b.start_ym + 1 AS INTEGER) AS months
FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.seq < b.seq WHERE least(a.till, b.till) - b.start_ym + 1 >= 2""",
    "short_tenures": PERIODS + "SELECT doc_id, pos, CAST(end_ym - start_ym + 1 AS INTEGER) AS months FROM p WHERE end_ym IS NOT NULL AND end_ym - start_ym + 1 < 12",
    "total_experience": PERIODS + """
SELECT doc_id, CAST(sum(greatest(0, CASE WHEN covered IS NULL OR start_ym > covered THEN till - start_ym + 1 ELSE till - covered END)) AS INTEGER) AS total_months FROM c GROUP BY doc_id""",
    "next_period_delta": PERIODS + """
SELECT doc_id, pos, CAST(months AS INTEGER) AS months FROM (SELECT doc_id, pos, lead(start_ym) OVER (PARTITION BY doc_id ORDER BY start_ym, pos) - end_ym AS months FROM p) WHERE months > 0""",
    "format_duration": PERIODS + f"""
SELECT doc_id, pos, {said_sql('n')} AS said, {said_sql('(n - 1)')} AS said_less FROM (SELECT doc_id, pos, greatest(0, till - start_ym + 1) AS n FROM q)""",
    "timeline_bars": PERIODS + f"SELECT doc_id, CAST(seq AS INTEGER) AS ord, pos, {_BAR} FROM c",
    "timeline_gaps": PERIODS + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY gap_from, gap_to) AS INTEGER) AS ord, round((gap_from - from_ym) / span * 100, 6) AS left_pct,
  round(greatest(1.0, months / span * 100), 6) AS width_pct, CAST(months AS INTEGER) AS months FROM g""",
    "timeline_rows": PERIODS + f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l, row_kind, k) AS INTEGER) AS ord, row_kind, round(l, 6) AS left_pct, CAST(months AS INTEGER) AS months, {_SHORT} AS short FROM (
  SELECT doc_id, 'bar' AS row_kind, (start_ym - from_ym) / span * 100 AS l, greatest(0, till - start_ym + 1) AS months, seq AS k FROM c
  UNION ALL SELECT doc_id, 'gap', (gap_from - from_ym) / span * 100, months, row_number() OVER (PARTITION BY doc_id ORDER BY gap_from, gap_to) FROM g)""",
    "job_stints": PERIODS + "SELECT doc_id, pos, company || ' — ' || role AS label, company, start_ym, end_ym FROM st",
    "marker_rows": PERIODS + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS row, company || ' — ' || role AS label, end_ym IS NULL AS loop, n AS seconds, -n / 2 AS delay
FROM (SELECT *, least(40.0::DOUBLE, greatest(10.0::DOUBLE, greatest(0, till - start_ym + 1) / 2)) AS n FROM st)""",
    "missing_metrics": PERIODS + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_ym DESC, pos) AS INTEGER) AS ord, 'Coordenei a equipe de atendimento da regional durante todo o projeto.' AS quote, company || ' — ' || role AS label
FROM st WHERE o_orderkey % 4 = 1""",
    "metric_cards": PERIODS + "SELECT doc_id, CAST(least(7, count(*)) AS BIGINT) AS n_shown, CAST(greatest(0, count(*) - 7) AS BIGINT) AS n_rest FROM st WHERE o_orderkey % 4 = 1 GROUP BY doc_id",
    "silent_stints": PERIODS + "SELECT doc_id, pos, company || ' — ' || role AS label FROM st WHERE o_orderkey % 4 >= 2",
}
