import random

import pytest
from pyspark.sql import functions as F

from spanlens.operators import intervals
from spanlens.operators.periods import format_duration, period_rows
from tests.helpers import docs

NOW = 2026 * 12 + 7


def ym(year, month):
    return year * 12 + month - 1


GOOD = [
    ("08/2013 - 06/2017", ym(2013, 8), ym(2017, 6), "month"),
    ("01/10/2015 – 01/10/2016", ym(2015, 10), ym(2016, 10), "month"),
    ("março de 2020 a junho de 2021", ym(2020, 3), ym(2021, 6), "month"),
    ("Mar 2012 — Dec 2013", ym(2012, 3), ym(2013, 12), "month"),
    ("set/2019 até fev/2020", ym(2019, 9), ym(2020, 2), "month"),
    ("January 2018 to Present", ym(2018, 1), None, "month"),
    ("01/2018 - em andamento", ym(2018, 1), None, "month"),
    ("01/07/2017 ATE 01/03/2019", ym(2017, 7), ym(2019, 3), "month"),
    ("2012 a 2021", ym(2012, 1), ym(2021, 12), "year"),
    ("2015 - atual", ym(2015, 1), None, "year"),
]
BAD = ["2010/2011 - 2011/2012", "06/2017 - 08/2013", "13/2020 - 14/2021", "1200 - 1300", "ArcelorMittal 2012", "", "sem data"]


def test_periods(spark):
    texts = [f"Antes\n{g[0]}, depois" for g in GOOD]
    rows = period_rows(docs(spark, *texts)).collect()
    assert sorted((r.doc_id, r.start_ym, r.end_ym, r.precision) for r in rows) == [(i, *g[1:]) for i, g in enumerate(GOOD)]
    for r in rows:
        assert texts[r.doc_id][r.idx : r.idx + len(r.quote)] == r.quote


def test_no_periods(spark):
    assert period_rows(docs(spark, *BAD, None)).collect() == []


def test_durations_in_words(spark):
    said = [r.v for r in spark.createDataFrame([(0,), (1,), (12,), (25,), (36,)], "n int").select(format_duration(F.col("n")).alias("v")).collect()]
    assert said == ["menos de um mês", "1 mês", "1 ano", "2 anos e 1 mês", "3 anos"]


def frame(spark, periods):
    return spark.createDataFrame([(d, p, s, e) for d, p, s, e in periods], "doc_id long, pos int, start_ym int, end_ym int")


@pytest.mark.parametrize("seed", range(3))
def test_algebra_equals_month_sets(spark, seed):
    rng = random.Random(seed)
    periods = []
    for d in range(30):
        for p in range(rng.randint(0, 8)):
            s = rng.randint(NOW - 120, NOW - 1)
            periods.append((d, p, s, rng.choice([None, s, s + rng.randint(0, 40)])))
    rows = frame(spark, periods)
    end = lambda e: NOW if e is None else e
    months = {d: set() for d, *_ in periods}
    for d, _, s, e in periods:
        months[d].update(range(s, end(e) + 1))
    assert {r.doc_id: r.total_months for r in intervals.total_months(rows, NOW).collect()} == {d: len(m) for d, m in months.items()}
    pairs = []
    for d, p, s, e in periods:
        for d2, p2, s2, e2 in periods:
            if d == d2 and (s, p) < (s2, p2):
                n = min(end(e), end(e2)) - s2 + 1
                if n >= 2:
                    pairs.append((d, p, p2, n))
    assert sorted((r.doc_id, r.a_pos, r.b_pos, r.months) for r in intervals.overlaps(rows, NOW).collect()) == sorted(pairs)
    gaps = []
    for d, m in months.items():
        line = sorted(m)
        gaps += [(d, b - a) for a, b in zip(line, line[1:]) if b - a >= 4]
    assert sorted((r.doc_id, r.months) for r in intervals.gaps(rows, NOW).collect()) == sorted(gaps)


def test_timeline(spark):
    rows = frame(spark, [(1, 0, ym(2015, 1), ym(2018, 1)), (1, 1, ym(2019, 1), ym(2021, 1))])
    assert intervals.timeline_span(rows, NOW).first().months == 72
    bars = [(r.left_pct, round(r.width_pct, 2), r.months) for r in intervals.timeline_bars(rows, NOW).orderBy("ord").collect()]
    assert bars == [(0.0, 50.0, 37), (pytest.approx(66.666, abs=0.01), 33.33, 25)]
    assert [(r.row_kind, r.short) for r in intervals.timeline_rows(rows, NOW).orderBy("ord").collect()] == [("bar", "3a 1m"), ("gap", "1a"), ("bar", "2a 1m")]
    none = frame(spark, [])
    assert all(f(none, NOW).collect() == [] for f in (intervals.gaps, intervals.overlaps, intervals.total_months, intervals.timeline_rows))


def test_short_and_ongoing(spark):
    rows = frame(spark, [(1, 0, NOW - 2, None), (1, 1, ym(2016, 1), ym(2016, 5)), (1, 2, ym(2016, 1), ym(2018, 1))])
    assert sorted(r.months for r in intervals.with_duration(rows, NOW).collect()) == [3, 5, 25]
    assert [r.pos for r in intervals.short_tenures(rows, NOW).collect()] == [1]


