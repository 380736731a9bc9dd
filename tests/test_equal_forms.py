"""Faster forms of text rules find what the plain rules find."""

import re

from pyspark.sql import functions as F

from spanlens.functions.text import SPACE, begins, pattern, strip_accents, trim
from spanlens.operators import jobs, periods, pii, sections
from spanlens.plans.engine import Analysis
from tests.helpers import docs, one
from tests.test_plans import plan_of

OLD_EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\n[A-Za-z0-9.-]*[A-Za-z]{2,}"


def test_begins_tells_words_by_letter():
    rule = re.compile(begins(["ab", "abc", "b"], "[^\x00-\x7f]"))
    assert [bool(rule.match(x)) for x in ("abx", "ax", "bx", "éx", "aé", "x", "")] == [True, False, True, True, True, False, False]


def test_trim_takes_the_spaces_of_the_pattern(spark):
    some = [chr(c) for c in [*range(1, 0x300), *range(0x1600, 0x2100), 0x3000, 0xFEFF, 0xFF21]]
    want = ["a" if re.fullmatch(SPACE, c) else f"{c}a b{c}" for c in some]
    assert [w.replace("a b", "a") for w in one(spark, trim, *[f"{c}a b{c}" for c in some])] == [w if w == "a" else w.replace("a b", "a") for w in want]


def test_strip_accents_of_plain_and_accented_text(spark):
    assert one(spark, strip_accents, "plain", "Açaí é", "") == ["plain", "Acai e", ""]


def test_headings_are_told_by_their_beginning(spark, monkeypatch):
    firsts = [re.sub(r"s\?", "", x) for _, rule in sections.HEADINGS for x in rule.split("|")]
    accents = str.maketrans("aeiouc", "âéíõúç")
    lines = [form for x in firsts for form in (x, x.upper(), f" | {x.title()}:", x.translate(accents), x[:-1], x + "x", x.replace(" ", "   ")[:1] + "́" + x[1:])]
    lines += ["Companhia Alta", "Analista O", "01/1995 - 07/1996", "", " —• Top   Skills ...", "Knowledge", "Experiência,", "İdiomas"]
    found = one(spark, sections.detect_heading, *lines)
    monkeypatch.setattr(sections, "COULD_OPEN", "")
    assert found == one(spark, sections.detect_heading, *lines)
    assert found.count(None) > 50 and len(found) - found.count(None) > 150


def test_email_pattern_finds_the_same(spark):
    texts = ["a@b.com", "x a.b%c+d@e-f.g.org, y@z", "a@b\nc.com d@e.f\ng@h.io", "a@b@c.de.f1 @x.com _a@b.c2d", "a@b.co.\nuk z@9.9.xyz"]
    new = next(rule for kind, rule, _ in pii.PATTERNS if kind == "email")
    found = lambda rule: one(spark, lambda t: F.regexp_extract_all(t, F.lit(pattern(rule, False)), F.lit(0)), *texts)
    assert found(new) == found(OLD_EMAIL) and len(found(new)[0]) == 1


def test_identity_numbers_are_still_found(spark):
    assert one(spark, pii.redact, "RG: 12.345.678-9", "Urgente", "rg 12345", "RG 1.2") == ["[RG]", "Urgente", "[RG]", "RG 1.2"]


def test_format_month_of_any_month(spark):
    rows = spark.range(-40, 40).union(spark.range(23400, 23430)).select(F.col("id").cast("int").alias("ym"))
    old = F.format_string("%02d/%d", F.col("ym") % 12 + 1, F.floor(F.col("ym") / 12).cast("int"))
    assert rows.where(periods.format_month(F.col("ym")) != old).count() == 0


def test_periods_are_looked_for_once(spark):
    # for four digits, and for the pattern before its matches are cut out
    assert plan_of(docs(spark, "x").select(periods.has_period(F.col("text")))).count("RLIKE(text") == 2
    assert one(spark, periods.has_period, "jan/1995 - atual", "Set. de 2001 a dez 2003", "nov 95", "1995") == [True, True, False, False]


def test_period_pattern_finds_the_same(spark):
    names = [form.translate(str.maketrans("s", "ſ")) for form in periods.MONTH_OF] + [form.upper() for form in periods.MONTH_OF]
    texts = [f"x{'' if i % 3 else ' '}{name}. de 2001 a {name}/2003; 1{name} 1999 - atual" for i, name in enumerate(names)]
    found = lambda rule: one(spark, lambda t: F.regexp_extract_all(t, F.lit(pattern(rule)), F.lit(0)), *texts)
    old = periods.PERIOD.replace(f"(?={periods._SHORT})", "")
    assert old != periods.PERIOD and found(periods.PERIOD) == found(old)
    assert sum(map(len, found(old))) > 50


def test_years_asked_for(spark):
    assert one(spark, jobs.required_years, "Mínimo de 3 anos de experiência", "sem tempo", "10+ anos no setor") == [3, None, 10]


def test_postings_are_filled_and_read_once(spark):
    a = Analysis(docs(spark, "Resumo\nAtuo com dados."), 24319, keep=True)
    posted = spark.createDataFrame([(0, 1, " "), (0, 2, "Mínimo de 3 anos de experiência. Inglês.")], "doc_id long, job_no int, text string")
    contexts = spark.createDataFrame([(0, "ambos", "Analista")], "doc_id long, artifact string, target_role string")
    text = a.jobs_text(contexts, posted)
    # only written tables are read, none of the rows that postings were made of
    assert not [line for line in plan_of(text).splitlines() if "LogicalRDD" in line and "job_no" in line]
    (row,) = text.collect()
    assert "### Vaga 1" in row.jobs and "exige 3 anos" in row.jobs
    a.release()
