"""Periods of time in text, as month ordinals (year x 12 + month - 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import begins, let, pattern, spans, trim

#: Month names of both languages, and the words for a period that still runs.
MONTHS = (
    ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"),
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
)
MORE_MONTHS = {"set": 9, "sept": 9}
NOW_WORDS = "atual|atualmente|presente|present|current|hoje|momento|em andamento"
SEPARATOR = r"(?:\s*[-–—]{1,2}\s*|\s+(?:a|á|à|até|ate|to)\s+)"
LEAST_YEAR, LAST_YEAR = 1950, 2100

MONTH_OF = {form: i for names in MONTHS for i, name in enumerate(names, 1) for form in (name, name[:3])} | MORE_MONTHS
_NAMES = "|".join(sorted(MONTH_OF, key=len, reverse=True))
_SHORT = begins([name[:3] for name in MONTH_OF])
TOKEN = rf"(?<![\d/])(?:\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}/\d{{4}}|(?={_SHORT})(?:{_NAMES})\.?\s*(?:de\s*|/\s*)?\d{{4}}|\d{{4}})(?![\d/])"
PERIOD = rf"({TOKEN}){SEPARATOR}({TOKEN}|{NOW_WORDS})"

PERIOD_TYPE = "array<struct<idx:int,quote:string,start_ym:int,end_ym:int,precision:string>>"


def parse_token(raw: Column) -> Column:
    """``(ym, precision)`` of one date, null where it is none; a bare year counts from January."""
    slashed = pattern(r"\A(?:\d{1,2}/)?(\d{1,2})/(\d{4})$")
    named = pattern(r"\A([a-zà-ÿ]{3,10})\.?\s*(?:de\s*|/\s*)?(\d{4})$")
    table = F.create_map(*[F.lit(x) for pair in MONTH_OF.items() for x in pair])

    def by_name(name: Column) -> Column:
        return F.coalesce(F.try_element_at(table, name), F.try_element_at(table, F.substring(name, 1, 3)))

    def read(token: Column) -> Column:
        number = lambda rule, group: F.when(token.rlike(rule), F.regexp_extract(token, rule, group).try_cast("int"))
        month = F.coalesce(number(slashed, 1), let(F.regexp_extract(token, named, 1), by_name))
        year = F.coalesce(number(slashed, 2), number(named, 2))
        alone = F.when(token.rlike(r"\A\d{4}\z"), token.try_cast("int"))
        return let(F.when(alone.isNull(), F.struct(month.alias("month"), year.alias("year"))), lambda p: dated(p, alone))

    def dated(p: Column, alone: Column) -> Column:
        by_month = F.struct((p["year"] * 12 + p["month"] - 1).alias("ym"), F.lit("month").alias("precision"))
        whole = F.struct((alone * 12).alias("ym"), F.lit("year").alias("precision"))
        return F.when(p["month"].between(1, 12) & p["year"].isNotNull(), by_month).when(alone.between(LEAST_YEAR, LAST_YEAR), whole)

    return let(trim(F.lower(raw)), read)


def periods_of(text: Column) -> Column:
    """All periods of a text, in order of place.

    Bare years widen to whole years; a period without a readable date or that ends
    before it begins is none; one that still runs has no end.
    """
    found = spans(text, pattern(PERIOD), groups=2)
    read = F.transform(
        found,
        lambda s: F.struct(
            s["idx"].alias("idx"), s["quote"].alias("quote"), parse_token(s["g1"]).alias("a"), parse_token(s["g2"]).alias("b"),
            trim(s["g2"]).rlike(pattern(rf"\A(?:{NOW_WORDS})$")).alias("now"),
        ),
    )
    dated = F.transform(
        F.filter(read, lambda s: s["a"].isNotNull() & (s["now"] | s["b"].isNotNull())),
        lambda s: F.struct(
            s["idx"].alias("idx"),
            s["quote"].alias("quote"),
            s["a"]["ym"].alias("start_ym"),
            F.when(~s["now"], s["b"]["ym"] + F.when(s["b"]["precision"] == "year", 11).otherwise(0)).alias("end_ym"),
            F.when((s["a"]["precision"] == "year") | (~s["now"] & (s["b"]["precision"] == "year")), "year").otherwise("month").alias("precision"),
        ),
    )
    return F.filter(dated, lambda p: p["end_ym"].isNull() | (p["end_ym"] >= p["start_ym"])).cast(PERIOD_TYPE)


def has_period(text: Column) -> Column:
    return F.when(text.rlike(r"\d{4}"), F.size(periods_of(text)) > 0).otherwise(False)


def period_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, start_ym, end_ym, quote, idx, precision)``, ``pos`` from 0 in order of place."""
    # outer, as the optimizer would put a plain explode's array into a filter below, where it is computed once more
    rows = docs.select("doc_id", F.posexplode_outer(periods_of(F.col("text"))).alias("pos", "p")).where("pos IS NOT NULL")
    return rows.select("doc_id", "pos", "p.start_ym", "p.end_ym", "p.quote", "p.idx", "p.precision")


def format_month(ym: Column) -> Column:
    """``MM/YYYY``; null for a null month."""
    month = ym % 12 + 1
    zero = F.when((month >= 0) & (month < 10), "0").otherwise("")
    return F.concat(zero, month.cast("string"), F.lit("/"), F.floor(ym / 12).cast("int").cast("string"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def format_duration(n: Column) -> Column:
    """Months in words: years and months, either left out at zero."""
    years, rest = F.floor(n / 12).cast("int"), n % 12
    said = F.concat_ws(" e ", F.when(years > 0, plural(years, "ano", "anos")), F.when(rest > 0, plural(rest, "mês", "meses")))
    return F.when(said == "", "menos de um mês").otherwise(said)


def format_range(start: Column, end: Column) -> Column:
    return F.concat(format_month(start), F.lit(" – "), F.coalesce(format_month(end), F.lit("atual")))
