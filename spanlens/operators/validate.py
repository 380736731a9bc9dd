"""Answers of a model against closed lists of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import pattern, trim

#: The fields, how they are labelled, and what they may hold.
LEVELS = ("Júnior", "Pleno", "Sênior", "Especialista", "Gestor", "Diretor")
DISTANCES = ("nenhuma", "meio degrau", "um degrau", "dois ou mais")
FIELDS = (
    ("Nível comprovado", r"(?:NIVEL_COMPROVADO|N[íi]vel comprovado[^:\n]*)\s*:", LEVELS),
    ("Nível prometido", r"(?:NIVEL_PROMETIDO|N[íi]vel (?:que o documento|prometido)[^:\n]*)\s*:", LEVELS),
    ("Distância", r"(?:DISTANCIA|Dist[âa]ncia(?: entre os dois)?)\s*:", DISTANCES),
)
RULE, ABSENT = "D7 enum de nível", "campo ausente na saída"


def value_after(output: Column, label: str) -> Column:
    """What follows the first match of a label: bold text, or text up to a full stop or line end."""
    parts = F.split(output, pattern(label), 2)
    rest = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(1)), r"\A\*{1,2}", ""), r"\A[ \t]+", "")
    bold = r"\A\*\*([^\n\r\u2028\u2029]+?)\*\*"
    raw = F.when(rest.rlike(bold), F.regexp_extract(rest, bold, 1)).otherwise(F.regexp_extract(rest, r"\A[^.\n]*", 0))
    value = F.regexp_replace(trim(F.regexp_replace(raw, "[*_`]", "")), r"\.\z", "")
    return F.when(F.size(parts) > 1, value)


def _same(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), pattern(r"\s+"), " ")


def level_field_violations(outputs: DataFrame) -> DataFrame:
    """``(doc_id, rule, field, quote, detail)`` of ``(doc_id, output)``: fields absent or off the list."""
    checks = [
        F.struct(F.lit(field).alias("field"), F.coalesce(value_after(F.col("output"), label), F.lit("")).alias("value"), F.array(*[F.lit(v) for v in allowed]).alias("allowed"))
        for field, label, allowed in FIELDS
    ]
    rows = outputs.select("doc_id", F.explode(F.array(*checks)).alias("c")).select("doc_id", "c.*")
    known = F.exists("allowed", lambda ok: _same(ok) == _same(F.col("value")))
    off = F.concat(F.lit("valor fora do enum: "), F.array_join("allowed", " | "))
    found = rows.where((F.col("value") == "") | ~known)
    return found.select("doc_id", F.lit(RULE).alias("rule"), "field", F.col("value").alias("quote"), F.when(F.col("value") == "", ABSENT).otherwise(off).alias("detail"))
