"""Lengths as people count them, against the limits of profile fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: The most characters of a field.
LIMITS = {"headline": 220, "about": 2600}


@F.pandas_udf(IntegerType())
def _composed_length(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(unicodedata.normalize("NFC", t))).astype("int32")


def char_count(text: Column) -> Column:
    """Code points after composition; only texts beyond ASCII that hold combining marks leave the JVM."""
    combining = text.rlike(r"\p{M}|[\u1100-\u11FF]")
    return F.when(text.isNull(), None).when(combining, _composed_length(F.when(combining, text).otherwise(""))).otherwise(F.char_length(text))


def length_check(rows: DataFrame, text_col: str, field: str | Column) -> DataFrame:
    """Rows with ``length``, ``limit``, ``remaining`` (may be negative) and ``fits``."""
    limit = F.lit(LIMITS[field]) if isinstance(field, str) else F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])[field]
    counted = rows.withColumns({"length": char_count(F.col(text_col)), "limit": limit})
    return counted.withColumns({"remaining": F.col("limit") - F.col("length"), "fits": F.col("length") <= F.col("limit")})
