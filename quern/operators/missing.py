"""Missing data. NaN in floating-point columns counts as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(frame: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column."""
    floats = [f.name for f in frame.schema if f.dataType.typeName() in ("double", "float")]
    return frame.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats}) if floats else frame


def isna(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.coalesce(F.isnan(c.try_cast("double")), F.lit(False))


def notna(c) -> Column:
    return ~isna(c)


def fillna(frame: DataFrame, value) -> DataFrame:
    """A scalar for all columns of its type, or a value per column."""
    return frame.na.fill(value)


def dropna(frame: DataFrame, how: str = "any", thresh: int | None = None, subset: list[str] | None = None) -> DataFrame:
    return frame.na.drop(how, thresh, subset)


def replace(frame: DataFrame, to_replace, value=None, subset: list[str] | None = None) -> DataFrame:
    return frame.na.replace(to_replace, value, subset) if not isinstance(to_replace, dict) else frame.na.replace(to_replace, subset=subset)


def replace_regex(frame: DataFrame, column: str, pattern: str, value: str) -> DataFrame:
    return frame.withColumn(column, F.regexp_replace(column, pattern, value))


def where(cond: Column, c: Column, other=None) -> Column:
    """The value where the condition is true, else the other."""
    return F.when(F.coalesce(cond, F.lit(False)), c).otherwise(other)


def mask(cond: Column, c: Column, other=None) -> Column:
    return where(~F.coalesce(cond, F.lit(False)), c, other)
