"""Type conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def to_numeric(c: Column, errors: str = "raise") -> Column:
    """`coerce` turns what is no number into a missing value; `ignore` keeps the input."""
    if errors == "ignore":
        return F.coalesce(c.try_cast("double").cast("string"), c)
    return c.cast("double") if errors == "raise" else c.try_cast("double")


def to_datetime(c: Column, pattern: str | None = None, errors: str = "raise", unit: str | None = None, origin: str = "1970-01-01") -> Column:
    """Timestamps from strings (a Java pattern) or from counts of a unit since an origin."""
    if unit:
        return F.timestamp_micros((c * _UNITS[unit]).cast("long") + F.unix_micros(F.lit(origin).cast("timestamp")))
    if errors == "coerce":
        return F.try_to_timestamp(c, F.lit(pattern)) if pattern else F.try_to_timestamp(c)
    return F.to_timestamp(c, pattern) if pattern else F.to_timestamp(c)


def astype(frame: DataFrame, types: dict[str, str], errors: str = "raise") -> DataFrame:
    return frame.withColumns({c: F.col(c).cast(t) if errors == "raise" else F.col(c).try_cast(t) for c, t in types.items()})


def select_dtypes(frame: DataFrame, include: list[str]) -> DataFrame:
    kinds = {"number": {"byte", "short", "integer", "long", "float", "double", "decimal"}, "object": {"string"}, "datetime": {"timestamp", "timestamp_ntz", "date"}, "bool": {"boolean"}}
    wanted = set().union(*[kinds.get(k, {k}) for k in include])
    return frame.select([f.name for f in frame.schema if f.dataType.typeName() in wanted])


def category(frame: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Codes of the sorted distinct values, missing ones -1; the dictionary is joined, so it may be large."""
    levels = frame.filter(F.col(column).isNotNull()).select(column).distinct()
    kind = frame.schema[column].dataType.simpleString()
    # zipWithIndex numbers the range-sorted rows by two passes, without a window over all of them.
    ranked = levels.orderBy(column).rdd.zipWithIndex().map(lambda r: (r[0][0], r[1])).toDF(f"`{column}` {kind}, `{code}` long")
    return frame.join(ranked, column, "left").withColumn(code, F.coalesce(code, F.lit(-1)))
