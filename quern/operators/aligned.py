"""Arithmetic and combination of two frames that are aligned on their index columns.

Rows meet by one full outer join on the index, missing labels included; columns of one side
alone come out missing, or combined with the fill value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import elementwise

ARITHMETIC = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "truediv": elementwise.divide,
    "floordiv": elementwise.floor_divide, "mod": elementwise.mod, "pow": elementwise.power,
}
#: A comparison with a missing value is false, and `ne` true.
COMPARISON = {
    "eq": lambda a, b: F.coalesce(a == b, F.lit(False)), "ne": lambda a, b: F.coalesce(a != b, F.lit(True)), "lt": lambda a, b: F.coalesce(a < b, F.lit(False)),
    "le": lambda a, b: F.coalesce(a <= b, F.lit(False)), "gt": lambda a, b: F.coalesce(a > b, F.lit(False)), "ge": lambda a, b: F.coalesce(a >= b, F.lit(False)),
}


def _met(a: DataFrame, b: DataFrame, index: list[str]) -> tuple[DataFrame, list[Column], DataFrame, DataFrame]:
    left, right = a.alias("left"), b.alias("right")
    same = F.lit(True)
    for k in index:
        same = same & F.col(f"left.{k}").eqNullSafe(F.col(f"right.{k}"))
    there = left.withColumn("__in_left", F.lit(True)).alias("left"), right.withColumn("__in_right", F.lit(True)).alias("right")
    labels = [F.when(F.col("__in_left"), F.col(f"left.{k}")).otherwise(F.col(f"right.{k}")).alias(k) for k in index]
    return there[0].join(there[1], same, "full"), labels, left, right


def combined(a: DataFrame, b: DataFrame, index: list[str], function, fill_value=None) -> DataFrame:
    """function(left, right) of every column; where one side alone is missing, the fill value stands for it."""
    joined, labels, _, _ = _met(a, b, index)
    names = sorted(set(a.columns) | set(b.columns) - set(index))
    out = []
    for c in [n for n in names if n not in index]:
        x = F.col(f"left.{c}") if c in a.columns else F.lit(None).cast(b.schema[c].dataType)
        y = F.col(f"right.{c}") if c in b.columns else F.lit(None).cast(a.schema[c].dataType)
        if fill_value is not None:
            x, y = F.when(x.isNull() & y.isNotNull(), F.lit(fill_value)).otherwise(x), F.when(y.isNull() & x.isNotNull(), F.lit(fill_value)).otherwise(y)
        out.append(function(x, y).alias(c))
    return joined.select(*labels, *out)


def combine_first(a: DataFrame, b: DataFrame, index: list[str]) -> DataFrame:
    """The left values, and where they are missing the right ones."""
    return combined(a, b, index, F.coalesce)


def corrwith(a: DataFrame, b: DataFrame, index: list[str]) -> DataFrame:
    """(column, corr) of the columns that both have, over the rows that both have."""
    joined, _, _, _ = _met(a, b, index)
    both = [c for c in a.columns if c in b.columns and c not in index]
    pairs = joined.filter("__in_left AND __in_right").agg(*[F.corr(f"left.{c}", f"right.{c}").alias(c) for c in both])
    return pairs.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in both]), F.array(*[F.col(f"`{c}`") for c in both]))).alias("column", "corr"))
