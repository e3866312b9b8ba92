"""Sorting, top-k and positional access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import windows


def sort_values(frame: DataFrame, by: list[str], ascending=True, na_position: str = "last") -> DataFrame:
    """A global range-partitioned sort; missing values go last, or first, whatever the direction."""
    up = ascending if isinstance(ascending, list) else [ascending] * len(by)
    return frame.orderBy(*[direction(c, a, na_position) for c, a in zip(by, up, strict=True)])


def direction(c: str, ascending: bool = True, na_position: str = "last") -> Column:
    c = F.col(c)
    if na_position == "last":
        return c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return c.asc_nulls_first() if ascending else c.desc_nulls_first()


def nlargest(frame: DataFrame, n: int, columns: list[str], keep: str = "first", order: list[str] | None = None, largest: bool = True) -> DataFrame:
    """Top n rows; ties at the end go to the first or last in order, or are all kept."""
    lead = [direction(c, not largest) for c in columns]
    present = frame.na.drop(subset=columns)
    if keep == "all":
        # The n-th row's values bound the result; found by a distributed top-k.
        edge = present.select(*columns).orderBy(*lead).limit(n).agg((F.min if largest else F.max)(F.struct(*columns)).alias("__edge"))
        row = F.struct(*columns)
        return present.join(F.broadcast(edge), row >= F.col("__edge") if largest else row <= F.col("__edge")).drop("__edge")
    tie = [F.col(c) if keep == "first" else F.col(c).desc() for c in order or []]
    return present.orderBy(*lead, *tie).limit(n)


def nsmallest(frame: DataFrame, n: int, columns: list[str], keep: str = "first", order: list[str] | None = None) -> DataFrame:
    return nlargest(frame, n, columns, keep, order, largest=False)


def head(frame: DataFrame, order: list, n: int = 5) -> DataFrame:
    return frame.orderBy(*order).limit(n)


def tail(frame: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return frame.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def idxmax(frame: DataFrame, column: str, label: str, ties: list[str] | None = None, largest: bool = True) -> DataFrame:
    """The label of the (first) largest or smallest value."""
    best = F.max_by if largest else F.min_by
    tie = [-F.col(c) if largest else F.col(c) for c in ties or []]
    return frame.filter(F.col(column).isNotNull()).agg(best(label, F.struct(column, *tie)).alias("label"))


def topk_per_group(frame: DataFrame, keys: list[str], n: int, order: list) -> DataFrame:
    return frame.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def rank_values(frame: DataFrame, column: str, method: str = "average", pct: bool = False, name: str | None = None) -> DataFrame:
    """The frame with the ranks of a column's values (average, min, max or dense) from 1, in its place or beside it; missing values have none.

    Ranks are taken over the distinct values and their counts, and joined to the rows.
    """
    counts = frame.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("__v")).agg(F.count("*").alias("__n")).withColumn("__one", F.lit(1))
    counts = windows.cumulative(counts, "__v", __upto=("__n", "cumsum"), __dense=("__one", "cumsum"))
    first, last = F.col("__upto") - F.col("__n") + 1, F.col("__upto")
    value = {"average": (first + last) / 2, "min": first, "max": last, "dense": F.col("__dense")}[method].cast("double")
    if pct:
        value = value / counts.agg(F.max("__dense" if method == "dense" else "__upto")).first()[0]
    ranks = counts.select(F.col("__v"), value.alias("__rank"))
    out = frame.join(ranks, F.col(f"`{column}`") == F.col("__v"), "left")
    return out.withColumn(name or column, F.col("__rank")).drop("__v", "__rank")
