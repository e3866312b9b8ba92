"""Union, duplicates and distinct values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concat(frames: list[DataFrame], join: str = "outer", keys: list[str] | None = None) -> DataFrame:
    """All rows of all frames; columns are united or intersected; `keys` name the source of a row."""
    if keys is not None:
        frames = [f.withColumn("key", F.lit(k)) for f, k in zip(frames, keys, strict=True)]
    if join == "inner":
        shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        frames = [f.select(shared) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append(frame: DataFrame, other: DataFrame) -> DataFrame:
    return concat([frame, other])


def concat_columns(left: DataFrame, right: DataFrame, index: list[str], join: str = "outer") -> DataFrame:
    """Side by side on the index columns."""
    return left.join(right, index, {"outer": "full", "inner": "inner", "left": "left"}[join])


def duplicated(frame: DataFrame, subset: list[str], order: list, keep: str | bool = "first", name: str = "duplicated") -> DataFrame:
    """Flags the rows that repeat the subset's values: all but the first or the last, or all."""
    if keep is False:
        return frame.withColumn(name, F.count("*").over(Window.partitionBy(*subset)) > 1)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*subset).orderBy(*(order if keep == "first" else [c.desc() for c in order]))
    return frame.withColumn(name, F.row_number().over(w) > 1)


def drop_duplicates(frame: DataFrame, subset: list[str] | None = None, order: list | None = None, keep: str | bool = "first") -> DataFrame:
    """Without `order`, any row of each group: an aggregation; else the first or last in order, or groups of one."""
    subset = subset or frame.columns
    if order is None and keep is not False:
        return frame.dropDuplicates(subset)
    return duplicated(frame, subset, order or subset, keep, "__dup").filter("NOT __dup").drop("__dup")


def unique(frame: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Distinct values; with `order`, also the place where each is first seen."""
    if order is None:
        return frame.select(column).distinct()
    return frame.groupBy(column).agg(F.min(order).alias("first_seen"))
