"""User-defined functions on rows, columns, groups and partitions, always on Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_values(c: Column, mapping: dict, default=None) -> Column:
    """Values by a dictionary; missing without an entry."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def map_series(c: Column, func, kind: str) -> Column:
    """A function of each value, called on pandas batches."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(func)

    return run(c)


def applymap(frame: DataFrame, columns: list[str], func, kind: str) -> DataFrame:
    return frame.withColumns({c: map_series(F.col(c), func, kind) for c in columns})


def apply_rows(frame: DataFrame, func, schema: str) -> DataFrame:
    """A function of each row as a pandas series, giving a tuple of the schema's columns."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame([func(pd.Series(r, index=pdf.columns)) for r in pdf.itertuples(index=False, name=None)], columns=names)

    return frame.mapInPandas(run, schema)


def map_chunk(frame: DataFrame, func, schema: str) -> DataFrame:
    """A function of each batch of a partition as a pandas frame."""

    def run(parts):
        for pdf in parts:
            yield func(pdf)

    return frame.mapInPandas(run, schema)


def cartesian_chunk(left: DataFrame, right: DataFrame, func, schema: str, parts: int = 8) -> DataFrame:
    """A function of each pair of a left and a right part as pandas frames."""
    a = left.withColumn("__a", F.pmod(F.xxhash64(*left.columns), F.lit(parts)))
    b = right.withColumn("__b", F.pmod(F.xxhash64(*right.columns), F.lit(parts)))
    pairs = [F.lit(i) for i in range(parts)]
    a, b = a.withColumn("__b", F.explode(F.array(*pairs))), b.withColumn("__a", F.explode(F.array(*pairs)))
    return a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInPandas(lambda x, y: func(x.drop(columns=["__a", "__b"]), y.drop(columns=["__a", "__b"])), schema)


def rebalance(frame: DataFrame, partitions: int | None = None) -> DataFrame:
    """Even partitions: a number of them, or of the size that adaptive execution aims at."""
    return frame.repartition(partitions) if partitions else frame.hint("rebalance")


def spawn(spark, func, tasks: list, schema: str) -> DataFrame:
    """Runs func(task) for each task on the cluster, one per partition; rows of its results."""
    one = spark.createDataFrame([(i,) for i in range(len(tasks))], "i int").repartition(max(1, len(tasks)), "i")

    def run(parts):
        for pdf in parts:
            for i in pdf["i"]:
                yield pd.DataFrame(func(tasks[i]))

    return one.mapInPandas(run, schema)
