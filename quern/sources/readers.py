"""Table scans. Columns and filters are pushed to the files by the optimiser."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path, names: list[str] | None = None, sep: str = ",", header: bool = True, schema: str | None = None, usecols: list[str] | None = None, nrows: int | None = None, na_values: str = "", compression: str | None = None) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep).option("nullValue", na_values)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    out = reader.csv(path)
    out = out.toDF(*names) if names else out
    out = out.select(usecols) if usecols else out
    return out.limit(nrows) if nrows is not None else out


def read_parquet(spark: SparkSession, path, columns: list[str] | None = None, nrows: int | None = None) -> DataFrame:
    out = spark.read.parquet(*path) if isinstance(path, list) else spark.read.parquet(path)
    out = out.select(columns) if columns else out
    return out.limit(nrows) if nrows is not None else out


def read_json(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_sql_table(spark: SparkSession, url: str, table: str, partition_col: str | None = None, low_limit=None, high_limit=None, num_partitions: int = 8, columns: list[str] | None = None, properties: dict | None = None) -> DataFrame:
    """A database table, in ranges of a column if its limits are given."""
    if partition_col:
        out = spark.read.jdbc(url, table, column=partition_col, lowerBound=low_limit, upperBound=high_limit, numPartitions=num_partitions, properties=properties or {})
    else:
        out = spark.read.jdbc(url, table, properties=properties or {})
    return out.select(columns) if columns else out


def read_sql_query(spark: SparkSession, url: str, sql: str, **kw) -> DataFrame:
    return read_sql_table(spark, url, f"({sql}) AS q", **kw)


def read_sql(spark: SparkSession, url: str, sql: str, **kw) -> DataFrame:
    return (read_sql_query if " " in sql.strip() else read_sql_table)(spark, url, sql, **kw)


def from_pandas(spark: SparkSession, data: pd.DataFrame | pd.Series) -> DataFrame:
    return spark.createDataFrame(data.to_frame() if isinstance(data, pd.Series) else data)


def from_records(spark: SparkSession, rows, columns: list[str] | str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], columns)


def date_range(spark: SparkSession, start: str, end: str | None = None, periods: int | None = None, freq: str = "1 day", inclusive: str = "both") -> DataFrame:
    """Regular timestamps between two ends, or a number of them; each end can be left out."""
    first = F.lit(start).cast("timestamp")
    step = F.expr(f"interval {freq}")
    if end is None:
        out = spark.range(periods).select((first + step * F.col("id").cast("int")).alias("t"))
        return out
    out = spark.range(1).select(F.explode(F.sequence(first, F.lit(end).cast("timestamp"), step)).alias("t"))
    if inclusive in ("right", "neither"):
        out = out.filter(F.col("t") != first)
    if inclusive in ("left", "neither"):
        out = out.filter(F.col("t") != F.lit(end).cast("timestamp"))
    return out
