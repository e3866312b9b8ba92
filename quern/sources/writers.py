"""Table sinks; one file per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_csv(frame: DataFrame, path: str, sep: str = ",", na_rep: str = "", header: bool = True, mode: str = "overwrite") -> None:
    frame.write.mode(mode).option("sep", sep).option("nullValue", na_rep).option("header", header).csv(path)


def to_parquet(frame: DataFrame, path: str, partition_cols: list[str] | None = None, compression: str = "snappy", mode: str = "overwrite") -> None:
    writer = frame.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def to_json(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).json(path)


def to_sql(frame: DataFrame, url: str, name: str, if_exists: str = "fail", properties: dict | None = None) -> None:
    frame.write.jdbc(url, name, mode={"fail": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists], properties=properties or {})


def export_shards(frame: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """Parquet shards of at most so many rows."""
    frame.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(path)
