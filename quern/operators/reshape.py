"""Long to wide and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.grouping import REDUCE


def pivot(frame: DataFrame, index: list[str], columns: str, values: str, labels: list) -> DataFrame:
    """One column per label; a repeated cell is an error."""
    cell = F.when(F.count(values) > 1, F.raise_error(F.lit("repeated entry"))).otherwise(F.first(values, ignorenulls=True))
    return frame.groupBy(*index).pivot(columns, labels).agg(cell)


def pivot_table(frame: DataFrame, index: list[str], columns: str, values: str, labels: list, aggfunc: str = "mean", fill_value=None, margins: bool = False) -> DataFrame:
    """Reduced cells by label; with margins, a column and a row `All`."""
    f = REDUCE[aggfunc]

    def cells(groups: list[str], rows: DataFrame) -> DataFrame:
        out = [f(F.when(F.col(columns) == v, F.col(values))).alias(str(v)) for v in labels]
        if aggfunc in ("sum", "prod", "count"):
            out = [F.when(F.count(F.when(F.col(columns) == v, F.col(values))) > 0, c).alias(str(v)) for v, c in zip(labels, out, strict=True)]
        if margins:
            out.append(f(F.when(F.col(columns).isin(labels), F.col(values))).alias("All"))
        return rows.groupBy(*groups).agg(*out)

    out = cells(index, frame)
    if margins:
        total = cells([], frame).select(F.lit("All").alias(index[0]), *[F.lit(None).alias(c) for c in index[1:]], "*")
        out = out.withColumn(index[0], F.col(index[0]).cast("string")).unionByName(total)
    return out.na.fill(fill_value, subset=[c for c in out.columns if c not in index]) if fill_value is not None else out


def melt(frame: DataFrame, ids: list[str], values: list[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    return frame.unpivot(ids, values, var_name, value_name)


def stack(frame: DataFrame, ids: list[str], values: list[str], dropna: bool = True) -> DataFrame:
    out = frame.unpivot(ids, values, "level", "value")
    return out.filter(F.col("value").isNotNull()) if dropna else out


def explode(frame: DataFrame, column: str) -> DataFrame:
    """A row per element; empty and missing lists give one row without a value."""
    return frame.withColumn(column, F.explode_outer(column))


def get_dummies(frame: DataFrame, column: str, labels: list, prefix: str | None = None, drop_first: bool = False, dummy_na: bool = False) -> DataFrame:
    prefix = column if prefix is None else prefix
    out = frame
    for v in labels[1:] if drop_first else labels:
        out = out.withColumn(f"{prefix}_{v}", F.coalesce(F.col(column) == v, F.lit(False)).cast("int"))
    if dummy_na:
        out = out.withColumn(f"{prefix}_nan", F.col(column).isNull().cast("int"))
    return out.drop(column)


def transpose(frame: DataFrame, label: str, labels: list, values: list[str]) -> DataFrame:
    """Rows for columns; the row labels must be given, as they become column names."""
    return frame.unpivot([label], values, "field", "value").groupBy("field").pivot(label, labels).agg(F.first("value"))
