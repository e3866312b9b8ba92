"""Group-by operators. Rows with a missing key are in no group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def skew(c) -> Column:
    """Bias-corrected skewness."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def kurt(c) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def _bool(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("boolean")


#: Reductions by name: of a group, a frame, or a window.
REDUCE = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "size": lambda c: F.count(F.lit(1)),
    "mean": F.avg,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "all": lambda c: F.bool_and(_bool(c)),
    "any": lambda c: F.bool_or(_bool(c)),
    "skew": skew,
    "kurt": kurt,
    "kurtosis": kurt,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "nunique": F.count_distinct,
    "median": lambda c: F.percentile(c, 0.5),
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def present(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that have all keys."""
    for k in keys:
        frame = frame.filter(F.col(k).isNotNull())
    return frame


def agg(frame: DataFrame, keys: list[str], **named) -> DataFrame:
    """One row per group: name=(column, reduction) with a reduction's name or a function of a column."""
    out = []
    for name, (column, how) in named.items():
        out.append((REDUCE[how] if isinstance(how, str) else how)(column).alias(name))
    return present(frame, keys).groupBy(*keys).agg(*out)


def grouping_sets(frame: DataFrame, keys: list[str], mode: str, **named) -> DataFrame:
    """Rollup or cube."""
    make = frame.rollup if mode == "rollup" else frame.cube
    return make(*keys).agg(*[REDUCE[how](column).alias(name) for name, (column, how) in named.items()])


def transform(frame: DataFrame, keys: list[str], **named) -> DataFrame:
    """The frame with each group's reduction beside its rows."""
    w = Window.partitionBy(*keys)
    out = present(frame, keys)
    for name, (column, how) in named.items():
        c = F.size(F.collect_set(column).over(w)) if how == "nunique" else _over(REDUCE[how], column, w)
        out = out.withColumn(name, c)
    return out


def _over(reduction, column, w) -> Column:
    if reduction is skew:
        n = F.count(column).over(w).cast("double")
        return F.when(n > 2, F.skewness(column).over(w) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    if reduction is kurt:
        n = F.count(column).over(w).cast("double")
        return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column).over(w) + 6))
    simple = {REDUCE["sum"]: lambda: F.coalesce(F.sum(column).over(w), F.lit(0)), REDUCE["prod"]: lambda: F.coalesce(F.product(column).over(w), F.lit(1.0)), REDUCE["sem"]: lambda: F.stddev_samp(column).over(w) / F.sqrt(F.count(column).over(w))}
    return simple[reduction]() if reduction in simple else reduction(column).over(w)


def _running(keys, order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def cumulative(frame: DataFrame, keys: list[str], order: list, **named) -> DataFrame:
    """Running sum, prod, max, min or count in order within each group."""
    w = _running(keys, order)
    fs = {"cumsum": F.sum, "cumprod": F.product, "cummax": F.max, "cummin": F.min}
    out = present(frame, keys)
    for name, (column, how) in named.items():
        if how == "cumcount":
            out = out.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
        else:
            out = out.withColumn(name, F.when(F.col(column).isNotNull(), fs[how](column).over(w)))
    return out


def fill(frame: DataFrame, keys: list[str], order: list, column: str, method: str = "ffill") -> Column:
    """The last (next) present value of the group."""
    if method == "ffill":
        return F.last(column, ignorenulls=True).over(_running(keys, order))
    return F.first(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))


def head(frame: DataFrame, keys: list[str], order: list, n: int = 5) -> DataFrame:
    """First n rows of each group; all but the last -n if negative."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = present(frame, keys).withColumn("__n", F.row_number().over(w))
    if n < 0:
        out = out.withColumn("__c", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("__n") <= F.col("__c") + n).drop("__c")
    else:
        out = out.filter(F.col("__n") <= n)
    return out.drop("__n")


def tail(frame: DataFrame, keys: list[str], order: list, n: int = 5) -> DataFrame:
    return head(frame, keys, [_reverse(c) for c in order], n)


def _reverse(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc()


def nth(frame: DataFrame, keys: list[str], order: list, n: int | list[int], dropna: str | None = None) -> DataFrame:
    """The rows at places n of each group, from the end if negative."""
    places = [n] if isinstance(n, int) else n
    if dropna:
        frame = frame.na.drop(how=dropna)
    w, r = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*[_reverse(c) for c in order])
    out = present(frame, keys).withColumn("__a", F.row_number().over(w) - 1)
    cond = F.col("__a").isin([p for p in places if p >= 0])
    if any(p < 0 for p in places):
        out = out.withColumn("__b", -F.row_number().over(r))
        cond = cond | F.col("__b").isin([p for p in places if p < 0])
    return out.filter(cond).drop("__a", "__b")


def sample(frame: DataFrame, keys: list[str], n: int | None = None, frac: float | None = None, seed: int = 0, tie: str | None = None) -> DataFrame:
    """n rows of each group, or a share, chosen by a hash of a key column (`tie`) or at random."""
    draw = F.xxhash64(tie, F.lit(seed)) if tie else F.rand(seed)
    w = Window.partitionBy(*keys).orderBy(draw, *([tie] if tie else []))
    out = present(frame, keys).withColumn("__n", F.row_number().over(w))
    if n is None:
        out = out.withColumn("__c", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("__n") <= F.round(F.col("__c") * frac)).drop("__c")
    else:
        out = out.filter(F.col("__n") <= n)
    return out.drop("__n")


def rank(keys: list[str], order: list, method: str = "average", pct: bool = False) -> Column:
    """Rank in order within each group; ties share their average, least, largest or dense rank, or are ranked as they come."""
    w = Window.partitionBy(*keys).orderBy(*order)
    tie = Window.partitionBy(*keys, *order)
    low = F.rank().over(w).cast("double")
    value = {"min": low, "dense": F.dense_rank().over(w).cast("double"), "first": F.row_number().over(w).cast("double"), "max": low + F.count("*").over(tie) - 1, "average": low + (F.count("*").over(tie) - 1) / 2}[method]
    return value / F.count("*").over(Window.partitionBy(*keys)) if pct else value


def apply(frame: DataFrame, keys: list[str], func, schema: str) -> DataFrame:
    """A function of each group as a pandas frame, that returns a frame, or one row as a tuple, or a value.

    Groups come in order in batches that hold many of them, as a batch for each group costs more than most functions.
    """
    rows = present(frame, keys).repartition(*keys).sortWithinPartitions(*keys)
    names = list(rows.columns)
    out = [f.name for f in T._parse_datatype_string(schema)]

    def edges(pdf):
        """Where groups begin: NaN equals NaN."""
        new = np.zeros(len(pdf), bool)
        for k in keys:
            c = pdf[k]
            before = c.shift()
            new |= ((c != before) & ~(c.isna() & before.isna())).to_numpy(bool)
        new[:1] = True
        return np.flatnonzero(new)

    def results(pdf, starts, ends):
        frames, lines = [], []
        for lo, hi in zip(starts, ends, strict=True):
            one = func(pdf.iloc[lo:hi].reset_index(drop=True))
            if isinstance(one, pd.DataFrame):
                frames.append(one)
            else:
                lines.append(one if isinstance(one, tuple) else (one,))
        if lines:
            frames.append(pd.DataFrame(lines, columns=out))
        if frames:
            yield pd.concat(frames, ignore_index=True)

    def run(batches):
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            starts = edges(pd.concat([held[-1].iloc[-1:], pdf])) if held else edges(pdf)
            starts = starts[starts > 0] - 1 if held else starts[1:]
            if not len(starts):
                held.append(pdf)
                continue
            last = starts[-1]
            whole = pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
            yield from results(whole, at := edges(whole), [*at[1:], len(whole)])
            held = [pdf.iloc[last:]]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield from results(whole, [0], [len(whole)])

    return rows.select(names).mapInPandas(run, schema)
