"""Joins. Keys match as frame libraries match them: a missing key equals a missing key.

Strategies are left to the optimiser (broadcast by size, sort-merge, runtime filters,
adaptive skew handling); only semantics that SQL joins lack are spelled out here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on=None, left_on=None, right_on=None, suffixes=("_x", "_y"), indicator: bool = False, null_equal: bool = True) -> DataFrame:
    """Equi-join with key coalescing, suffixes for clashing names, and an optional `_merge` column."""
    if how == "cross":
        return cross(left, right, suffixes)
    names = [on] if isinstance(on, str) else list(on) if on else None
    lk = names or ([left_on] if isinstance(left_on, str) else list(left_on))
    rk = names or ([right_on] if isinstance(right_on, str) else list(right_on))
    clash = (set(left.columns) & set(right.columns)) - (set(names) if names else set())
    a = left.select(*[F.col(f"`{c}`").alias(c + suffixes[0] if c in clash else c) for c in left.columns], F.lit(True).alias("__l"))
    b = right.select(*[F.col(f"`{c}`").alias(("__r_" + c) if names and c in names else c + suffixes[1] if c in clash else c) for c in right.columns], F.lit(True).alias("__r"))
    pairs = [((x + suffixes[0] if x in clash else x), ("__r_" + y) if names else (y + suffixes[1] if y in clash else y)) for x, y in zip(lk, rk, strict=True)]
    cond = None
    for x, y in pairs:
        one = a[x].eqNullSafe(b[y]) if null_equal else a[x] == b[y]
        cond = one if cond is None else cond & one
    kind = _HOW[how]
    out = a.join(b, cond, kind)
    if kind in ("left_semi", "left_anti"):
        return out.select(left.columns)
    cols = []
    for c in a.columns[:-1]:
        cols.append(F.coalesce(a[c], b["__r_" + c]).alias(c) if names and c in names and kind in ("right", "full") else a[c])
    cols += [b[c] for c in b.columns[:-1] if not c.startswith("__r_")]
    if indicator:
        cols.append(F.when(a["__l"].isNotNull() & b["__r"].isNotNull(), "both").when(a["__l"].isNotNull(), "left_only").otherwise("right_only").alias("_merge"))
    return out.select(*cols)


#: Rows that a part of a spread join makes, about, and parts of one key at most.
SPREAD_ROWS, MAX_SALTS = 1 << 22, 1 << 10


def spread(left: DataFrame, right: DataFrame, how: str, left_on: str, right_on: str) -> DataFrame:
    """An inner or right join on a key that stands in many rows of both sides: right rows are dealt over parts of each key, and left rows go to each part.

    The rows of each key are counted first, so that a part makes about SPREAD_ROWS rows.
    """
    if how not in ("inner", "right"):
        raise ValueError(how)
    counts = lambda t, c, n: t.groupBy(F.col(c).alias(f"__k{n}")).agg(F.count("*").alias(f"__{n}"))
    both = counts(right, right_on, "r").join(counts(left, left_on, "l"), F.col("__kr").eqNullSafe(F.col("__kl")), "left")
    made = (F.col("__r") * F.greatest(F.coalesce("__l", F.lit(1)), F.lit(1))).cast("double")
    most, total = both.agg(F.max(made), F.sum(made)).first()
    salts = max(1, min(MAX_SALTS, math.ceil((most or 0) / SPREAD_ROWS)))
    if salts == 1:
        return merge(left, right, how, left_on=left_on, right_on=right_on)
    # Partitions of a given number are not merged by their size, which is small: the rows are made after the shuffle.
    parts = max(salts, min(1 << 13, math.ceil(total / SPREAD_ROWS)))
    dealt = lambda t, c, s: t.withColumn("__s", s).withColumn("__p", F.xxhash64(c, "__s")).repartition(parts, "__p")
    a = dealt(left, left_on, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    b = dealt(right, right_on, F.pmod(F.xxhash64(*right.columns), F.lit(salts)))
    marks = ["__p_x", "__s_x", "__p_y", "__s_y"]
    return merge(a, b, how, left_on=["__p", "__s", left_on], right_on=["__p", "__s", right_on]).drop(*marks)


def cross(left: DataFrame, right: DataFrame, suffixes=("_x", "_y")) -> DataFrame:
    clash = set(left.columns) & set(right.columns)
    a = left.select(*[F.col(f"`{c}`").alias(c + suffixes[0] if c in clash else c) for c in left.columns])
    return a.crossJoin(right.select(*[F.col(f"`{c}`").alias(c + suffixes[1] if c in clash else c) for c in right.columns]))


def isin(rows: DataFrame, column: str, values: DataFrame, value_column: str, negate: bool = False) -> DataFrame:
    """Rows whose value is (not) among those of another table: a semi or anti join."""
    other = values.select(F.col(value_column).alias("__v"))
    return rows.join(other, F.col(column).eqNullSafe(F.col("__v")), "left_anti" if negate else "left_semi")


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str], direction: str = "backward", allow_exact: bool = True) -> DataFrame:
    """For each left row the values of the nearest right row of its group at or before (after) it.

    The sides are united, ordered within the group, and the last (first) right values are
    carried over: one shuffle, no inequality join.
    """
    back = direction == "backward"
    keys = [F.col(c) for c in by]
    packed = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(columns)])
    # At equal times the right rows come first if they count, else last.
    a = left.select(*keys, F.col(on).alias("__t"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias("__v"), F.lit(1 if allow_exact else 0).alias("__side"))
    b = right.select(*keys, F.col(on).alias("__t"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("__row"), packed.alias("__v"), F.lit(0 if allow_exact else 1).alias("__side"))
    w = Window.partitionBy(*by).orderBy(F.col("__t").asc() if back else F.col("__t").desc(), F.col("__side"))
    both = a.unionByName(b.select(a.columns))
    carried = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__got", carried).filter("__row IS NOT NULL")
    return out.select("__row.*", *[F.col(f"__got.r{i}").alias(c if c not in left.columns else f"{c}_right") for i, c in enumerate(columns)])


def interval(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the spans [start, end] that hold them, by bins of `width`: an equi-join instead of a nested loop."""
    by = by or []
    p = points.withColumn("__bin", F.floor(F.col(at) / width).cast("long"))
    s = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    return p.join(s, [*by, "__bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__bin")
