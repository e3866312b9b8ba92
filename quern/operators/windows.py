"""Ordered operators over whole frames and within groups.

A frame without groups is never put into one window partition. Rows get their global
position from per-bucket counts (buckets are cut at quantiles of the order key); running
values are taken per bucket and completed with the buckets' totals, and row windows are
taken over chunks of positions that borrow the rows they need from the chunk before.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.grouping import REDUCE, _over

#: Rows of a chunk of positions.
CHUNK = 1 << 16


def _key(frame: DataFrame, order: str) -> Column:
    kind = frame.schema[order].dataType.typeName()
    c = F.col(order)
    return F.unix_micros(c).cast("double") if kind in ("timestamp", "timestamp_ntz") else F.unix_date(c).cast("double") if kind == "date" else c.cast("double")


def bucketed(frame: DataFrame, order: str, buckets: int | None = None, name: str = "__bucket") -> DataFrame:
    """The frame with the number of the quantile bucket of its order key; a pure function of the key."""
    n = buckets or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = _key(frame, order)
    edges = frame.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], F.lit(1000)).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    return frame.withColumn(name, F.coalesce(F.aggregate(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), F.lit(0), lambda s, e: s + (key >= e).cast("int")), F.lit(0)))


def positions(frame: DataFrame, order: str, ties: list[str] | None = None, name: str = "position") -> DataFrame:
    """The frame with the row's place from 0 in the order."""
    by = bucketed(frame, order)
    before = by.groupBy("__bucket").agg(F.count("*").alias("__n")).select("__bucket", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__bucket").orderBy(order, *(ties or []))
    return by.join(F.broadcast(before), "__bucket").withColumn(name, F.col("__before") + F.row_number().over(w) - 1).drop("__bucket", "__before")


_SCAN = {"cumsum": (F.sum, lambda a, b: a + b, 0), "cumprod": (F.product, lambda a, b: a * b, 1), "cummax": (F.max, F.greatest, None), "cummin": (F.min, F.least, None)}


def cumulative(frame: DataFrame, order: str, ties: list[str] | None = None, **named) -> DataFrame:
    """Running values over the whole frame: name=(column, cumsum | cumprod | cummax | cummin | ffill)."""
    by = bucketed(frame, order)
    w = Window.partitionBy("__bucket").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts, out = [], by
    for name, (column, how) in named.items():
        if how == "ffill":
            parts.append(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(order, *(ties or [])))).alias(f"__t_{name}"))
        else:
            parts.append(_SCAN[how][0](column).alias(f"__t_{name}"))
    totals = by.groupBy("__bucket").agg(*parts)
    carried = totals.select("__bucket", *[(F.last(f"__t_{n}", ignorenulls=True) if how == "ffill" else _SCAN[how][0](f"__t_{n}")).over(earlier).alias(f"__c_{n}") for n, (_, how) in named.items()])
    out = out.join(F.broadcast(carried), "__bucket")
    for name, (column, how) in named.items():
        if how == "ffill":
            out = out.withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(w), F.col(f"__c_{name}")))
            continue
        f, join, zero = _SCAN[how]
        here, carry = f(column).over(w), F.col(f"__c_{name}")
        whole = join(here, carry) if zero is None else join(here, F.coalesce(carry, F.lit(zero)))
        out = out.withColumn(name, F.when(F.col(column).isNotNull(), whole))
    return out.drop("__bucket", *[f"__c_{n}" for n in named])


def _chunked(frame: DataFrame, position: str, before: int, after: int, chunk: int) -> DataFrame:
    """Rows in chunks of positions, each with copies of the neighbours it needs, marked __halo."""
    p = F.col(position)
    home = F.floor(p / chunk)
    first, last = F.floor((p - after) / chunk), F.floor((p + before) / chunk)
    return frame.withColumn("__home", home).withColumn("__chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("__halo", F.col("__chunk") != F.col("__home")).drop("__home")


def over_rows(frame: DataFrame, position: str, before: int, after: int, make, chunk: int = CHUNK) -> DataFrame:
    """Adds the columns that make(window) gives for frames of so many rows before and after."""
    chunk = max(chunk, before + after + 1)
    w = Window.partitionBy("__chunk").orderBy(position)
    out = _chunked(frame, position, before, after, chunk).withColumns(make(w))
    return out.filter("NOT __halo").drop("__chunk", "__halo")


def _groups(keys: list[str], order: list) -> Window:
    """The ordered rows of each group; without groups all rows go to one task, which the functions on whole frames avoid."""
    if not keys:
        warnings.warn("no group keys: all rows go to one task; rolling_frame, shift_frame, over_rows and cumulative do not need that", stacklevel=3)
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(keys: list[str], order: list, window: int, column: str, how: str, min_periods: int | None = None, center: bool = False) -> Column:
    """A reduction over the last `window` rows of the group, missing with fewer than min_periods values."""
    back, ahead = (window // 2, (window - 1) // 2) if center else (window - 1, 0)
    w = _groups(keys, order).rowsBetween(-back, ahead)
    return _enough(how, column, w, window if min_periods is None else min_periods)


def _enough(how: str, column: str, w, least: int) -> Column:
    n = F.count(column).over(w)
    if how == "count":
        return n
    value = F.sum(column).over(w) if how == "sum" else _over(REDUCE[how], column, w)
    return F.when(n >= max(least, 1), value)


def rolling_pair(keys: list[str], order: list, window: int, a: str, b: str, how: str) -> Column:
    """Rolling correlation or covariance of two columns."""
    w = _groups(keys, order).rowsBetween(-(window - 1), 0)
    return F.when(F.count(F.when(F.col(a).isNotNull(), F.col(b))).over(w) >= window, (F.corr if how == "corr" else F.covar_samp)(a, b).over(w))


def rolling_time(keys: list[str], time: str, seconds: int, column: str, how: str) -> Column:
    """A reduction over the rows of the last so many seconds, the start excluded."""
    w = _groups(keys, [F.unix_micros(time)]).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return _enough(how, column, w, 1)


def rolling_frame(frame: DataFrame, position: str, window: int, **named) -> DataFrame:
    """Rolling reductions over a whole frame with positions: name=(column, reduction)."""
    return over_rows(frame, position, window - 1, 0, lambda w: {name: _enough(how, column, w.rowsBetween(-(window - 1), 0), window) for name, (column, how) in named.items()})


def expanding(keys: list[str], order: list, column: str, how: str, min_periods: int = 1) -> Column:
    """A reduction over all rows of the group so far."""
    return _enough(how, column, _groups(keys, order).rowsBetween(Window.unboundedPreceding, 0), min_periods)


def shift(keys: list[str], order: list, column: str, periods: int = 1, fill=None) -> Column:
    w = _groups(keys, order)
    return F.lag(column, periods, fill).over(w) if periods >= 0 else F.lead(column, -periods, fill).over(w)


def shift_frame(frame: DataFrame, position: str, periods: int = 1, **named) -> DataFrame:
    """Shifted columns over a whole frame with positions: name=column."""
    n = abs(periods)
    return over_rows(frame, position, n if periods > 0 else 0, 0 if periods > 0 else n, lambda w: {name: (F.lag(c, n) if periods > 0 else F.lead(c, n)).over(w) for name, c in named.items()})


def diff(keys: list[str], order: list, column: str, periods: int = 1) -> Column:
    return F.col(column) - shift(keys, order, column, periods)


def pct_change(keys: list[str], order: list, column: str, periods: int = 1) -> Column:
    """Relative change of the value, with missing values filled forward first."""
    w = _groups(keys, order)
    filled = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    past = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -periods))
    return F.when(past != 0, filled / F.when(past != 0, past) - 1)


def alpha_of(com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    if com is not None:
        return 1 / (1 + com)
    if span is not None:
        return 2 / (span + 1)
    if halflife is not None:
        return 1 - math.exp(-math.log(2) / halflife)
    return alpha


def ewm(frame: DataFrame, keys: list[str], order: list, column: str, alpha: float, name: str = "ewm", how: str = "mean", adjust: bool = True) -> DataFrame:
    """Exponentially weighted mean, var or std (adjusted or recursive) in order within groups.

    Weighted sums obey s = (1 - alpha) * s_before + x. They are taken per chunk of rows, short
    enough for the weights to stay in range, and completed with the chunks' sums.
    """
    q = 1 - alpha
    chunk = max(2, min(512, int(300 / -math.log(q)))) if 0 < q < 1 else 2
    w = Window.partitionBy(*keys).orderBy(*order)
    x = F.col(column).cast("double")
    # Weights fall with every row, also with those without a value.
    t = frame.withColumn("__p", F.row_number().over(w) - 1).withColumn("__c", F.floor(F.col("__p") / chunk)).withColumn("__o", (F.col("__p") % chunk).cast("double"))
    if adjust:
        weight = F.lit(1.0)
    else:
        # A value counts alpha against the faded weight of all before it; after each value the whole is scaled to 1.
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("__last", F.max(F.when(x.isNotNull(), F.col("__p"))).over(past))
        t = t.withColumn("__f", F.when(x.isNotNull() & F.col("__last").isNotNull(), F.log(F.pow(F.lit(q), (F.col("__p") - F.col("__last")).cast("double")) + alpha)))
        weight = F.when(F.col("__last").isNull(), 1.0).otherwise(alpha * F.exp(F.coalesce(F.sum("__f").over(past), F.lit(0.0))))
    t = t.withColumn("__w", F.when(x.isNull(), 0.0).otherwise(weight))
    v = F.coalesce(x, F.lit(0.0))
    parts = {"w": F.col("__w"), "x": F.col("__w") * v, "xx": F.col("__w") * v * v, "ww": F.col("__w") * F.col("__w")}
    rate = {"w": q, "x": q, "xx": q, "ww": q * q}
    inside = Window.partitionBy(*keys, "__c").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    for k, c in parts.items():
        t = t.withColumn(f"__s_{k}", F.sum(c * F.pow(F.lit(1 / rate[k]), F.col("__o"))).over(inside) * F.pow(F.lit(rate[k]), F.col("__o")))
    ends = t.filter(F.col("__o") == chunk - 1).select(*keys, F.col("__c").alias("__e"), *[F.col(f"__s_{k}").alias(f"__e_{k}") for k in parts])
    lists = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__e", *[f"__e_{k}" for k in parts]))).alias("__ends")) if keys else ends.agg(F.array_sort(F.collect_list(F.struct("__e", *[f"__e_{k}" for k in parts]))).alias("__ends"))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in parts])
    carry = F.aggregate("__ends", F.struct(zero.alias("s"), F.array(F.struct(F.lit(-1).cast("long").alias("c"), zero.alias("s"))).alias("out")), lambda a, e: F.struct(F.struct(*[(a["s"][k] * rate[k] ** chunk + e[f"__e_{k}"]).alias(k) for k in parts]).alias("s"), F.concat(a["out"], F.array(F.struct(e["__e"].alias("c"), F.struct(*[(a["s"][k] * rate[k] ** chunk + e[f"__e_{k}"]).alias(k) for k in parts]).alias("s")))).alias("out")), lambda a: a["out"])
    rows = lists.select(*keys, F.explode(carry).alias("__k")).select(*keys, (F.col("__k.c") + 1).alias("__c"), F.col("__k.s").alias("__b"))
    t = t.join(rows, [*keys, "__c"], "left")
    full = {k: F.col(f"__s_{k}") + F.coalesce(F.col("__b")[k], F.lit(0.0)) * F.pow(F.lit(rate[k]), F.col("__o") + 1) for k in parts}
    mean = F.when(full["w"] > 0, full["x"] / F.when(full["w"] > 0, full["w"]))
    if how == "mean":
        value = mean
    else:
        biased = full["xx"] / F.when(full["w"] > 0, full["w"]) - mean * mean
        debias = full["w"] * full["w"] / F.when(full["w"] * full["w"] - full["ww"] > 1e-12, full["w"] * full["w"] - full["ww"])
        value = F.greatest(biased, F.lit(0.0)) * debias
        value = F.sqrt(value) if how == "std" else value
    return t.withColumn(name, value).select(*frame.columns, name)
