"""Reductions of whole frames, statistics, binning and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.grouping import REDUCE


def aggregate(frame: DataFrame, **named) -> DataFrame:
    """One row: name=(column, reduction)."""
    return frame.agg(*[(REDUCE[how] if isinstance(how, str) else how)(column).alias(name) for name, (column, how) in named.items()])


def sum_min_count(c: str, least: int) -> Column:
    return F.when(F.count(c) >= least, F.sum(c))


def variance(c: str, ddof: int = 1) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > ddof, F.var_pop(c) * n / F.when(n > ddof, n - ddof))


def quantile(c: str, q: float, interpolation: str = "linear") -> Column:
    """Exact quantile; between two values linear, lower, higher, midpoint or nearest."""
    if interpolation == "linear":
        return F.percentile(c, q)
    values = F.array_sort(F.collect_list(c))
    place = (F.size(values) - 1) * F.lit(q)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    at = lambda i: F.get(values, i).cast("double")
    return {"lower": at(low), "higher": at(high), "midpoint": (at(low) + at(high)) / 2, "nearest": at(F.bround(place, 0).cast("int"))}[interpolation]


#: Values with their counts that are taken to the driver for a quantile.
MAX_VALUES = 1 << 16


def rank_values(frame: DataFrame, column: str, ranks: list[int]) -> list:
    """The values at two neighbouring ranks (or one) from 0 among the present ones, in a column of any size.

    Approximate quantiles narrow the range that holds them, exact counts check each range, and the
    values of a small range come with their counts: no task holds the column.
    """
    rows = frame.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    lo = hi = None
    below, wide = 0, 2e-4
    inside = lambda a, b: (F.lit(True) if a is None else F.col("v") >= F.lit(a)) & (F.lit(True) if b is None else F.col("v") <= F.lit(b))
    n = rows.count()
    while n > MAX_VALUES and wide < 1:
        at = [min(max((r - below) / (n - 1) + e, 0.0), 1.0) for r, e in ((ranks[0], -wide), (ranks[-1], wide))]
        a, b = rows.filter(inside(lo, hi)).agg(F.percentile_approx("v", at, F.lit(10000)).alias("e")).first()["e"]
        got = rows.agg(F.count(F.when(F.col("v") < F.lit(a), 1)).alias("below"), F.count(F.when(inside(a, b), 1)).alias("n")).first()
        if not got["below"] <= ranks[0] <= ranks[-1] < got["below"] + got["n"]:
            wide *= 10
            continue
        narrower = got["n"] < n
        lo, hi, below, n = a, b, got["below"], got["n"]
        if not narrower or a == b:
            break
    counts = sorted(((r["v"], r["n"]) for r in rows.filter(inside(lo, hi)).groupBy("v").agg(F.count("*").alias("n")).collect()), key=lambda r: (r[0] != r[0], r[0]))
    out, at = [], below
    for v, n in counts:
        out += [v for r in ranks[len(out) :] if at <= r < at + n]
        at += n
    return out


def quantiles(frame: DataFrame, column: str, qs: list[float], interpolation: str = "linear") -> list[float | None]:
    """Exact quantiles of a column of any size, fetched; between two values linear, lower, higher, midpoint or nearest."""
    import math

    total = frame.agg(F.count(column)).first()[0]
    out = []
    for q in qs:
        place = (total - 1) * q
        low, high = math.floor(place), math.ceil(place)
        ranks = {"lower": [low], "higher": [high], "nearest": [round(place)]}.get(interpolation, [low, high])
        if not total:
            out.append(None)
            continue
        values = [float(v) for v in rank_values(frame, column, ranks)]
        out.append(values[0] + (values[-1] - values[0]) * ((place - low) if interpolation == "linear" else 0.5) if values[0] != values[-1] else values[0])
    return out


def quantile_by_rank(frame: DataFrame, order: str, q: float, interpolation: str, total: int | None = None) -> DataFrame:
    """A quantile of a column of any size, as a frame of one row."""
    return frame.sparkSession.createDataFrame([(quantiles(frame, order, [q], interpolation)[0],)], "value double")


def describe(frame: DataFrame, columns: list[str], percentiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """A row per statistic."""
    rows = [("count", lambda c: F.count(c).cast("double")), ("mean", F.avg), ("std", F.stddev_samp), ("min", lambda c: F.min(c).cast("double"))]
    found = {c: dict(zip(percentiles, quantiles(frame, c, list(percentiles)), strict=True)) for c in columns}
    rows += [(f"{p:.0%}", lambda c, p=p: F.first(F.lit(found[c][p]).cast("double"))) for p in percentiles] + [("max", lambda c: F.max(c).cast("double"))]
    one = frame.agg(*[F.array(*[f(c) for _, f in rows]).alias(c) for c in columns])
    names = F.array(*[F.lit(n) for n, _ in rows])
    return one.select(F.explode(F.arrays_zip(names.alias("statistic"), *columns)).alias("r")).select("r.*")


def corr_matrix(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations in long form."""
    pairs = [(a, b) for a in columns for b in columns]
    one = frame.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("p"))
    return one.select(F.explode("p").alias("p")).select("p.*")


def autocorr(frame: DataFrame, keys: list[str], order: list, column: str, lag: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.select(*keys, F.col(column).alias("x"), F.lag(column, lag).over(w).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys).agg(F.corr("x", "y").alias("autocorr"))


def value_counts(frame: DataFrame, column: str, normalize: bool = False, dropna: bool = True) -> DataFrame:
    rows = frame.filter(F.col(column).isNotNull()) if dropna else frame
    out = rows.groupBy(column).agg(F.count("*").alias("count"))
    if normalize:
        total = rows.agg(F.count("*").alias("__n"))
        out = out.crossJoin(F.broadcast(total)).select(column, (F.col("count") / F.col("__n")).alias("proportion"))
    return out


def cut(c: Column, edges: list[float], right: bool = True, include_lowest: bool = False, labels: list | None = None) -> Column:
    """The number (or label) of the interval that holds the value; missing outside."""
    out = F.lit(None)
    for i in range(len(edges) - 2, -1, -1):
        lo, hi = edges[i], edges[i + 1]
        inside = ((c > lo) & (c <= hi)) if right else ((c >= lo) & (c < hi))
        if include_lowest and i == 0 and right:
            inside = inside | (c == lo)
        out = F.when(inside, F.lit(labels[i] if labels else i)).otherwise(out)
    return out


def qcut(frame: DataFrame, column: str, q: int, name: str = "bin") -> DataFrame:
    """Bins at the exact sample quantiles."""
    c = F.col(column)
    place = sum(((c > F.lit(e)).cast("int") for e in quantiles(frame, column, [i / q for i in range(1, q)])), F.lit(0))
    return frame.withColumn(name, F.when(c.isNotNull(), place))


def histogram(frame: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts of equal bins; the last one holds its right edge."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return frame.filter(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def is_monotonic(frame: DataFrame, order: str, column: str, increasing: bool = True, strict: bool = False) -> DataFrame:
    """One row: whether each value is at least (most) the one before. Buckets of the order are checked apart, then their ends."""
    from quern.operators.windows import bucketed

    w = Window.partitionBy("__bucket").orderBy(order)
    good = {(True, False): lambda a, b: b >= a, (True, True): lambda a, b: b > a, (False, False): lambda a, b: b <= a, (False, True): lambda a, b: b < a}[increasing, strict]
    t = bucketed(frame, order).withColumn("__before", F.lag(column).over(w))
    ends = t.groupBy("__bucket").agg(F.bool_and(F.coalesce(good(F.col("__before"), F.col(column)), F.lit(True))).alias("ok"), F.min_by(column, order).alias("first"), F.max_by(column, order).alias("last"))
    chain = ends.withColumn("__prev", F.lag("last").over(Window.orderBy("__bucket")))
    return chain.agg(F.bool_and(F.col("ok") & F.coalesce(good(F.col("__prev"), F.col("first")), F.lit(True))).alias("monotonic"))


def mode(frame: DataFrame, column: str) -> DataFrame:
    """All most frequent values."""
    counts = value_counts(frame, column)
    return counts.join(F.broadcast(counts.agg(F.max("count").alias("count"))), "count").select(column)


# Statistics of hypothesis tests, with their degrees of freedom.


def ttest_1samp(frame: DataFrame, column: str, mean: float) -> DataFrame:
    n = F.count(column).cast("double")
    return frame.agg(((F.avg(column) - mean) / (F.stddev_samp(column) / F.sqrt(n))).alias("t"), (n - 1).alias("df"))


def ttest_ind(frame: DataFrame, column: str, group: Column, equal_var: bool = True) -> DataFrame:
    """Two samples, split by a boolean."""
    a, b = F.when(group, F.col(column)), F.when(~group, F.col(column))
    n, m = F.count(a).cast("double"), F.count(b).cast("double")
    va, vb = F.var_samp(a), F.var_samp(b)
    if equal_var:
        pooled = ((n - 1) * va + (m - 1) * vb) / (n + m - 2)
        return frame.agg(((F.avg(a) - F.avg(b)) / F.sqrt(pooled * (1 / n + 1 / m))).alias("t"), (n + m - 2).alias("df"))
    s = va / n + vb / m
    return frame.agg(((F.avg(a) - F.avg(b)) / F.sqrt(s)).alias("t"), (s * s / (va * va / (n * n * (n - 1)) + vb * vb / (m * m * (m - 1)))).alias("df"))


def ttest_rel(frame: DataFrame, a: str, b: str) -> DataFrame:
    return ttest_1samp(frame.select((F.col(a) - F.col(b)).alias("d")), "d", 0.0)


def chisquare(frame: DataFrame, observed: str, expected: str | None = None) -> DataFrame:
    """The statistic of observed against expected (or equal) frequencies."""
    if expected is None:
        return frame.agg((F.sum(F.col(observed) * F.col(observed)) * F.count("*") / F.sum(observed) - F.sum(observed)).alias("chi2"), (F.count("*") - 1).alias("df"))
    return frame.agg(F.sum((F.col(observed) - F.col(expected)) * (F.col(observed) - F.col(expected)) / F.col(expected)).alias("chi2"), (F.count("*") - 1).alias("df"))


def power_divergence(frame: DataFrame, observed: str, expected: str, lam: float) -> DataFrame:
    f, e = F.col(observed), F.col(expected)
    if lam == 0:
        return frame.agg((2 * F.sum(f * F.log(f / e))).alias("statistic"))
    return frame.agg((2 / (lam * (lam + 1)) * F.sum(f * (F.pow(f / e, F.lit(lam)) - 1))).alias("statistic"))


def entropy(frame: DataFrame, weight: str, base: float | None = None) -> DataFrame:
    """Entropy of weights that are first scaled to 1."""
    import math

    w = F.col(weight)
    h = F.log(F.sum(w)) - F.sum(F.when(w > 0, w * F.log(w)).otherwise(0.0)) / F.sum(w)
    return frame.agg((h / (math.log(base) if base else 1.0)).alias("entropy"))


def ks_2samp(frame: DataFrame, column: str, group: Column) -> DataFrame:
    """The largest distance of the two samples' distribution functions, by prefix sums over distinct values."""
    from quern.operators.windows import cumulative

    steps = frame.groupBy(F.col(column).cast("double").alias("v")).agg(F.sum(group.cast("int")).alias("a"), F.sum((~group).cast("int")).alias("b"))
    both = cumulative(steps, "v", ca=("a", "cumsum"), cb=("b", "cumsum"))
    size = steps.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    return both.crossJoin(F.broadcast(size)).agg(F.max(F.abs(F.col("ca") / F.col("n") - F.col("cb") / F.col("m"))).alias("d"))


def ttest_ind_from_stats(frame: DataFrame, mean1: str, std1: str, n1: str, mean2: str, std2: str, n2: str, equal_var: bool = True) -> DataFrame:
    """(t, df) of each row of summary statistics."""
    m1, s1, k1, m2, s2, k2 = (F.col(c).cast("double") for c in (mean1, std1, n1, mean2, std2, n2))
    if equal_var:
        df = k1 + k2 - 2
        error = F.sqrt(((k1 - 1) * s1 * s1 + (k2 - 1) * s2 * s2) / df * (1 / k1 + 1 / k2))
    else:
        a, b = s1 * s1 / k1, s2 * s2 / k2
        df, error = (a + b) * (a + b) / (a * a / (k1 - 1) + b * b / (k2 - 1)), F.sqrt(a + b)
    return frame.select("*", ((m1 - m2) / error).alias("t"), df.alias("df"))


def ks_1samp(frame: DataFrame, column: str, cdf) -> DataFrame:
    """(statistic): the largest distance of the empirical distribution from a distribution function of a column, by counts of distinct values."""
    from quern.operators import windows

    counts = frame.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    run = windows.cumulative(counts, "v", upto=("n", "cumsum")).join(F.broadcast(total))
    f = cdf(F.col("v"))
    above, below = F.col("upto") / F.col("total") - f, f - (F.col("upto") - F.col("n")) / F.col("total")
    return run.agg(F.max(F.greatest(above, below)).alias("statistic"))


def rankdata(frame: DataFrame, column: str, method: str = "average", name: str = "rank") -> DataFrame:
    from quern.operators import order

    return order.rank_values(frame, column, method, name=name)
