"""Metrics, preprocessing, model selection and thin estimators."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import arrays

# Metrics: aggregates of a frame with true and predicted columns.


def accuracy(y: str, p: str, weight: str | None = None) -> Column:
    w = F.col(weight) if weight else F.lit(1.0)
    return F.sum(F.when(F.col(y) == F.col(p), w).otherwise(0.0)) / F.sum(w)


def confusion(frame: DataFrame, y: str, p: str) -> DataFrame:
    return frame.groupBy(y, p).agg(F.count("*").alias("n"))


def precision_recall_f(frame: DataFrame, y: str, p: str, beta: float = 1.0) -> DataFrame:
    """Precision, recall, F-beta and support of each class."""
    both = frame.select(F.explode(F.array(F.struct(F.col(y).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q"), (F.col(y) == F.col(p)).cast("int").alias("tp")), F.struct(F.col(p).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    g = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("q").alias("predicted"), F.sum("tp").alias("tp"))
    pr = F.when(F.col("predicted") > 0, F.col("tp") / F.when(F.col("predicted") > 0, F.col("predicted"))).otherwise(0.0)
    re = F.when(F.col("support") > 0, F.col("tp") / F.when(F.col("support") > 0, F.col("support"))).otherwise(0.0)
    b = beta * beta
    low = b * pr + re
    return g.select("label", pr.alias("precision"), re.alias("recall"), F.when(low > 0, (1 + b) * pr * re / F.when(low > 0, low)).otherwise(0.0).alias("fbeta"), "support")


def log_loss(y: str, p: str, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))


def r2(y: str, p: str) -> Column:
    e = F.col(y) - F.col(p)
    return 1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))


def roc_curve(frame: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr): prefix sums over the distinct scores, from the largest."""
    from quern.operators.windows import cumulative

    steps = frame.groupBy((-F.col(score)).cast("double").alias("s")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    total = steps.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    run = cumulative(steps, "s", tp=("p", "cumsum"), fp=("n", "cumsum"))
    return run.crossJoin(F.broadcast(total)).select((-F.col("s")).alias("threshold"), (F.col("tp") / F.col("positives")).alias("tpr"), (F.col("fp") / F.col("negatives")).alias("fpr"))


def roc_auc(frame: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the curve as the rank statistic: pairs won, and half of those tied, by prefix sums over distinct scores."""
    from quern.operators.windows import cumulative

    steps = frame.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    run = cumulative(steps, "s", below=("n", "cumsum"))
    return run.agg((F.sum(F.col("p") * (F.col("below") - F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the unit sphere, of angles in radians."""
    a = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0))
    return 2 * F.asin(F.sqrt(a))


# Preprocessing.


def minmax_scale(frame: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    stats = frame.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))])
    out = frame.crossJoin(F.broadcast(stats))
    for c in columns:
        span = F.col(f"__b_{c}") - F.col(f"__a_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"__a_{c}")) / F.when(span != 0, span).otherwise(1.0) * (high - low) + low)
    return out.select(frame.columns)


def standard_scale(frame: DataFrame, columns: list[str]) -> DataFrame:
    stats = frame.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("a", F.avg), ("b", F.stddev_pop))])
    out = frame.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"__a_{c}")) / F.when(F.col(f"__b_{c}") != 0, F.col(f"__b_{c}")).otherwise(1.0))
    return out.select(frame.columns)


def normalize(c: Column, norm: str = "l2") -> Column:
    """A row vector scaled to length 1."""
    x = F.transform(c, lambda v: v.cast("double"))
    size = {"l2": F.sqrt(arrays.zip_sum(x, x, lambda a, b: a * b)), "l1": F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)), "max": F.array_max(F.transform(x, F.abs))}[norm]
    return F.transform(x, lambda v: v / F.when(size != 0, size).otherwise(1.0))


def label_binarize(c: Column, classes: list) -> Column:
    return F.array(*[(c == v).cast("int") for v in classes])


def softmax(c: Column) -> Column:
    top = F.array_max(c)
    e = F.transform(c, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


# Model selection.


def train_test_split(frame: DataFrame, key: str, test_size: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key: repeatable on any cluster."""
    mark = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(test_size * 1_000_000)
    return frame.filter(~mark), frame.filter(mark)


def kfold(frame: DataFrame, key: str, k: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    return frame.withColumn(name, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int"))


def parameter_grid(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(sorted(grid), v, strict=True)) for v in itertools.product(*[grid[k] for k in sorted(grid)])]


# Estimators.


class LinearRegression:
    """Least squares with an intercept, by one aggregation of the normal equations."""

    def fit(self, frame: DataFrame, features: list[str], target: str) -> LinearRegression:
        self.features = features
        z = frame.select(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y"))
        w = arrays.solve(z, "x", "y", len(features) + 1)
        self.intercept, self.coef = float(w[0]), w[1:]
        return self

    def predict(self, frame: DataFrame, name: str = "prediction") -> DataFrame:
        return frame.withColumn(name, sum((float(w) * F.col(c) for w, c in zip(self.coef, self.features, strict=True)), F.lit(self.intercept)))


class LogisticRegression:
    """Two classes, by Newton's method; each step is one aggregation of gradient and Hessian."""

    def __init__(self, steps: int = 15, l2: float = 1e-6):
        self.steps, self.l2 = steps, l2

    def fit(self, frame: DataFrame, features: list[str], target: str) -> LogisticRegression:
        self.features, d = features, len(features) + 1
        rows = frame.select(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y")).persist()
        w = np.zeros(d)
        for _ in range(self.steps):
            now = w.copy()

            def run(parts, now=now):
                g, h = np.zeros(d), np.zeros((d, d))
                for pdf in parts:
                    if len(pdf):
                        x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
                        p = 1 / (1 + np.exp(-np.clip(x @ now, -35, 35)))
                        g += x.T @ (p - y)
                        h += (x * (p * (1 - p))[:, None]).T @ x
                yield pd.DataFrame({"k": np.arange(d + d * d), "v": np.concatenate([g, h.ravel()])})

            sums = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
            step = np.linalg.solve(sums[d:].reshape(d, d) + self.l2 * np.eye(d), sums[:d] + self.l2 * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        rows.unpersist()
        self.intercept, self.coef = float(w[0]), w[1:]
        return self

    def predict_proba(self, frame: DataFrame, name: str = "probability") -> DataFrame:
        z = sum((float(w) * F.col(c) for w, c in zip(self.coef, self.features, strict=True)), F.lit(self.intercept))
        return frame.withColumn(name, 1 / (1 + F.exp(-z)))


class KMeans:
    """Lloyd's iterations; centres go out with the task and come back as sums, never as rows."""

    def __init__(self, k: int, steps: int = 20, tol: float = 1e-6):
        self.k, self.steps, self.tol = k, steps, tol

    def fit(self, frame: DataFrame, vector: str, order: str) -> KMeans:
        first = frame.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(order), order).limit(self.k).select(vector).collect()
        centres = np.array([r[0] for r in first], float)
        rows = frame.select(vector)
        for _ in range(self.steps):
            now = centres.copy()

            def run(parts, now=now):
                total, n = np.zeros_like(now), np.zeros(len(now))
                for pdf in parts:
                    if len(pdf):
                        x = np.stack(pdf[vector].to_numpy()).astype(float)
                        at = ((now**2).sum(axis=1) - 2 * x @ now.T).argmin(axis=1)
                        np.add.at(total, at, x)
                        n += np.bincount(at, minlength=len(now))
                yield pd.DataFrame({"k": np.arange(total.size + len(n)), "v": np.concatenate([total.ravel(), n])})

            s = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
            n = s[centres.size :]
            centres = np.where(n[:, None] > 0, s[: centres.size].reshape(centres.shape) / np.maximum(n, 1)[:, None], centres)
            if np.abs(centres - now).max() < self.tol:
                break
        self.centres = centres
        return self

    def predict(self, frame: DataFrame, vector: str, name: str = "cluster") -> DataFrame:
        d = F.array(*[arrays.distance(F.col(vector), F.array(*[F.lit(float(x)) for x in c]), "sqeuclidean") for c in self.centres])
        return frame.withColumn(name, F.array_position(d, F.array_min(d)).cast("int") - 1)


class PCA:
    """Principal axes from one pass of means and the Gram matrix."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, frame: DataFrame, vector: str, width: int) -> PCA:
        z = frame.select(F.concat(F.array(F.lit(1.0)), F.transform(vector, lambda x: x.cast("double"))).alias("z"))
        g = arrays.gram(z, "z", width + 1)
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        cov = (g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][: self.k]
        self.mean, self.explained_variance, self.components = mean, values[order], vectors[:, order].T
        return self

    def transform(self, frame: DataFrame, vector: str, name: str = "projected") -> DataFrame:
        centred = frame.withColumn("__x", F.zip_with(F.col(vector), F.array(*[F.lit(float(m)) for m in self.mean]), lambda a, b: a - b))
        return arrays.project(centred, "__x", self.components.T, name).drop("__x")


#: Pieces of points of which a task holds the distances to its block of queries, in numbers.
NEAR_CELLS = 1 << 20
#: Candidates whose exact distances are taken at once.
CHUNK = 1 << 14


def nearest_neighbors(queries: DataFrame, points: DataFrame, k: int, metric: str = "euclidean", others: bool = False) -> DataFrame:
    """(i, rank, j, d): the k nearest points (i, x) of each query (i, x), equal ones by j; of other ids only, if so asked.

    A task takes a tile's points in pieces and holds the best k of each query. Approximate distances
    by a matrix product choose candidates; exact ones, as SQL sums them, order them. Vectors that are
    missing or of another length come last.
    """
    from pyspark.sql import Window

    if metric not in ("euclidean", "cosine"):
        raise ValueError(metric)

    def fit(rows: arrays.Rows, width: int) -> np.ndarray:
        x = np.full((len(rows), width), np.nan)
        x[rows.size == width] = rows.x[rows.size == width, :width] if rows.x.shape[1] >= width else 0
        x[rows.bad] = np.nan
        return x

    def best(left, rights, same):
        width = int(np.bincount(np.maximum(left.size, 1)).argmax())
        x = fit(left, width)
        near_d, near_j = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        held, left_ids = np.zeros((len(x), k), bool), left.ids.to_numpy()
        for right in rights:
            step = max(1, NEAR_CELLS // len(x))
            ids, every = right.ids.to_numpy(), fit(right, width)
            for lo in range(0, len(every), step):
                y, js = every[lo : lo + step], ids[lo : lo + step]
                own = left_ids[:, None] == js if others else None
                at, other = candidates(x, y, np.where(held[:, -1], near_d[:, -1], np.nan), own)
                d = np.concatenate([arrays.paired(x[at[n : n + CHUNK]].T, y[other[n : n + CHUNK]].T, metric) for n in range(0, len(at), CHUNK)]) if len(at) else np.empty(0)
                old_at, old_k = np.nonzero(held)
                at, j, d = np.concatenate([old_at, at]), np.concatenate([near_j[old_at, old_k], js[other]]), np.concatenate([near_d[old_at, old_k], d])
                order = np.lexsort((j, d, at))
                at, j, d = at[order], j[order], d[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                keep = rank < k
                near_d[at[keep], rank[keep]], near_j[at[keep], rank[keep]], held[at[keep], rank[keep]] = d[keep], j[keep], True
        at, rank = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([left.ids.take(pa.array(at)), pa.array(near_j[at, rank]), pa.array(near_d[at, rank])], ["i", "j", "d"])

    def candidates(x, y, bound, own):
        """Places of pairs that can be among the k nearest: all that are not surely farther than the k-th so far."""
        with np.errstate(all="ignore"):
            if metric == "cosine":
                g = 1 - (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
                slack = 1e-9
            else:
                xx, yy = (x * x).sum(1), (y * y).sum(1)
                g = xx[:, None] + yy - 2 * x @ y.T
                bound, slack = bound * bound, 1e-9 * (xx + np.nanmax(yy, initial=0.0))
            if own is not None:
                g[own] = np.inf
            if np.isnan(bound).any() and g.shape[1] > k:
                # NaN sorts last, so a NaN here means fewer than k numbers.
                bound = np.where(np.isnan(bound), np.partition(g, k - 1, axis=1)[:, k - 1], bound)
            near = ~(g > (bound + slack)[:, None])
            return np.nonzero(near if own is None else near & ~own)

    part = arrays.tiled(queries.withColumn("i", F.col("i").cast("long")), points.withColumn("i", F.col("i").cast("long")), best, "i long, j long, d double")
    w = Window.partitionBy("i").orderBy("d", "j")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("i", "rank", "j", "d")


def kneighbors_graph(queries: DataFrame, points: DataFrame, k: int, mode: str = "connectivity", metric: str = "euclidean", others: bool = False) -> DataFrame:
    """(i, j, v) of the k nearest points (of other ids) of each query: ones, or the distances."""
    near = nearest_neighbors(queries, points, k, metric, others)
    return near.select("i", "j", (F.lit(1.0) if mode == "connectivity" else F.col("d")).alias("v"))


def row_norms(c: Column, squared: bool = False) -> Column:
    s = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return s if squared else F.sqrt(s)


def multilabel_confusion(frame: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tn, fp, fn, tp) of every label against the rest, from the counts of label pairs."""
    pairs = frame.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select("n", F.explode(F.array_distinct(F.array("y", "p"))).alias("label"), "y", "p")
    hit, right, said = F.col("n"), F.col("y") == F.col("label"), F.col("p") == F.col("label")
    total = pairs.agg(F.sum("n").alias("total"))
    out = sides.groupBy("label").agg(*[F.coalesce(F.sum(F.when(c, hit)), F.lit(0)).alias(n) for n, c in (("fp", ~right & said), ("fn", right & ~said), ("tp", right & said))])
    return out.join(F.broadcast(total)).select("label", (F.col("total") - F.col("fp") - F.col("fn") - F.col("tp")).alias("tn"), "fp", "fn", "tp")


class LabelEncoder:
    """Codes of the sorted distinct labels, at most `most` of them, which are held on the driver."""

    def __init__(self, most: int = 100_000):
        self.most, self.classes = most, []

    def fit(self, frame: DataFrame, column: str) -> LabelEncoder:
        rows = frame.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} labels")
        self.classes = [r[0] for r in rows]
        return self

    def transform(self, c: Column) -> Column:
        """The label's code from 0; missing for a label that was not seen."""
        place = F.array_position(F.array(*[F.lit(x) for x in self.classes]), c)
        return F.when(place > 0, place - 1)

    def inverse(self, c: Column) -> Column:
        return F.try_element_at(F.array(*[F.lit(x) for x in self.classes]), (c + 1).cast("int"))


class TruncatedSVD:
    """The leading right singular vectors of the rows' vectors, without centring."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, frame: DataFrame, vector: str, width: int) -> TruncatedSVD:
        self.singular_values, self.components = arrays.randomized_svd(frame, vector, width, self.k)
        return self

    def transform(self, frame: DataFrame, vector: str, name: str = "projected") -> DataFrame:
        return arrays.project(frame, vector, self.components.T, name)
