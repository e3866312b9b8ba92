"""Arrays in long form: a vector is (i, v), a matrix (i, j, v); indices from 0.

Element-wise work is column expressions; reductions and products are group-bys and joins
on indices, so size is bounded by the cluster alone. Factorisations of tall matrices go
through their Gram matrix, which is as wide as the matrix and solved on the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Creation.


def arange(spark: SparkSession, start: float, stop: float, step: float = 1) -> DataFrame:
    n = max(0, int(np.ceil((stop - start) / step)))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * step).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True) -> DataFrame:
    step = (stop - start) / max(num - 1 if endpoint else num, 1)
    return spark.range(num).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * step).alias("v"))


def full(spark: SparkSession, shape: tuple[int, int], value: float) -> DataFrame:
    rows, cols = shape
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"), F.lit(value).alias("v"))


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> DataFrame:
    return full(spark, (n, m or n), 0.0).withColumn("v", (F.col("j") - F.col("i") == k).cast("double"))


def meshgrid(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, x, y): x varies with j, y with i."""
    return y.select("i", F.col("v").alias("y")).crossJoin(x.select(F.col("i").alias("j"), F.col("v").alias("x"))).select("i", "j", "x", "y")


def diag(vector: DataFrame) -> DataFrame:
    """A vector as the diagonal of a matrix, absent elsewhere."""
    return vector.select("i", F.col("i").alias("j"), "v")


def diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.filter("i = j").select("i", "v")


def triu(matrix: DataFrame, k: int = 0) -> DataFrame:
    return matrix.withColumn("v", F.when(F.col("j") - F.col("i") >= k, F.col("v")).otherwise(0))


def tril(matrix: DataFrame, k: int = 0) -> DataFrame:
    return matrix.withColumn("v", F.when(F.col("j") - F.col("i") <= k, F.col("v")).otherwise(0))


def random(spark: SparkSession, name: str, size: int, seed: int = 0, *args, parts: int = 8, **kwargs) -> DataFrame:
    """A sample of any distribution of numpy's generator; rows depend on the seed alone, not on the partitions."""
    block = 1 << 14

    def run(frames):
        for pdf in frames:
            for b in pdf["id"]:
                n = min(block, size - b * block)
                yield pd.DataFrame({"i": np.arange(n) + b * block, "v": np.asarray(getattr(np.random.default_rng([seed, b]), name)(*args, size=n, **kwargs), float)})

    return spark.range(0, -(-size // block), 1, parts).mapInPandas(run, "i long, v double")


# Manipulation.


def full_like(array: DataFrame, value: float) -> DataFrame:
    """The array's places, all with one value."""
    return array.withColumn("v", F.lit(value).cast("double"))


def zeros_like(array: DataFrame) -> DataFrame:
    return full_like(array, 0.0)


def ones_like(array: DataFrame) -> DataFrame:
    return full_like(array, 1.0)


def identity(spark: SparkSession, n: int) -> DataFrame:
    return eye(spark, n)


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> DataFrame:
    """Ones at and below the k-th diagonal."""
    return full(spark, (n, m or n), 0.0).withColumn("v", (F.col("j") - F.col("i") <= k).cast("double"))


def indices(spark: SparkSession, shape: tuple[int, int]) -> DataFrame:
    """(i, j, row, col) of a grid."""
    return full(spark, shape, 0.0).select("i", "j", F.col("i").alias("row"), F.col("j").alias("col"))


def diagflat(vector: DataFrame, k: int = 0) -> DataFrame:
    """The vector on the k-th diagonal of a matrix; other places are left out, as zeros."""
    return vector.select((F.col("i") + max(-k, 0)).alias("i"), (F.col("i") + max(k, 0)).alias("j"), "v")


def fill_diagonal(matrix: DataFrame, value: float) -> DataFrame:
    return matrix.withColumn("v", F.when(F.col("i") == F.col("j"), F.lit(value)).otherwise(F.col("v")))


def broadcast_to(vector: DataFrame, rows: int) -> DataFrame:
    """The vector as every row of a matrix."""
    return vector.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("r"), F.col("i").alias("j"), "v").withColumnRenamed("r", "i").select("i", "j", "v")


def expand_dims(vector: DataFrame, axis: int = 0) -> DataFrame:
    """The vector as a matrix of one row (axis 0) or one column (axis 1)."""
    zero = F.lit(0).cast("long")
    return vector.select(zero.alias("i"), F.col("i").alias("j"), "v") if axis == 0 else vector.select("i", zero.alias("j"), "v")


def squeeze(matrix: DataFrame) -> DataFrame:
    """A matrix of one row or column as a vector."""
    return matrix.select((F.col("i") + F.col("j")).alias("i"), "v")


def split(vector: DataFrame, n: int, parts: int) -> DataFrame:
    """The vector of length n with the number of its part and the place in it; the first n % parts parts have one more."""
    small, more = divmod(n, parts)
    edge = more * (small + 1)
    i = F.col("i")
    part = F.when(i < edge, F.floor(i / (small + 1))).otherwise(more + F.floor((i - edge) / max(small, 1)))
    start = F.when(i < edge, part * (small + 1)).otherwise(edge + (part - more) * small)
    return vector.select(part.alias("part"), (i - start).alias("i"), "v")


def unravel_index(vector: DataFrame, cols: int) -> DataFrame:
    """Row and column of each place in a matrix of so many columns."""
    return vector.select("i", F.floor(F.col("i") / cols).alias("r"), (F.col("i") % cols).alias("c"))


def insert(vector: DataFrame, at: int, values: list[float]) -> DataFrame:
    """The vector with values put in before a place."""
    moved = vector.select(F.when(F.col("i") >= at, F.col("i") + len(values)).otherwise(F.col("i")).alias("i"), F.col("v").cast("double").alias("v"))
    return moved.union(vector.sparkSession.createDataFrame([(at + n, float(v)) for n, v in enumerate(values)], "i long, v double"))


def choose(vector: DataFrame, choices: list[DataFrame]) -> DataFrame:
    """At each place the value of the choice that the vector names there."""
    every = None
    for n, c in enumerate(choices):
        part = c.select("i", F.lit(n).alias("__n"), "v")
        every = part if every is None else every.union(part)
    return vector.select("i", F.col("v").cast("int").alias("__n")).join(every, ["i", "__n"]).select("i", "v")


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def reshape(matrix: DataFrame, cols: int, new_cols: int) -> DataFrame:
    at = F.col("i") * cols + F.col("j")
    return matrix.select(F.floor(at / new_cols).cast("long").alias("i"), (at % new_cols).cast("long").alias("j"), "v")


def ravel(matrix: DataFrame, cols: int) -> DataFrame:
    return matrix.select((F.col("i") * cols + F.col("j")).alias("i"), "v")


def flip(vector: DataFrame, n: int) -> DataFrame:
    return vector.withColumn("i", F.lit(n - 1) - F.col("i"))


def roll(vector: DataFrame, n: int, by: int) -> DataFrame:
    return vector.withColumn("i", F.pmod(F.col("i") + by, F.lit(n)))


def repeat(vector: DataFrame, times: int) -> DataFrame:
    return vector.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select((F.col("i") * times + F.col("__r")).alias("i"), "v")


def tile(vector: DataFrame, n: int, times: int) -> DataFrame:
    return vector.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select((F.col("i") + F.col("__r") * n).alias("i"), "v")


def concatenate(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Vectors with their lengths, one after the other."""
    out, at = None, 0
    for vector, n in parts:
        one = vector.select((F.col("i") + at).alias("i"), "v")
        out, at = one if out is None else out.union(one), at + n
    return out


def vstack(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    out, at = None, 0
    for matrix, rows in parts:
        one = matrix.select((F.col("i") + at).alias("i"), "j", "v")
        out, at = one if out is None else out.union(one), at + rows
    return out


def hstack(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    return transpose(vstack([(transpose(m), n) for m, n in parts]))


def take(vector: DataFrame, places: DataFrame) -> DataFrame:
    """Values at places (i, at)."""
    return places.join(vector.select(F.col("i").alias("at"), "v"), "at").select("i", "v")


def compress(vector: DataFrame, cond) -> DataFrame:
    from quern.operators.windows import positions

    return positions(vector.filter(cond), "i").select(F.col("position").alias("i"), "v")


def nonzero(vector: DataFrame) -> DataFrame:
    return vector.filter("v <> 0").select("i")


def delete(vector: DataFrame, places: list[int]) -> DataFrame:
    return compress(vector, ~F.col("i").isin(places))


def diff(vector: DataFrame) -> DataFrame:
    a, b = vector.alias("a"), vector.withColumn("i", F.col("i") - 1).alias("b")
    return a.join(b, F.col("a.i") == F.col("b.i")).select(F.col("a.i").alias("i"), (F.col("b.v") - F.col("a.v")).alias("v"))


def sort(vector: DataFrame) -> DataFrame:
    from quern.operators.windows import positions

    return positions(vector.select("v", F.col("i").alias("at")), "v", ["at"]).select(F.col("position").alias("i"), "v", "at")


def argsort(vector: DataFrame) -> DataFrame:
    return sort(vector).select("i", F.col("at").alias("v"))


def topk(vector: DataFrame, k: int, largest: bool = True) -> DataFrame:
    return vector.orderBy(F.desc("v") if largest else F.asc("v"), "i").limit(k)


def argtopk(vector: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """(rank, i): the places of the k largest or least values, equal ones in order of their places."""
    key = F.col("v").desc() if largest else F.col("v").asc()
    best = vector.orderBy(key, "i").limit(k)
    return best.select((F.row_number().over(Window.orderBy(key, "i")) - 1).cast("long").alias("rank"), "i")


def argwhere(matrix: DataFrame) -> DataFrame:
    return matrix.filter("v <> 0").select("i", "j")


def flatnonzero(matrix: DataFrame, cols: int) -> DataFrame:
    return matrix.filter("v <> 0").select((F.col("i") * cols + F.col("j")).alias("i"))


def count_nonzero(array: DataFrame) -> DataFrame:
    return array.agg(F.count(F.when(F.col("v") != 0, 1)).alias("n"))


def extract(vector: DataFrame, cond) -> DataFrame:
    """The values where the condition holds, numbered anew."""
    return compress(vector, cond)


def ediff1d(vector: DataFrame) -> DataFrame:
    return diff(vector)


def allclose(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8, places: tuple[str, ...] = ("i",)) -> DataFrame:
    """One row: whether both have the same places and |a - b| <= atol + rtol * |b| at each."""
    both = a.select(*places, F.col("v").alias("x")).join(b.select(*places, F.col("v").alias("y")), list(places), "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(F.abs(F.col("x") - F.col("y")) <= atol + rtol * F.abs("y"), F.lit(False))), F.lit(True)).alias("close"))


def array_equal(a: DataFrame, b: DataFrame, places: tuple[str, ...] = ("i",)) -> DataFrame:
    return allclose(a, b, 0.0, 0.0, places).withColumnRenamed("close", "equal")


def nanargmin(vector: DataFrame) -> DataFrame:
    """The place of the least value that is a number."""
    return argmax(vector.filter("v IS NOT NULL AND NOT isnan(v)"), largest=False)


def histogram_bin_edges(frame: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(i, edge) of equal bins between the least and the largest value."""
    ends = frame.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    return ends.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins).cast("long"))).alias("i")).select("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / bins).alias("edge"))


def squareform(pairs: DataFrame) -> DataFrame:
    """A matrix (i, j, v), its zero diagonal left out, of distances (i, j, d) of each two."""
    return pairs.select(F.explode(F.array(F.struct("i", "j", "d"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d"))).alias("x")).select("x.i", "x.j", F.col("x.d").alias("v"))


def unique(vector: DataFrame) -> DataFrame:
    """Distinct values with their counts and first places."""
    return vector.groupBy("v").agg(F.count("*").alias("count"), F.min("i").alias("first"))


def searchsorted(edges: list[float], c, side: str = "left"):
    """The place at which the value would be inserted; a sum of comparisons, at most a few hundred edges."""
    return sum((((c > e) if side == "left" else (c >= e)).cast("int") for e in edges), F.lit(0))


digitize = searchsorted


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").subtract(b.select("v"))


def union1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").union(b.select("v")).distinct()


def trapz(vector: DataFrame, dx: float = 1.0) -> DataFrame:
    """Trapezoid sum: all values, less half of the two ends."""
    return vector.agg((dx * (F.sum("v") - (F.min_by("v", "i") + F.max_by("v", "i")) / 2)).alias("v"))


# Reductions and statistics.


def reduce_axis(matrix: DataFrame, axis: int, function) -> DataFrame:
    """Reduces rows (axis 1) or columns (axis 0) of a matrix."""
    keep = "j" if axis == 0 else "i"
    return matrix.groupBy(keep).agg(function("v").alias("v"))


def argmax(vector: DataFrame, largest: bool = True) -> DataFrame:
    return vector.agg((F.max_by("i", F.struct("v", -F.col("i"))) if largest else F.min_by("i", F.struct("v", "i"))).alias("i"))


def average(c, weight):
    return F.sum(c * weight) / F.sum(weight)


def bincount(frame: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    return frame.groupBy(column).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def cov(frame: DataFrame, columns: list[str], sample: bool = True) -> DataFrame:
    f = F.covar_samp if sample else F.covar_pop
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), f(a, b).alias("v")) for i, a in enumerate(columns) for j, b in enumerate(columns)])
    return frame.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def corrcoef(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, v): correlations of each two columns."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.corr(a, b).alias("v")) for i, a in enumerate(columns) for j, b in enumerate(columns)])
    return frame.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*")


# Linear algebra.


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: a join on the inner index, summed before and after the shuffle."""
    x, y = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", F.col("v").alias("x")).join(b.select("i", F.col("v").alias("y")), "i").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def einsum(spec: str, *operands: DataFrame) -> DataFrame:
    """Sums of products by index letters: joins on shared letters, then one sum. Operands have a column per letter, and v."""
    inputs, output = spec.replace(" ", "").split("->")
    out, seen = None, set()
    for n, (letters, x) in enumerate(zip(inputs.split(","), operands, strict=True)):
        x = x.toDF(*letters, f"v{n}")
        shared = [c for c in letters if c in seen]
        out = x if out is None else out.join(x, shared) if shared else out.crossJoin(x)
        seen |= set(letters)
    product = F.lit(1.0)
    for n in range(len(operands)):
        product = product * F.col(f"v{n}")
    return out.groupBy(*output).agg(F.sum(product).alias("v"))


def norm(matrix: DataFrame, order: str | int = "fro") -> DataFrame:
    v = F.abs(F.col("v"))
    if order in ("fro", 2):
        return matrix.agg(F.sqrt(F.sum(v * v)).alias("v"))
    if order == "inf":
        return matrix.groupBy("i").agg(F.sum(v).alias("s")).agg(F.max("s").alias("v"))
    return matrix.groupBy("j").agg(F.sum(v).alias("s")).agg(F.max("s").alias("v"))


def gram(frame: DataFrame, vector: str, width: int) -> np.ndarray:
    """X'X of a frame whose rows are vectors: partial sums per batch, width*width numbers to the driver."""

    def run(parts):
        total = np.zeros((width, width))
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "v": total.ravel()})

    rows = frame.select(vector).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    out[rows["i"], rows["j"]] = rows["v"]
    return out


def qr_r(frame: DataFrame, vector: str, width: int) -> np.ndarray:
    """R of a tall matrix's QR, with a positive diagonal, from the Cholesky factor of its Gram matrix."""
    return np.linalg.cholesky(gram(frame, vector, width)).T


def svd(frame: DataFrame, vector: str, width: int, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall matrix."""
    values, vectors = np.linalg.eigh(gram(frame, vector, width))
    order = np.argsort(values)[::-1][: k or width]
    return np.sqrt(np.maximum(values[order], 0)), vectors[:, order].T


def project(frame: DataFrame, vector: str, matrix: np.ndarray, name: str = "projected") -> DataFrame:
    """Each row's vector times a small matrix."""
    m = matrix

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()).astype(float) @ m)) if len(x) else x

    return frame.withColumn(name, run(vector))


def solve(frame: DataFrame, vector: str, target: str, width: int) -> np.ndarray:
    """Least squares by normal equations."""
    both = frame.select(F.concat(vector, F.array(F.col(target).cast("double"))).alias("z"))
    g = gram(both, "z", width + 1)
    return np.linalg.solve(g[:width, :width], g[:width, width])


#: Rows of a square matrix that may be taken to the driver.
MAX_SQUARE = 4096


def on_driver(matrix: DataFrame, n: int, function) -> DataFrame:
    """A numpy function of a square matrix that fits on the driver, of MAX_SQUARE rows at most."""
    if n > MAX_SQUARE:
        raise ValueError(f"a matrix of {n} rows does not fit on the driver (at most {MAX_SQUARE})")
    rows = matrix.toPandas()
    m = np.zeros((n, n))
    m[rows["i"], rows["j"]] = rows["v"]
    return matrix.sparkSession.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "v": np.asarray(function(m)).ravel()}))


def inverse(matrix: DataFrame, n: int) -> DataFrame:
    return on_driver(matrix, n, np.linalg.inv)


def cholesky(matrix: DataFrame, n: int) -> DataFrame:
    """The lower factor."""
    return on_driver(matrix, n, np.linalg.cholesky)


def solve_triangular(matrix: DataFrame, target: DataFrame, n: int, lower: bool = True) -> DataFrame:
    """(i, v): the solution of a triangular system by substitution, on the driver; target is (i, v)."""
    if n > MAX_SQUARE:
        raise ValueError(f"a matrix of {n} rows does not fit on the driver (at most {MAX_SQUARE})")
    rows, right = matrix.filter(F.col("j") <= F.col("i") if lower else F.col("j") >= F.col("i")).toPandas(), target.toPandas()
    m, x = np.zeros((n, n)), np.zeros(n)
    m[rows["i"], rows["j"]] = rows["v"]
    x[right["i"]] = right["v"]
    for k in range(n) if lower else range(n - 1, -1, -1):
        rest = slice(0, k) if lower else slice(k + 1, n)
        x[k] = (x[k] - m[k, rest] @ x[rest]) / m[k, k]
    return matrix.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")


def randomized_svd(frame: DataFrame, vector: str, width: int, k: int, oversample: int = 10, rounds: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall matrix, by a random range of the Gram matrix that is summed over the rows once."""
    g = gram(frame, vector, width)
    q = np.linalg.qr(g @ np.random.RandomState(seed).randn(width, min(width, k + oversample)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(g @ q)[0]
    values, small = np.linalg.eigh(q.T @ g @ q)
    at = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[at], 0)), svd_flip((q @ small[:, at]).T)


def svd_flip(vectors: np.ndarray) -> np.ndarray:
    """Row vectors with the sign that makes the largest component of each positive."""
    return vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]


def lu(matrix: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Permutation, unit lower and upper factors, with partial pivoting."""

    def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, low, p = m.copy(), np.eye(n), np.eye(n)
        for k in range(n - 1):
            best = k + int(np.abs(u[k:, k]).argmax())
            for x, upto in ((u, n), (p, n), (low, k)):
                x[[k, best], :upto] = x[[best, k], :upto]
            if u[k, k] != 0:
                low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
                u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
        return p.T, low, u

    held: list = []

    def part(m: np.ndarray, i: int) -> np.ndarray:
        if not held:
            held.extend(parts(m))
        return held[i]

    return tuple(on_driver(matrix, n, lambda m, i=i: part(m, i)) for i in range(3))


def fft(frame: DataFrame, vector: str, kind: str = "fft") -> DataFrame:
    """A transform of numpy.fft of each row's vector, as arrays of real and imaginary parts."""

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def run(x: pd.Series) -> pd.DataFrame:
        out = [np.asarray(getattr(np.fft, kind)(np.asarray(v, float))) for v in x]
        return pd.DataFrame({"re": [o.real.astype(float) for o in out], "im": [np.imag(o).astype(float) for o in out]})

    return frame.withColumn(kind, run(vector))


def fftfreq(spark: SparkSession, n: int, d: float = 1.0, real: bool = False) -> DataFrame:
    """(i, f): the sample frequencies of a transform of n values."""
    count = n // 2 + 1 if real else n
    i = F.col("id")
    return spark.range(count).select(i.alias("i"), ((i if real else F.when(i < (n + 1) // 2, i).otherwise(i - n)) / (n * d)).alias("f"))


def fftshift(vector: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """The zero frequency moved to the middle, or back."""
    return roll(vector, n, -(n // 2) if inverse else n // 2)


# Distances: of two columns in the JVM, of all pairs of two frames in tiles of Arrow batches.


def zip_sum(a, b, f):
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def distance(a, b, metric: str = "euclidean"):
    d = lambda x, y: x.cast("double") - y.cast("double")
    if metric == "sqeuclidean":
        return zip_sum(a, b, lambda x, y: d(x, y) * d(x, y))
    if metric == "euclidean":
        return F.sqrt(zip_sum(a, b, lambda x, y: d(x, y) * d(x, y)))
    if metric in ("manhattan", "cityblock"):
        return zip_sum(a, b, lambda x, y: F.abs(d(x, y)))
    if metric == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(d(x, y))))
    if metric == "cosine":
        return 1 - zip_sum(a, b, lambda x, y: x.cast("double") * y) / (F.sqrt(zip_sum(a, a, lambda x, y: x.cast("double") * y)) * F.sqrt(zip_sum(b, b, lambda x, y: x.cast("double") * y)))
    if metric == "hamming":
        return zip_sum(a, b, lambda x, y: (x != y).cast("double")) / F.size(a)
    if metric == "rbf":
        return F.exp(-zip_sum(a, b, lambda x, y: d(x, y) * d(x, y)) / F.size(a))
    raise ValueError(metric)


#: Rows of each side of a tile at most, distances that a task holds at once, and right rows that it takes at once.
TILE_ROWS, CELLS, PIECE_ROWS = 4096, 1 << 15, 8192
#: Partitions over which tiles are dealt at most.
MAX_PARTS = 1 << 13


class Rows:
    """Ids and vectors of one side of a tile. Short vectors are filled up with zeros; bad rows are missing or hold a missing element."""

    def __init__(self, ids: pa.Array, vectors: pa.Array):
        n = len(vectors)
        self.ids, self.size = ids, np.asarray(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False), int)
        flat = vectors.flatten().cast(pa.float64())
        values = flat.to_numpy(zero_copy_only=False)
        width = int(self.size.max(initial=0))
        self.bad = self.size < 0
        if flat.null_count:
            owner = np.repeat(np.arange(n), np.maximum(self.size, 0))
            self.bad[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        if (self.size == width).all():
            self.x = values.reshape(n, width)
        else:
            self.x = np.zeros((n, width))
            self.x[np.arange(width) < self.size[:, None]] = values

    def __len__(self) -> int:
        return len(self.size)

    def by_element(self, width: int) -> np.ndarray:
        out = np.zeros((width, len(self)))
        out[: self.x.shape[1]] = self.x.T
        return out


def cells(x: np.ndarray, y: np.ndarray, metric: str, size: np.ndarray) -> np.ndarray:
    """Distances of the columns of x and y, summed element by element in order, as SQL sums them."""
    acc, t = np.zeros((x.shape[1], y.shape[1])), np.empty((x.shape[1], y.shape[1]))
    for a, b in zip(x, y, strict=True):
        if metric == "cosine":
            np.multiply(a[:, None], b, out=t)
        elif metric == "hamming":
            np.not_equal(a[:, None], b, out=t, casting="unsafe")
        else:
            np.subtract(a[:, None], b, out=t)
            np.abs(t, out=t) if metric in ("manhattan", "cityblock", "chebyshev") else np.multiply(t, t, out=t)
        (np.maximum if metric == "chebyshev" else np.add)(acc, t, out=acc)
    with np.errstate(all="ignore"):
        if metric == "euclidean":
            return np.sqrt(acc, out=acc)
        if metric == "cosine":
            squares = [sum((v * v for v in z), np.zeros(z.shape[1])) for z in (x, y)]
            return 1 - acc / np.sqrt(squares[0][:, None] * squares[1])
        if metric == "hamming":
            return acc / size[:, None]
        if metric == "rbf":
            return np.exp(-acc / size[:, None])
    if metric in ("sqeuclidean", "manhattan", "cityblock", "chebyshev"):
        return acc
    raise ValueError(metric)


def _rounded(d: np.ndarray, decimals: int) -> np.ndarray:
    """Halves go away from zero; no negative zero."""
    scaled = d * 10.0**decimals
    whole = np.trunc(scaled)
    rest = scaled - whole
    return (whole + (rest >= 0.5) - (rest <= -0.5)) / 10.0**decimals + 0.0


def tiled(a: DataFrame, b: DataFrame, run, schema: str, half: bool = False) -> DataFrame:
    """run(left rows, pieces of right rows, whether both are one block) over all tiles of two frames (i, x), or those not below the diagonal.

    Both sides are dealt into blocks by a hash of the id and sent to the tiles of their block. A
    task reads one tile after the other, holds its left block and takes the right one in pieces.
    """
    n = a.count()
    m = n if half else b.count()
    blocks = lambda n: max(1, -(-n // min(TILE_ROWS, max(256, -(-n // 8)))))
    n, m = blocks(n), blocks(m)
    own = lambda n: F.pmod(F.xxhash64("i"), F.lit(n))
    every = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long") if isinstance(lo, int) else lo, F.lit(hi).cast("long") if isinstance(hi, int) else hi))
    left = a.select("i", "x", own(n).alias("__a")).select("i", F.lit(None).cast(b.schema["i"].dataType).alias("j"), "x", F.lit(0).alias("__side"), "__a", every(F.col("__a") if half else 0, m - 1).alias("__b"))
    right = b.select("i", "x", own(m).alias("__b")).select(F.lit(None).cast(a.schema["i"].dataType).alias("i"), F.col("i").alias("j"), "x", F.lit(1).alias("__side"), "__b", every(0, F.col("__b") if half else n - 1).alias("__a"))
    parts = min(n * (n + 1) // 2 if half else n * m, MAX_PARTS)
    place = F.col("__b") * (F.col("__b") + 1) / 2 + F.col("__a") if half else F.col("__a") * m + F.col("__b")
    both = left.unionByName(right).withColumn("__t", place.cast("long"))
    dealt = both.repartitionById(parts, (F.col("__t") % parts).cast("int")).sortWithinPartitions("__t", "__side")

    def runs(batches):
        for batch in batches:
            t, side, same = (batch.column(c).to_numpy() for c in ("__t", "__side", "__same"))
            edges = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (side[1:] != side[:-1])) + 1), len(t)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    yield t[lo], side[lo], same[lo], batch.slice(lo, hi - lo)

    def pieces(parts):
        for _, _, _, part in parts:
            for at in range(0, len(part), PIECE_ROWS):
                piece = part.slice(at, PIECE_ROWS)
                yield Rows(piece.column("j"), piece.column("x"))

    def each(batches):
        for _, tile in itertools.groupby(runs(batches), key=lambda r: r[0]):
            held = []
            for one in tile:
                if one[1]:
                    if held:
                        table = pa.Table.from_batches(held).combine_chunks()
                        yield from run(Rows(table.column("i").combine_chunks(), table.column("x").combine_chunks()), pieces(itertools.chain([one], tile)), bool(one[2]))
                    break
                held.append(one[3])

    return dealt.select("i", "j", "x", "__t", "__side", (F.col("__a") == F.col("__b")).cast("int").alias("__same")).mapInArrow(each, schema)


def _guess(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean or cosine distances of the columns of x and y by a matrix product, and where they may be off by more than 1e-10."""
    xx, yy = (x * x).sum(axis=0)[:, None], (y * y).sum(axis=0)
    with np.errstate(all="ignore"):
        d = x.T @ y
        if metric == "cosine":
            d /= np.sqrt(xx * yy)
            np.subtract(1, d, out=d)
            return d, ~((xx > 1e-200) & (yy > 1e-200) & np.isfinite(d))
        d *= -2
        d += xx
        d += yy
        far = d > 1e-4 * (xx + yy)
        return np.sqrt(d, out=d), ~(far & (d < 1e3))


def _rounded_cells(x: np.ndarray, y: np.ndarray, metric: str, size: np.ndarray, decimals: int) -> np.ndarray:
    """What _rounded(cells()) gives: by a matrix product where there is one, and anew from the elements where that leaves the last digit open."""
    if metric not in ("euclidean", "cosine") or decimals > 6:
        return _rounded(cells(x, y, metric, size), decimals)
    d, off = _guess(x, y, metric)
    with np.errstate(all="ignore"):
        scaled = d * 10.0**decimals
        out = np.rint(scaled)
        # A distance off by 1e-10 moves the scaled one by 1e-4 at most.
        off |= np.abs(scaled - out) > 0.499
        out /= 10.0**decimals
    out += 0.0
    at, other = np.nonzero(off)
    for lo in range(0, len(at), CELLS):
        p, q = at[lo : lo + CELLS], other[lo : lo + CELLS]
        out[p, q] = _rounded(paired(x[:, p], y[:, q], metric), decimals)
    return out


def paired(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean or cosine distances of each column of x and the same of y, equal to those of cells()."""
    with np.errstate(all="ignore"):
        if metric == "cosine":
            xx, yy, xy = (sum((a * b for a, b in zip(u, v, strict=True)), np.zeros(x.shape[1])) for u, v in ((x, x), (y, y), (x, y)))
            return 1 - xy / np.sqrt(xx * yy)
        return np.sqrt(sum(((a - b) ** 2 for a, b in zip(x, y, strict=True)), np.zeros(x.shape[1])))


def _distances(metric: str, decimals: int | None):
    """A row (i, js, ds, same) for each left row and piece of right rows."""

    def run(left: Rows, rights, same: bool):
        for right in rights:
            n, width = len(right), max(left.x.shape[1], right.x.shape[1])
            x, y = left.by_element(width), right.by_element(width)
            step = max(1, CELLS // n)
            bad = left.bad.any() or right.bad.any() or len(np.union1d(left.size, right.size)) > 1
            ids = right.ids.take(pa.array(np.tile(np.arange(n), min(step, len(left)))))
            for lo in range(0, len(left), step):
                hi = min(lo + step, len(left))
                part, size = x[:, lo:hi], left.size[lo:hi]
                d = cells(part, y, metric, size) if decimals is None else _rounded_cells(part, y, metric, size, decimals)
                mask = (left.bad[lo:hi, None] | right.bad | (size[:, None] != right.size)).ravel() if bad else None
                edges = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * n)
                lists = [pa.ListArray.from_arrays(edges, v) for v in (ids.slice(0, (hi - lo) * n), pa.array(d.ravel(), mask=mask))]
                yield pa.RecordBatch.from_arrays([left.ids.slice(lo, hi - lo), *lists, pa.array(np.full(hi - lo, same))], ["i", "js", "ds", "same"])

    return run


def _pairs(a: DataFrame, b: DataFrame, metric: str, decimals: int | None, half: bool) -> DataFrame:
    # Rows come from Python by lists: a row for each pair would take several times as long.
    schema = f"i {a.schema['i'].dataType.simpleString()}, js array<{b.schema['i'].dataType.simpleString()}>, ds array<double>, same boolean"
    lists = tiled(a, b, _distances(metric, decimals), schema, half)
    return lists.select("i", "js", "same", F.posexplode("ds").alias("at", "d")).select("i", F.get("js", "at").alias("j"), "d", "same")


def cdist(a: DataFrame, b: DataFrame, metric: str = "euclidean", decimals: int | None = None) -> DataFrame:
    """(i, j, d) between frames (i, x), rounded if decimals are given: the result itself is the product of the two, taken in tiles."""
    return _pairs(a, b, metric, decimals, False).drop("same")


def pdist(a: DataFrame, metric: str = "euclidean", decimals: int | None = None) -> DataFrame:
    """(i, j, d) of each two rows of a frame (i, x) with i < j, taken in tiles not below the diagonal."""
    a = a.filter("i IS NOT NULL")
    return _pairs(a, a, metric, decimals, True).filter("NOT same OR i < j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")


def rank_of(c, partition=None):
    return F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(c))
