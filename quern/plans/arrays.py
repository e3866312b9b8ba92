"""Queries on arrays, statistics, learning, user functions, text de-duplication, sources and event windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quern.operators import arrays as A
from quern.operators import learn as L
from quern.operators import stats, text_dedup, udf
from quern.plans.tpch import table as T
from quern.sources import readers
from quern.streaming import windows as W

PLANS: dict = {}


def plan(sql: str | None):
    def put(run):
        PLANS[run.__name__] = (run, sql)
        return run

    return put


def _matrix(s, d):
    """Embeddings as a long matrix (i, j, v)."""
    return T(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


_M = "(SELECT vec_id AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_V = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS v FROM orders)"


def _vector(s, d):
    from quern.operators.windows import positions

    return positions(T(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")), "o_orderkey").select(F.col("position").alias("i"), "v")


@plan(f"SELECT j AS i, i AS j, v FROM {_M}")
def array_transpose(s, d):
    return A.transpose(_matrix(s, d))


@plan(f"SELECT (i * 64 + j) // 32 AS i, (i * 64 + j) % 32 AS j, v FROM {_M}")
def array_reshape(s, d):
    return A.reshape(_matrix(s, d), 64, 32)


@plan(f"SELECT j, round(sum(v), 6) AS v FROM {_M} GROUP BY 1")
def array_sum_axis0(s, d):
    return A.reduce_axis(_matrix(s, d), 0, lambda c: F.round(F.sum(c), 6))


@plan(f"SELECT i, max(v) AS v FROM {_M} GROUP BY 1")
def array_max_axis1(s, d):
    return A.reduce_axis(_matrix(s, d), 1, F.max)


@plan(f"SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 5) AS v FROM {_M} a JOIN {_M} b ON a.i = b.i GROUP BY ALL")
def array_matmul(s, d):
    m = _matrix(s, d)
    return A.matmul(A.transpose(m), m).select("i", "j", F.round("v", 5).alias("v"))


@plan(f"SELECT a.i AS a, round(sum(a.v * b.v), 5) AS v FROM {_M} a JOIN (SELECT j, avg(v) AS v FROM {_M} GROUP BY 1) b ON a.j = b.j GROUP BY 1")
def array_einsum(s, d):
    m = _matrix(s, d)
    return A.einsum("ab,b->a", m, m.groupBy("j").agg(F.avg("v").alias("v"))).select("a", F.round("v", 5).alias("v"))


@plan(f"SELECT round(sqrt(sum(v * v)), 6) AS v FROM {_M}")
def array_norm(s, d):
    return A.norm(_matrix(s, d)).select(F.round("v", 6).alias("v"))


@plan(f"SELECT round(max(x), 6) AS v FROM (SELECT i, sum(abs(v)) AS x FROM {_M} GROUP BY 1)")
def array_norm_inf(s, d):
    return A.norm(_matrix(s, d), "inf").select(F.round("v", 6).alias("v"))


@plan(f"SELECT i, j, CASE WHEN j - i >= 0 THEN v ELSE 0 END AS v FROM {_M}")
def array_triu(s, d):
    return A.triu(_matrix(s, d))


@plan(f"SELECT i, v FROM {_M} WHERE i = j")
def array_diagonal(s, d):
    return A.diagonal(_matrix(s, d))


@plan(f"SELECT round(sum(a.v * b.v), 2) AS v FROM {_V} a JOIN {_V} b ON a.i = b.i")
def array_dot(s, d):
    v = _vector(s, d)
    return A.dot(v, v).select(F.round("v", 2).alias("v"))


@plan(f"SELECT (SELECT count(*) FROM {_V}) - 1 - i AS i, v FROM {_V}")
def array_flip(s, d):
    v = _vector(s, d)
    return A.flip(v, v.count())


@plan(f"SELECT (i + 5) % (SELECT count(*) FROM {_V}) AS i, v FROM {_V}")
def array_roll(s, d):
    v = _vector(s, d)
    return A.roll(v, v.count(), 5)


@plan(f"SELECT i * 3 + r AS i, v FROM {_V}, range(3) t(r)")
def array_repeat(s, d):
    return A.repeat(_vector(s, d), 3)


@plan(f"SELECT i + r * (SELECT count(*) FROM {_V}) AS i, v FROM {_V}, range(2) t(r)")
def array_tile(s, d):
    v = _vector(s, d)
    return A.tile(v, v.count(), 2)


@plan(f"SELECT i, v FROM {_V} UNION ALL SELECT i + (SELECT count(*) FROM {_V}), -v FROM {_V}")
def array_concatenate(s, d):
    v = _vector(s, d)
    n = v.count()
    return A.concatenate([(v, n), (v.withColumn("v", -F.col("v")), n)])


@plan(f"SELECT i, round(lead(v) OVER (ORDER BY i) - v, 4) AS v FROM {_V} QUALIFY lead(v) OVER (ORDER BY i) IS NOT NULL")
def array_diff(s, d):
    return A.diff(_vector(s, d)).select("i", F.round("v", 4).alias("v"))


@plan(f"SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, i AS v FROM {_V}")
def array_argsort(s, d):
    return A.argsort(_vector(s, d))


@plan(f"SELECT i, v FROM {_V} ORDER BY v DESC, i LIMIT 25")
def array_topk(s, d):
    return A.topk(_vector(s, d), 25)


@plan(f"SELECT row_number() OVER (ORDER BY i) - 1 AS i, v FROM {_V} WHERE v > 100000")
def array_compress(s, d):
    return A.compress(_vector(s, d), F.col("v") > 100000)


@plan("SELECT p_size AS v, count(*) AS count, min(p_partkey) AS first FROM part GROUP BY 1")
def array_unique(s, d):
    return A.unique(T(s, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("v")))


@plan("SELECT p_partkey, (p_size > 10)::INT + (p_size > 20)::INT + (p_size > 40)::INT AS bin FROM part")
def array_searchsorted(s, d):
    return T(s, d, "part").select("p_partkey", A.searchsorted([10, 20, 40], F.col("p_size")).alias("bin"))


@plan("SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def array_bincount(s, d):
    return A.bincount(T(s, d, "part"), "p_size")


@plan("SELECT c_custkey AS v FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def array_setdiff(s, d):
    return A.setdiff(T(s, d, "customer").select(F.col("c_custkey").alias("v")), T(s, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("v")))


@plan("SELECT c_nationkey AS v FROM customer UNION SELECT s_nationkey FROM supplier")
def array_union1d(s, d):
    return A.union1d(T(s, d, "customer").select(F.col("c_nationkey").alias("v")), T(s, d, "supplier").select(F.col("s_nationkey").alias("v")))


@plan(f"SELECT round(sum(v) - (first(v ORDER BY i) + last(v ORDER BY i)) / 2, 2) AS v FROM {_V}")
def array_trapz(s, d):
    return A.trapz(_vector(s, d)).select(F.round("v", 2).alias("v"))


@plan(f"SELECT min(i) AS i FROM {_V} WHERE v = (SELECT max(v) FROM {_V})")
def array_argmax(s, d):
    return A.argmax(_vector(s, d))


@plan("SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS average, max(l_quantity) - min(l_quantity) AS ptp, count(*) FILTER (l_discount <> 0) AS count_nonzero FROM lineitem")
def array_average_ptp(s, d):
    return T(s, d, "lineitem").agg(F.round(A.average(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("average"), (F.max("l_quantity") - F.min("l_quantity")).alias("ptp"), F.count_if(F.col("l_discount") != 0).alias("count_nonzero"))


@plan("SELECT i, j, round(v, 6) AS v FROM (SELECT 0 AS i, 0 AS j, covar_samp(l_quantity, l_quantity) AS v FROM lineitem UNION ALL SELECT 0, 1, covar_samp(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 1, 0, covar_samp(l_tax, l_quantity) FROM lineitem UNION ALL SELECT 1, 1, covar_samp(l_tax, l_tax) FROM lineitem)")
def array_cov(s, d):
    return A.cov(T(s, d, "lineitem"), ["l_quantity", "l_tax"]).select("i", "j", F.round("v", 6).alias("v"))


@plan("SELECT i, round(-1 + i * 0.25::DOUBLE, 6) AS v FROM range(9) t(i)")
def array_linspace(s, d):
    return A.linspace(s, -1, 1, 9).select("i", F.round("v", 6).alias("v"))


@plan("SELECT i, 3 + i * 2::DOUBLE AS v FROM range(10) t(i)")
def array_arange(s, d):
    return A.arange(s, 3.0, 23.0, 2.0)


@plan("SELECT i, j, (i = j)::INT::DOUBLE AS v FROM range(12) a(i), range(12) b(j)")
def array_eye(s, d):
    return A.eye(s, 12)


@plan("SELECT i, j, j * 1::DOUBLE AS x, i * 2::DOUBLE AS y FROM range(5) a(i), range(7) b(j)")
def array_meshgrid(s, d):
    return A.meshgrid(A.arange(s, 0.0, 7.0), A.arange(s, 0.0, 10.0, 2.0))


@plan(None)
def array_fft(s, d):
    """Power of each embedding's spectrum; equal to the sum of squares by Parseval (see tests)."""
    t = A.fft(T(s, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return t.select("vec_id", F.round((A.zip_sum(F.col("fft.re"), F.col("fft.re"), lambda a, b: a * b) + A.zip_sum(F.col("fft.im"), F.col("fft.im"), lambda a, b: a * b)) / 64, 6).alias("power"))


PLANS["array_fft"] = (array_fft, "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS power FROM embeddings")


@plan("SELECT round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS energy FROM embeddings")
def array_svd(s, d):
    """The squared singular values add up to the squared Frobenius norm."""
    values, _ = A.svd(T(s, d, "embeddings"), "embedding", 64)
    return s.createDataFrame([(round(float((values**2).sum()), 4),)], "energy double")


@plan("SELECT round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS energy FROM embeddings")
def array_qr(s, d):
    r = A.qr_r(T(s, d, "embeddings"), "embedding", 64)
    return s.createDataFrame([(round(float((r**2).sum()), 4),)], "energy double")


@plan("SELECT i, j, (i = j)::INT::DOUBLE AS v FROM range(64) a(i), range(64) b(j)")
def array_inverse(s, d):
    """The Gram matrix times its inverse is the identity."""
    m = _matrix(s, d)
    g = A.matmul(A.transpose(m), m)
    return A.matmul(g, A.inverse(g, 64)).select("i", "j", F.abs(F.round("v", 4)).alias("v"))


_PAIRS = "(SELECT a.vec_id AS i, b.vec_id AS j, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"


_EVERY = "(SELECT a.vec_id AS i, b.vec_id AS j, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


def _points(s, d):
    return T(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("x"))


def _queries(s, d):
    points = _points(s, d)
    return points.filter("i % 20 = 0"), points


@plan(f"SELECT i, j, round(list_distance(x, y), 6) AS d FROM {_EVERY}")
def distance_euclidean(s, d):
    p = _points(s, d)
    return A.cdist(p, p, decimals=6).filter("i <> j")


@plan(f"SELECT i, j, round(1 - list_cosine_similarity(x, y), 6) AS d FROM {_EVERY}")
def distance_cosine(s, d):
    p = _points(s, d)
    return A.cdist(p, p, "cosine", decimals=6).filter("i <> j")


@plan(f"SELECT i, j, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 6) AS d FROM {_PAIRS}")
def distance_manhattan(s, d):
    q, p = _queries(s, d)
    return A.cdist(q, p, "manhattan", decimals=6).filter("i <> j")


@plan(f"SELECT i, rank, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY list_distance(x, y), j) AS rank FROM {_PAIRS}) WHERE rank <= 5")
def nearest_neighbors(s, d):
    q, p = _queries(s, d)
    return L.nearest_neighbors(q, p, 5, others=True).select("i", F.col("rank").cast("long").alias("rank"), "j")


@plan("SELECT i, j, (i = j)::INT::DOUBLE AS v FROM range(64) a(i), range(64) b(j)")
def array_cholesky(s, d):
    """The inverse of the factor times the matrix times the inverse's transpose is the identity."""
    m = _matrix(s, d)
    g = A.matmul(A.transpose(m), m)
    inv = A.inverse(A.cholesky(g, 64), 64)
    return A.matmul(A.matmul(inv, g), A.transpose(inv)).select("i", "j", F.abs(F.round("v", 4)).alias("v"))


@plan(f"SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 5) AS v FROM {_M} a JOIN {_M} b ON a.i = b.i GROUP BY ALL")
def array_tensordot(s, d):
    m = _matrix(s, d)
    return A.einsum("ab,ac->bc", m, m).select(F.col("b").alias("i"), F.col("c").alias("j"), F.round("v", 5).alias("v"))


@plan(f"SELECT i // 2 AS i, j, v FROM {_M} WHERE i % 2 = 0 UNION ALL SELECT i + 1000, j, v FROM {_M} WHERE i % 2 = 1")
def array_vstack(s, d):
    m = _matrix(s, d)
    return A.vstack([(m.filter("i % 2 = 0").withColumn("i", F.floor(F.col("i") / 2)), 1000), (m.filter("i % 2 = 1"), 1)])


@plan(f"SELECT i, i // 100 AS r, i % 100 AS c FROM {_V}")
def array_unravel_index(s, d):
    return A.unravel_index(_vector(s, d), 100)


@plan(f"SELECT i, 0.0::DOUBLE AS z, 1.0::DOUBLE AS o, 7.5::DOUBLE AS f FROM {_V}")
def array_like(s, d):
    v = _vector(s, d)
    return A.zeros_like(v).withColumnRenamed("v", "z").join(A.ones_like(v).withColumnRenamed("v", "o"), "i").join(A.full_like(v, 7.5).withColumnRenamed("v", "f"), "i")


@plan("SELECT i, j, (j - i <= 2)::INT::DOUBLE AS v FROM range(40) a(i), range(50) b(j)")
def array_tri(s, d):
    return A.tri(s, 40, 50, 2)


@plan("SELECT i, j, i AS row, j AS col FROM range(30) a(i), range(20) b(j)")
def array_indices(s, d):
    return A.indices(s, (30, 20))


@plan(f"SELECT i, i + 3 AS j, v FROM {_V}")
def array_diagflat(s, d):
    return A.diagflat(_vector(s, d), 3)


@plan(f"SELECT i, j, CASE WHEN i = j THEN 5.0 ELSE v END AS v FROM {_M}")
def array_fill_diagonal(s, d):
    return A.fill_diagonal(_matrix(s, d), 5.0)


@plan(f"SELECT r AS i, i AS j, v FROM {_V}, range(3) t(r)")
def array_broadcast_to(s, d):
    return A.broadcast_to(_vector(s, d), 3)


@plan(f"SELECT i, 0::BIGINT AS j, v FROM {_V}")
def array_expand_dims(s, d):
    return A.expand_dims(A.squeeze(A.expand_dims(_vector(s, d), 0)), 1)


@plan(f"WITH n AS (SELECT count(*) AS n FROM {_V}) SELECT p - 1 AS part, row_number() OVER (PARTITION BY p ORDER BY i) - 1 AS i, v FROM (SELECT ntile(7) OVER (ORDER BY i) AS p, i, v FROM {_V})")
def array_split(s, d):
    v = _vector(s, d)
    return A.split(v, v.count(), 7)


@plan(f"SELECT CASE WHEN i >= 5 THEN i + 2 ELSE i END AS i, v FROM {_V} UNION ALL SELECT * FROM (VALUES (5, 1.5), (6, 2.5)) t(i, v)")
def array_insert(s, d):
    return A.insert(_vector(s, d), 5, [1.5, 2.5])


@plan(f"SELECT i, CASE i % 3 WHEN 0 THEN v WHEN 1 THEN -v ELSE 2 * v END AS v FROM {_V}")
def array_choose(s, d):
    v = _vector(s, d)
    return A.choose(v.select("i", (F.col("i") % 3).alias("v")), [v, v.withColumn("v", -F.col("v")), v.withColumn("v", 2 * F.col("v"))])


@plan(f"SELECT row_number() OVER (ORDER BY v DESC, i) - 1 AS rank, i FROM {_V} ORDER BY v DESC, i LIMIT 20")
def array_argtopk(s, d):
    return A.argtopk(_vector(s, d), 20)


@plan(f"SELECT i, j FROM {_M} WHERE v <> 0")
def array_argwhere(s, d):
    return A.argwhere(_matrix(s, d))


@plan(f"SELECT i * 64 + j AS i FROM {_M} WHERE v <> 0")
def array_flatnonzero(s, d):
    return A.flatnonzero(_matrix(s, d), 64)


@plan(f"SELECT count(*) FILTER (v > 0) AS positive, count(*) FILTER (v <> 0) AS n FROM {_M}")
def array_count_nonzero(s, d):
    m = _matrix(s, d)
    return A.count_nonzero(m.withColumn("v", (F.col("v") > 0).cast("double"))).withColumnRenamed("n", "positive").join(A.count_nonzero(m))


@plan(f"SELECT true AS close, false AS equal FROM {_V} LIMIT 1")
def array_allclose(s, d):
    v = _vector(s, d)
    w = v.withColumn("v", F.col("v") * (1 + 1e-9))
    return A.allclose(v, w).join(A.array_equal(v, w))


@plan(f"SELECT arg_min(i, (v, i)) AS i FROM {_V} WHERE i <> 3")
def array_nanargmin(s, d):
    return A.nanargmin(_vector(s, d).withColumn("v", F.when(F.col("i") != 3, F.col("v")))).select("i")


@plan("SELECT i, lo + (hi - lo) * i / 12 AS edge FROM (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), range(13) t(i)")
def array_histogram_bin_edges(s, d):
    return A.histogram_bin_edges(T(s, d, "lineitem"), "l_quantity", 12)


@plan("SELECT i::INT AS i, j::INT AS j, round(corr(CASE i WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice ELSE l_tax END, CASE j WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice ELSE l_tax END), 6) AS v FROM lineitem, range(3) a(i), range(3) b(j) GROUP BY 1, 2")
def array_corrcoef(s, d):
    return A.corrcoef(T(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select("i", "j", F.round("v", 6).alias("v"))


@plan("SELECT a.s_suppkey AS i, b.s_suppkey AS j, abs(a.s_nationkey - b.s_nationkey)::DOUBLE AS v FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey")
def array_squareform(s, d):
    points = T(s, d, "supplier").select(F.col("s_suppkey").alias("i"), F.array(F.col("s_nationkey").cast("double")).alias("x"))
    return A.squareform(A.pdist(points, "manhattan"))


@plan("SELECT i, CASE WHEN i < 51 THEN i ELSE i - 101 END / 50.5 AS f FROM range(101) t(i)")
def array_fftfreq(s, d):
    return A.fftfreq(s, 101, 0.5)


@plan(f"WITH n AS (SELECT count(*) AS n FROM {_V}) SELECT (i + n // 2) % n AS i, v FROM {_V}, n")
def array_fftshift(s, d):
    v = _vector(s, d)
    return A.fftshift(v, v.count())


@plan("SELECT i, round((i + 1) * 0.5, 6) AS v FROM range(32) t(i)")
def array_solve_triangular(s, d):
    """A lower triangular system whose solution is known."""
    m = A.tri(s, 32).withColumn("v", F.when(F.col("j") <= F.col("i"), (F.col("i") + 2 * F.col("j") + 1).cast("double")).otherwise(0.0))
    x = s.range(32).select(F.col("id").alias("j"), ((F.col("id") + 1) * 0.5).alias("v"))
    right = A.einsum("ab,b->a", m, x).select(F.col("a").alias("i"), "v")
    return A.solve_triangular(m, right, 32).select("i", F.round("v", 6).alias("v"))


@plan("SELECT true AS same FROM embeddings LIMIT 1")
def array_randomized_svd(s, d):
    """With as many values as dimensions the singular values are those of the whole decomposition."""
    t = T(s, d, "embeddings")
    some, _ = A.randomized_svd(t, "embedding", 64, 64)
    every, _ = A.svd(t, "embedding", 64)
    return s.createDataFrame([(bool(abs(some - every).max() < 1e-6 * every.max()),)], "same boolean")


@plan("SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS average, rank() OVER (ORDER BY o_custkey)::DOUBLE AS low, dense_rank() OVER (ORDER BY o_custkey)::DOUBLE AS dense FROM orders")
def stats_rankdata(s, d):
    t = T(s, d, "orders").select("o_orderkey", "o_custkey")
    return stats.rankdata(stats.rankdata(stats.rankdata(t, "o_custkey", "average", "average"), "o_custkey", "min", "low"), "o_custkey", "dense", "dense").select("o_orderkey", "average", "low", "dense")


@plan("WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS u, (SELECT count(*) FROM lineitem) AS t FROM c) SELECT round(max(greatest(u / t - least(v / 50, 1), least(v / 50, 1) - (u - n) / t)), 8) AS statistic FROM r")
def ks_1samp(s, d):
    return stats.ks_1samp(T(s, d, "lineitem"), "l_quantity", lambda v: F.least(v / 50, F.lit(1.0))).select(F.round("statistic", 8).alias("statistic"))


_TWO = "SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS m1, stddev_samp(l_quantity) FILTER (l_returnflag = 'A') AS s1, count(*) FILTER (l_returnflag = 'A') AS n1, avg(l_quantity) FILTER (l_returnflag = 'R') AS m2, stddev_samp(l_quantity) FILTER (l_returnflag = 'R') AS s2, count(*) FILTER (l_returnflag = 'R') AS n2 FROM lineitem"


@plan(f"SELECT round((m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2), 6) AS t, round(power(s1 * s1 / n1 + s2 * s2 / n2, 2) / (power(s1 * s1 / n1, 2) / (n1 - 1) + power(s2 * s2 / n2, 2) / (n2 - 1)), 4) AS df FROM ({_TWO})")
def ttest_ind_from_stats(s, d):
    t, of = T(s, d, "lineitem"), lambda f: F.when(F.col("l_returnflag") == f, F.col("l_quantity"))
    two = t.agg(*[g(of(f)).alias(f"{n}{i}") for i, f in ((1, "A"), (2, "R")) for n, g in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    return stats.ttest_ind_from_stats(two, "m1", "s1", "n1", "m2", "s2", "n2", equal_var=False).select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@plan("WITH x AS (SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS p FROM orders), l AS (SELECT y AS label FROM x UNION SELECT p FROM x) SELECT label, count(*) FILTER (y <> label AND p <> label) AS tn, count(*) FILTER (y <> label AND p = label) AS fp, count(*) FILTER (y = label AND p <> label) AS fn, count(*) FILTER (y = label AND p = label) AS tp FROM x, l GROUP BY 1")
def metrics_multilabel_confusion(s, d):
    t = T(s, d, "orders").select(F.col("o_orderstatus").alias("y"), F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("p"))
    return L.multilabel_confusion(t, "y", "p")


@plan("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def label_encoder(s, d):
    t = T(s, d, "orders")
    return t.select("o_orderkey", L.LabelEncoder().fit(t, "o_orderpriority").transform(F.col("o_orderpriority")).alias("code"))


@plan("SELECT vec_id AS i, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def row_norms(s, d):
    return T(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.round(L.row_norms(F.col("embedding")), 6).alias("norm"))


@plan(f"SELECT i, j, 1.0::DOUBLE AS v FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY list_distance(x, y), j) AS rank FROM {_PAIRS}) WHERE rank <= 4")
def kneighbors_graph(s, d):
    q, p = _queries(s, d)
    return L.kneighbors_graph(q, p, 4, others=True)


@plan(f"SELECT row_number() OVER (ORDER BY i) - 1 AS i, v FROM {_V} WHERE i NOT IN (0, 5, 9)")
def array_delete(s, d):
    return A.delete(_vector(s, d), [0, 5, 9])


@plan(f"SELECT p.i * 7 AS at, q.v FROM range(100) p(i) JOIN {_V} q ON q.i = p.i * 7")
def array_take(s, d):
    places = s.range(100).select((F.col("id") * 7).alias("i"), (F.col("id") * 7).alias("at"))
    return A.take(_vector(s, d), places).select(F.col("i").alias("at"), "v")


@plan("SELECT least(floor(l_discount / 0.02), 4)::INT AS bin, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY 1")
def array_histogram(s, d):
    return stats.histogram(T(s, d, "lineitem"), "l_discount", 5, 0.0, 0.1)


# Hypothesis tests.


@plan("SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM lineitem")
def ttest_1samp(s, d):
    return stats.ttest_1samp(T(s, d, "lineitem"), "l_quantity", 25.0).select(F.round("t", 6).alias("t"), "df")


@plan("WITH g AS (SELECT avg(v) FILTER (a) AS m1, avg(v) FILTER (NOT a) AS m2, var_samp(v) FILTER (a) AS v1, var_samp(v) FILTER (NOT a) AS v2, count(*) FILTER (a) AS n, count(*) FILTER (NOT a) AS m FROM (SELECT l_quantity AS v, l_returnflag = 'R' AS a FROM lineitem)) SELECT round((m1 - m2) / sqrt(((n - 1) * v1 + (m - 1) * v2) / (n + m - 2) * (1.0 / n + 1.0 / m)), 6) AS t, (n + m - 2)::DOUBLE AS df FROM g")
def ttest_ind(s, d):
    return stats.ttest_ind(T(s, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select(F.round("t", 6).alias("t"), "df")


@plan("WITH x AS (SELECT l_discount - l_tax AS v FROM lineitem) SELECT round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 5) AS t, (count(*) - 1)::DOUBLE AS df FROM x")
def ttest_rel(s, d):
    return stats.ttest_rel(T(s, d, "lineitem"), "l_discount", "l_tax").select(F.round("t", 5).alias("t"), "df")


@plan("WITH f AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT round(sum(n * n) * count(*) / sum(n) - sum(n), 8) AS chi2, count(*) - 1 AS df FROM f")
def chisquare(s, d):
    f = T(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    return stats.chisquare(f, "n").select(F.round("chi2", 8).alias("chi2"), "df")


@plan("WITH f AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 8) AS entropy FROM f")
def entropy(s, d):
    f = T(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("n"))
    return stats.entropy(f, "n").select(F.round("entropy", 8).alias("entropy"))


@plan("WITH x AS (SELECT l_extendedprice AS v, (l_returnflag = 'R')::INT AS a FROM lineitem), c AS (SELECT v, sum(sum(a)) OVER (ORDER BY v) / (SELECT sum(a) FROM x) AS f, sum(sum(1 - a)) OVER (ORDER BY v) / (SELECT sum(1 - a) FROM x) AS g FROM x GROUP BY v) SELECT round(max(abs(f - g)), 8) AS d FROM c")
def ks_2samp(s, d):
    return stats.ks_2samp(T(s, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R").select(F.round("d", 8).alias("d"))


# Metrics, preprocessing, models.


@plan("SELECT round(avg((quality = 1 - toxic)::INT), 8) AS accuracy, round(-avg(CASE WHEN toxic = 1 THEN ln(0.2 + 0.3 * (1 - quality)) ELSE ln(1 - (0.2 + 0.3 * (1 - quality))) END), 8) AS log_loss FROM labels")
def metrics_accuracy_log_loss(s, d):
    t = T(s, d, "labels").withColumns({"p": 1 - F.col("toxic"), "q": 0.2 + 0.3 * (1 - F.col("quality"))})
    return t.agg(F.round(L.accuracy("quality", "p"), 8).alias("accuracy"), F.round(L.log_loss("toxic", "q"), 8).alias("log_loss"))


@plan("SELECT label, round(tp / nullif(p, 0), 8) AS precision, round(tp / nullif(t, 0), 8) AS recall, round(2 * tp / (p + t), 8) AS fbeta, t AS support FROM (SELECT label, count(*) FILTER (quality = label) AS t, count(*) FILTER (1 - toxic = label) AS p, count(*) FILTER (quality = label AND 1 - toxic = label) AS tp FROM labels, (VALUES (0), (1)) l(label) GROUP BY 1)")
def metrics_precision_recall(s, d):
    t = T(s, d, "labels").withColumn("p", 1 - F.col("toxic"))
    return L.precision_recall_f(t, "quality", "p").select("label", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "fbeta")], "support")


@plan("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def metrics_confusion(s, d):
    return L.confusion(T(s, d, "labels"), "quality", "toxic")


@plan("WITH x AS (SELECT toxic AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)) SELECT round(sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*), 8) AS auc FROM x p JOIN x n ON p.y = 1 AND n.y = 0")
def metrics_roc_auc(s, d):
    x = T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return L.roc_auc(x, "toxic", "n_chars").select(F.round("auc", 8).alias("auc"))


@plan("WITH x AS (SELECT toxic AS y, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id)) SELECT s AS threshold, round(sum(sum(y)) OVER w / (SELECT sum(y) FROM x), 8) AS tpr, round(sum(sum(1 - y)) OVER w / (SELECT sum(1 - y) FROM x), 8) AS fpr FROM x GROUP BY s WINDOW w AS (ORDER BY s DESC)")
def metrics_roc_curve(s, d):
    x = T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return L.roc_curve(x, "toxic", "n_chars").select("threshold", F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


@plan("SELECT round(1 - sum((o_totalprice - m) * (o_totalprice - m)) / (var_pop(o_totalprice) * count(*)), 8) AS r2 FROM orders, (SELECT o_orderpriority AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1) WHERE k = o_orderpriority")
def metrics_r2(s, d):
    from quern.operators.grouping import transform

    return transform(T(s, d, "orders"), ["o_orderpriority"], m=("o_totalprice", "mean")).agg(F.round(L.r2("o_totalprice", "m"), 8).alias("r2"))


@plan("SELECT p_partkey, round((p_retailprice - a) / (b - a), 8) AS p_retailprice FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)")
def minmax_scale(s, d):
    return L.minmax_scale(T(s, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", F.round("p_retailprice", 8))


@plan("SELECT vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 8) AS first FROM embeddings")
def normalize_rows(s, d):
    return T(s, d, "embeddings").select("vec_id", F.round(L.normalize(F.col("embedding"))[0], 8).alias("first"))


@plan("SELECT doc_id, (lang = 'en')::INT AS en, (lang = 'fr')::INT AS fr FROM documents")
def label_binarize(s, d):
    b = L.label_binarize(F.col("lang"), ["en", "fr"])
    return T(s, d, "documents").select("doc_id", b[0].alias("en"), b[1].alias("fr"))


@plan("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def linear_regression(s, d):
    m = L.LinearRegression().fit(T(s, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return s.createDataFrame([(round(float(m.coef[0]), 6), round(m.intercept, 3))], "slope double, intercept double")


@plan(None)
def logistic_regression(s, d):
    x = T(s, d, "labels").join(T(s, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("size")), "doc_id")
    m = L.LogisticRegression().fit(x, ["size", "quality"], "toxic")
    return m.predict_proba(x).select("doc_id", F.round("probability", 6).alias("probability"))


@plan(None)
def kmeans(s, d):
    e = T(s, d, "embeddings")
    return L.KMeans(8).fit(e, "embedding", "vec_id").predict(e, "embedding").select("vec_id", "cluster")


@plan(None)
def pca(s, d):
    e = T(s, d, "embeddings")
    return L.PCA(2).fit(e, "embedding", 64).transform(e, "embedding").select("vec_id", "projected")


@plan(None)
def random_normal(s, d):
    return A.random(s, "normal", 100_000, 7, 0.0, 1.0)


@plan(None)
def kfold(s, d):
    return L.kfold(T(s, d, "orders").select("o_orderkey"), "o_orderkey", 5)


# User functions.


@plan("SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE -1 END AS code FROM events")
def map_values(s, d):
    return T(s, d, "events").select("event_id", udf.map_values(F.col("event_type"), {"view": 1, "click": 2}, -1).alias("code"))


@plan("SELECT p_partkey, length(p_name) * 2 AS n FROM part")
def map_series(s, d):
    return T(s, d, "part").select("p_partkey", udf.map_series(F.col("p_name"), lambda v: len(v) * 2, "long").alias("n"))


@plan("SELECT s_suppkey, round(s_acctbal / 2, 4) AS half FROM supplier")
def apply_rows(s, d):
    return udf.apply_rows(T(s, d, "supplier").select("s_suppkey", "s_acctbal"), lambda r: (int(r["s_suppkey"]), round(r["s_acctbal"] / 2, 4)), "s_suppkey long, half double")


@plan("SELECT event_id, value * 2 AS twice FROM events")
def map_chunk(s, d):
    return udf.map_chunk(T(s, d, "events").select("event_id", "value"), lambda p: pd.DataFrame({"event_id": p["event_id"], "twice": p["value"] * 2}), "event_id long, twice double")


@plan("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_suppkey % 25 = n_nationkey")
def cartesian_chunk(s, d):
    def pair(a, b):
        x = a.merge(b, how="cross")
        return x[x["s_suppkey"] % 25 == x["n_nationkey"]][["s_suppkey", "n_nationkey"]]

    return udf.cartesian_chunk(T(s, d, "supplier").select("s_suppkey"), T(s, d, "nation").select("n_nationkey"), pair, "s_suppkey long, n_nationkey int", 2)


@plan("SELECT i, i * i AS square FROM range(8) t(i)")
def spawn_tasks(s, d):
    return udf.spawn(s, lambda i: {"i": [i], "square": [i * i]}, list(range(8)), "i long, square long")


@plan("SELECT o_orderkey, o_custkey FROM orders")
def rebalance(s, d):
    return udf.rebalance(T(s, d, "orders").select("o_orderkey", "o_custkey"))


# Text de-duplication, sources, event time.


@plan("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def text_dedup_exact(s, d):
    return text_dedup.exact(T(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@plan(None)
def text_dedup_minhash(s, d):
    return text_dedup.minhash(T(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@plan("SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS t")
def date_range(s, d):
    return readers.date_range(s, "2024-01-01", "2024-03-01")


@plan("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(s, d):
    t = W.tumbling(T(s, d, "events"), "ts", "6 hours", ["event_type"], n=("event_id", F.count), total=("value", F.sum))
    return t.withColumn("total", F.round("total", 4))


@plan("WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM x) SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, s")
def window_sessions(s, d):
    return W.sessions(T(s, d, "events"), "ts", "2 hours", ["user_id"], n=("event_id", F.count))


@plan("SELECT DISTINCT user_id, event_type FROM events")
def distinct_events(s, d):
    return W.distinct_events(T(s, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type")


