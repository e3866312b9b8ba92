"""Operators on small frames with missing values, ties and empty input, against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import elementwise as E
from quern.functions import strings as S
from quern.operators import arrays, combine, expressions, grouping, joins, learn, missing, order, reshape, stats, text_dedup, udf, windows
from quern.sources import readers, writers


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"i": range(60), "k": rng.choice(["a", "b", None], 60), "v": np.where(rng.rand(60) < 0.2, np.nan, rng.rand(60)), "n": rng.randint(0, 5, 60)})
    return pdf, missing.normalise(spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "NaN", F.col("k")))).repartition(3)


def test_group_reductions(frame):
    pdf, df = frame
    got = grouping.agg(df, ["k"], s=("v", "sum"), sk=("v", "skew"), ku=("v", "kurt"), se=("v", "sem"), nu=("n", "nunique")).toPandas().set_index("k").sort_index()
    g = pdf.groupby("k")
    want = pd.DataFrame({"s": g["v"].sum(), "sk": g["v"].skew(), "ku": g["v"].apply(pd.Series.kurt), "se": g["v"].sem(), "nu": g["n"].nunique()})
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9)


@pytest.mark.parametrize("how", ["cumsum", "cummax", "cummin", "cumprod"])
def test_global_cumulative(frame, how):
    pdf, df = frame
    got = windows.cumulative(df, "i", c=("v", how)).toPandas().sort_values("i")["c"]
    np.testing.assert_allclose(got.to_numpy(float), getattr(pdf["v"], how)().to_numpy())


def test_global_ffill_and_positions(frame):
    pdf, df = frame
    got = windows.positions(windows.cumulative(df, "i", f=("v", "ffill")), "i").toPandas().sort_values("i")
    np.testing.assert_allclose(got["f"].to_numpy(float), pdf["v"].ffill().to_numpy())
    assert got["position"].tolist() == list(range(60))


@pytest.mark.parametrize("center", [False, True])
def test_rolling(frame, center):
    pdf, df = frame
    got = df.select("i", windows.rolling([], ["i"], 4, "v", "mean", 2, center).alias("r")).toPandas().sort_values("i")["r"]
    np.testing.assert_allclose(got.to_numpy(float), pdf["v"].rolling(4, 2, center=center).mean().to_numpy())


def test_chunked_rolling_and_shift(frame):
    pdf, df = frame
    t = windows.positions(df, "i")
    got = windows.over_rows(t, "position", 3, 0, lambda w: {"r": F.sum("n").over(w.rowsBetween(-3, 0)), "b": F.lag("n", 3).over(w)}, chunk=7).toPandas().sort_values("i")
    np.testing.assert_allclose(got["r"].to_numpy(float), pdf["n"].rolling(4, 1).sum().to_numpy())
    np.testing.assert_allclose(got["b"].to_numpy(float), pdf["n"].shift(3).to_numpy())


@pytest.mark.parametrize("how", ["mean", "var", "std"])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm(frame, how, adjust):
    pdf, df = frame
    got = windows.ewm(df.fillna({"k": "z"}), ["k"], ["i"], "v", 0.3, how=how, adjust=adjust).toPandas().sort_values("i")["ewm"]
    want = pdf.fillna({"k": "z"}).groupby("k", group_keys=False)["v"].apply(lambda x: getattr(x.ewm(alpha=0.3, adjust=adjust), how)()).sort_index()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), rtol=1e-6, atol=1e-9)


def test_merge_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, v string")
    got = {tuple(r) for r in joins.merge(a, b, "outer", on="k", indicator=True).collect()}
    assert got == {(1, "x", "p", "both"), (None, "y", "q", "both"), (2, "z", None, "left_only"), (3, None, "r", "right_only")}


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof(spark, direction, exact):
    rng = np.random.RandomState(1)
    a = pd.DataFrame({"t": np.sort(rng.randint(0, 50, 30)), "g": rng.randint(0, 2, 30), "i": range(30)})
    b = pd.DataFrame({"t": np.sort(rng.choice(50, 20, replace=False)), "g": rng.randint(0, 2, 20), "w": rng.rand(20)})
    want = pd.merge_asof(a, b, on="t", by="g", direction=direction, allow_exact_matches=exact).sort_values("i")["w"]
    got = joins.asof(spark.createDataFrame(a), spark.createDataFrame(b), "t", ["g"], ["w"], direction, exact).toPandas().sort_values("i")["w"]
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy())


def test_duplicates_keep(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, o int")
    for keep, want in (("first", {1, 3}), ("last", {2, 3}), (False, {3})):
        assert {r.o for r in combine.drop_duplicates(df, ["k"], ["o"], keep).collect()} == want


def test_query_expressions(frame):
    pdf, df = frame
    limit = 2
    got = expressions.query(df, "n > @limit and not v < 0.5 or n in [0, 1]", {"limit": limit})
    v = pdf["v"]
    assert {r.i for r in got.collect()} == set(pdf.index[((pdf["n"] > limit) & v.notna() & ~(v < 0.5)) | pdf["n"].isin([0, 1])])
    assert expressions.eval_(df, "w = n // 2 + n % 3").filter("w <> floor(n / 2) + n % 3").count() == 0
    with pytest.raises(NameError):
        expressions.query(df, "absent > 1")


def test_missing_and_reshape(frame):
    pdf, df = frame
    assert missing.dropna(df).count() == len(pdf.dropna())
    assert df.filter(missing.isna("v")).count() == pdf["v"].isna().sum()
    wide = reshape.pivot_table(df, ["n"], "k", "v", ["a", "b"], "mean").toPandas().set_index("n").sort_index()
    want = pdf.pivot_table(index="n", columns="k", values="v", aggfunc="mean")
    np.testing.assert_allclose(wide[["a", "b"]].to_numpy(float), want[["a", "b"]].to_numpy())
    with pytest.raises(Exception, match="repeated entry"):
        reshape.pivot(df, ["n"], "k", "v", ["a", "b"]).collect()


def test_top_k_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 3, 5, 1, 3])], "i int, v int")
    assert [r.i for r in order.nlargest(df, 3, ["v"], order=["i"]).collect()] == [0, 2, 1]
    assert {r.i for r in order.nlargest(df, 3, ["v"], "last", ["i"]).collect()} == {0, 2, 4}
    assert {r.i for r in order.nlargest(df, 3, ["v"], "all").collect()} == {0, 2, 1, 4}


def test_statistics(frame):
    pdf, df = frame
    v = pdf["v"].dropna()
    for how in ("linear", "lower", "higher", "midpoint", "nearest"):
        got = df.agg(stats.quantile("v", 0.37, how).alias("q")).first().q
        assert got == pytest.approx(v.quantile(0.37, interpolation=how))
    assert df.agg(stats.variance("v", 0).alias("x")).first().x == pytest.approx(v.var(ddof=0))
    assert stats.is_monotonic(df, "i", "i").first().monotonic
    assert not stats.is_monotonic(df, "i", "n").first().monotonic
    assert {r.n for r in stats.mode(df, "n").collect()} == set(pdf["n"].mode())


def test_empty_frames(spark):
    df = spark.createDataFrame([], "i int, k string, v double")
    assert windows.cumulative(df, "i", c=("v", "cumsum")).count() == 0
    assert windows.positions(df, "i").count() == 0
    assert grouping.agg(df, ["k"], s=("v", "sum")).count() == 0
    assert stats.aggregate(df, s=("v", "sum"), p=("v", "prod")).first() == (0.0, 1.0)
    assert joins.merge(df, df, "outer", on="i").count() == 0


def test_division_and_domains(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (-7.0, 3.0), (None, 1.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    got = df.select(E.divide(x, y).alias("d"), E.mod(x, y).alias("m"), E.log(x).alias("l"), E.floor_divide(x, y).alias("f")).toPandas()
    with np.errstate(all="ignore"):
        a, b = np.array([1.0, -1.0, 0.0, -7.0, np.nan]), np.array([0.0, 0.0, 0.0, 3.0, 1.0])
        np.testing.assert_allclose(got["d"].to_numpy(float), a / b)
        np.testing.assert_allclose(got["m"].to_numpy(float), np.mod(a, b))
        np.testing.assert_allclose(got["l"].to_numpy(float), np.log(a))


def test_strings(spark):
    words = ["o'neil a1b", "ABC def", "", "-42", "x" * 12, "é.é"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, s string")
    s, p = F.col("s"), pd.Series(words)
    checks = {"title": (S.title(s), p.str.title()), "center": (S.center(s, 9, "*"), p.str.center(9, "*")), "zfill": (S.zfill(s, 6), p.str.zfill(6)), "swap": (S.swapcase(s), p.str.swapcase()), "rfind": (S.rfind(s, "e"), p.str.rfind("e")), "slice": (S.slice_(s, -4, -1), p.str.slice(-4, -1)), "cap": (S.capitalize(s), p.str.capitalize()), "rsplit": (F.array_join(S.rsplit(s, " ", 1), "|"), p.str.rsplit(" ", n=1).str.join("|"))}
    got = df.select("i", *[c.alias(k) for k, (c, _) in checks.items()]).toPandas().sort_values("i")
    for k, (_, want) in checks.items():
        assert got[k].tolist() == want.tolist(), k


def test_special_functions(spark):
    import math

    df = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 2.5, 3.5, 5.0)], "x double")
    for r in df.select("x", E.erf(F.col("x")).alias("erf"), E.erfc(F.col("x")).alias("erfc"), E.gammaln(F.col("x")).alias("g"), E.i0(F.col("x")).alias("i0")).collect():
        assert r.erf == pytest.approx(math.erf(r.x), rel=1e-9)
        assert r.erfc == pytest.approx(math.erfc(r.x), rel=1e-6)
        assert r.g == pytest.approx(math.lgamma(r.x), abs=1e-12)
        assert r.i0 == pytest.approx(float(np.i0(r.x)), rel=1e-9)


def test_more_special_functions(spark):
    import math

    r = spark.range(1).select(
        E.gammainc(F.lit(2.5), F.lit(1.7)).alias("gi"), E.gammainc(F.lit(2.5), F.lit(9.0)).alias("gi2"), E.betainc(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("bi"), E.ellipk(F.lit(0.5)).alias("k"), E.ellipe(F.lit(0.5)).alias("e"),
        E.jv(0, F.lit(2.0)).alias("j0"), E.jv(1, F.lit(2.0)).alias("j1"), E.iv(1, F.lit(1.5)).alias("i1"), E.erfinv(F.lit(0.3)).alias("ei"), E.chi2_sf(F.lit(3.84), F.lit(1)).alias("c"), E.t_sf(F.lit(2.0), F.lit(10)).alias("t"), E.digamma(F.lit(1.0)).alias("d"),
    ).first()
    x = np.linspace(0, 1.7, 400_001)
    assert r.gi == pytest.approx(np.trapezoid(x**1.5 * np.exp(-x), x) / math.gamma(2.5), rel=1e-6)
    x = np.linspace(0, 9.0, 400_001)
    assert r.gi2 == pytest.approx(np.trapezoid(x**1.5 * np.exp(-x), x) / math.gamma(2.5), rel=1e-6)
    assert r.bi == pytest.approx(0.5248, abs=1e-9)
    assert r.k == pytest.approx(1.8540746773013719) and r.e == pytest.approx(1.3506438810476755)
    assert r.j0 == pytest.approx(0.22389077914123567) and r.j1 == pytest.approx(0.5767248077568734) and r.i1 == pytest.approx(0.9816664285779076)
    assert math.erf(r.ei) == pytest.approx(0.3) and r.c == pytest.approx(0.05004, abs=1e-4) and r.t == pytest.approx(0.036694, abs=1e-5) and r.d == pytest.approx(-0.5772156649015329)


@pytest.mark.parametrize("name", ["beta", "binomial", "chisquare", "exponential", "f", "gamma", "geometric", "gumbel", "hypergeometric", "laplace", "logistic", "lognormal", "logseries", "negative_binomial", "noncentral_chisquare", "noncentral_f", "normal", "pareto", "poisson", "power", "random", "rayleigh", "standard_cauchy", "standard_exponential", "standard_gamma", "standard_normal", "standard_t", "triangular", "uniform", "vonmises", "wald", "weibull", "zipf", "integers"])
def test_distributions(spark, name):
    args = {"beta": (1, 2), "binomial": (9, 0.5), "chisquare": (3,), "f": (3, 9), "gamma": (2,), "geometric": (0.4,), "hypergeometric": (5, 6, 4), "logseries": (0.5,), "negative_binomial": (3, 0.5), "noncentral_chisquare": (3, 1), "noncentral_f": (3, 9, 1), "pareto": (3,), "power": (2,), "standard_gamma": (2,), "standard_t": (5,), "triangular": (0, 1, 2), "vonmises": (0, 1), "wald": (1, 1), "weibull": (2,), "zipf": (3,), "integers": (0, 9)}.get(name, ())
    assert arrays.random(spark, name, 50, 1, *args, parts=1).filter("v IS NOT NULL").count() == 50


def test_lu(spark):
    m = np.random.RandomState(5).rand(4, 4)
    long = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(4) for j in range(4)], "i long, j long, v double")
    p, low, up = arrays.lu(long, 4)
    got = arrays.matmul(arrays.matmul(p, low), up).toPandas()
    back = np.zeros((4, 4))
    back[got["i"], got["j"]] = got["v"]
    np.testing.assert_allclose(back, m, atol=1e-12)


def test_linear_algebra(spark):
    x = np.random.RandomState(0).rand(40, 3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    values, vectors = arrays.svd(df, "x", 3)
    np.testing.assert_allclose(values, np.linalg.svd(x)[1], rtol=1e-8)
    np.testing.assert_allclose(np.abs(arrays.qr_r(df, "x", 3)), np.abs(np.linalg.qr(x)[1]), rtol=1e-8)
    pca = learn.PCA(2).fit(df, "x", 3)
    np.testing.assert_allclose(pca.explained_variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2])
    near = learn.nearest_neighbors(df, df, 3).filter("rank = 2").toPandas().sort_values("i")
    d = np.linalg.norm(x[:, None] - x, axis=2)
    np.testing.assert_allclose(near["d"], np.sort(d, axis=1)[:, 1], rtol=1e-6)


def test_random_does_not_depend_on_partitions(spark):
    a = arrays.random(spark, "gamma", 40_000, 3, 2.0, parts=2).toPandas().sort_values("i")["v"].to_numpy()
    b = arrays.random(spark, "gamma", 40_000, 3, 2.0, parts=7).toPandas().sort_values("i")["v"].to_numpy()
    assert (a == b).all()
    assert a.mean() == pytest.approx(2.0, rel=0.05)


def test_models(spark):
    rng = np.random.RandomState(2)
    x = rng.randn(500, 2)
    y = (x @ [2.0, -1.0] + 0.5 + 0.5 * rng.randn(500) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "z": x @ [3.0, 4.0] + 1}))
    m = learn.LogisticRegression().fit(df, ["a", "b"], "y")
    assert m.predict_proba(df).filter("(probability > 0.5) = (y = 1)").count() > 430
    r = learn.LinearRegression().fit(df, ["a", "b"], "z")
    np.testing.assert_allclose([r.intercept, *r.coef], [1, 3, 4], atol=1e-8)


def test_text_dedup(spark):
    base = " ".join(f"word{i}" for i in range(60))
    texts = [base, base, base + " tail", " ".join(f"other{i}" for i in range(60)), "short", "short one", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i for r in text_dedup.exact(df, "t", "i").collect()} == {0, 2, 3, 4, 5, 6}
    assert {r.i for r in text_dedup.minhash(df, "t", "i").collect()} == {0, 3, 4, 5, 6}


def test_sources_round_trip(spark, tmp_path, frame):
    _, df = frame
    t = df.select("i", "n")
    writers.to_csv(t, str(tmp_path / "csv"))
    writers.to_parquet(t, str(tmp_path / "parquet"), ["n"])
    writers.to_json(t, str(tmp_path / "json"))
    for back in (readers.read_csv(spark, str(tmp_path / "csv"), schema="i long, n long"), readers.read_parquet(spark, str(tmp_path / "parquet"), ["i", "n"]), readers.read_json(spark, str(tmp_path / "json"))):
        assert {(r.i, r.n) for r in back.collect()} == {(r.i, r.n) for r in t.collect()}
    assert readers.date_range(spark, "2024-01-01", periods=3).count() == 3
    assert readers.date_range(spark, "2024-01-01", "2024-01-05", inclusive="neither").count() == 3


def test_user_functions(spark, frame):
    _, df = frame
    got = udf.apply_rows(df.select("i", "n"), lambda r: (int(r["i"]), int(r["n"]) + 1), "i long, m long")
    assert got.join(df, "i").filter("m <> n + 1").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from quern.streaming import windows as W

    rows = spark.createDataFrame([(i, f"2024-01-01 0{i % 6}:{i % 60:02d}:00", i % 3) for i in range(90)], "id int, t string, k int").select("id", F.to_timestamp("t").alias("t"), "k")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = W.tumbling(stream, "t", "1 hour", ["k"], n=("id", F.count))
    q = out.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in W.tumbling(rows, "t", "1 hour", ["k"], n=("id", F.count)).collect()}
    assert {tuple(r) for r in spark.table("tumbled").collect()} == want


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "chebyshev", "sqeuclidean", "hamming", "rbf"])
def test_tiled_distances(spark, metric):
    """Several tiles, equal vectors, a missing, a short and a zero vector, and a missing element."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[20:40], x[7] = x[:20], 0
    data = [(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(data, "i long, x array<double>")
    diff = x[:, None] - x[None]
    with np.errstate(all="ignore"):
        square = (diff**2).sum(-1)
        want = {
            "euclidean": np.sqrt(square), "sqeuclidean": square, "manhattan": np.abs(diff).sum(-1), "chebyshev": np.abs(diff).max(-1), "hamming": (diff != 0).mean(-1), "rbf": np.exp(-square / 4),
            "cosine": 1 - x @ x.T / np.sqrt((x**2).sum(1)[:, None] * (x**2).sum(1)),
        }[metric]
    for decimals in (None, 6):
        got = arrays.cdist(df, df, metric, decimals).toPandas()
        assert len(got) == 303 * 303 and len(got[["i", "j"]].drop_duplicates()) == len(got)
        full = got[(got.i < 300) & (got.j < 300)].sort_values(["i", "j"])["d"].to_numpy(float).reshape(300, 300)
        np.testing.assert_allclose(full, want, atol=1e-7 if decimals is None else 1e-6)
        odd = got[(got.i >= 300) | (got.j >= 300)]
        assert set(map(tuple, odd[odd.d.notna()][["i", "j"]].to_numpy())) == {(301, 301)} or metric == "cosine"
        half = arrays.pdist(df, metric, decimals).toPandas()
        both = half.merge(got, on=["i", "j"])
        assert len(half) == len(both) == 303 * 302 // 2 and (half.i < half.j).all()
        np.testing.assert_array_equal(both.d_x, both.d_y)


def test_rounded_distances_are_those_of_the_elements():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(64, 200)) / 8, rng.normal(size=(64, 900)) / 8
    y[:, :50], y[:, 50:100], y[:, 7] = x[:, :50], x[:, 50:100] * (1 + 1e-5), 0
    for metric in ("euclidean", "cosine"):
        np.testing.assert_array_equal(arrays._rounded_cells(x, y, metric, None, 6), arrays._rounded(arrays.cells(x, y, metric, None), 6))


def test_distance_plans_are_tiles(spark):
    """No pair is made by a product or a nested loop join."""
    df = spark.range(10).selectExpr("id AS i", "array(CAST(id AS double)) AS x")
    for out in (arrays.cdist(df, df), arrays.pdist(df)):
        text = out._jdf.queryExecution().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text and "Join" not in text


@pytest.mark.parametrize("others", [False, True])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_of_equal_vectors(spark, metric, others):
    """Each vector stands seven times: equal distances go by j, and a query's own id may not be among its first."""
    rng = np.random.default_rng(5)
    x = np.tile(rng.normal(size=(90, 6)), (7, 1))
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "i long, x array<double>")
    d = np.stack([arrays.paired(np.repeat(v[:, None], len(x), 1), x.T, metric) for v in x])
    for k in (4, 9):
        got = learn.nearest_neighbors(df.filter("i % 3 = 0"), df, k, metric, others).toPandas().sort_values(["i", "rank"])
        for i, rows in got.groupby("i"):
            want = [j for j in np.lexsort((np.arange(len(x)), d[i])) if not others or j != i][:k]
            assert list(rows["j"]) == want and list(rows["rank"]) == list(range(1, k + 1))


@pytest.mark.parametrize("how", ["inner", "right"])
def test_spread_join(spark, monkeypatch, how):
    """Few keys with many rows: the same rows as a merge, made by several tasks."""
    a = spark.range(600).selectExpr("id AS x", "IF(id % 4 = 3, NULL, id % 4) AS k")
    b = spark.range(500).selectExpr("id AS y", "IF(id % 5 = 3, NULL, id % 5) AS k")
    want = joins.merge(a, b, how, left_on="k", right_on="k").select("x", "y").toPandas().astype(float)
    monkeypatch.setattr(joins, "SPREAD_ROWS", 1000)
    out = joins.spread(a, b, how, "k", "k").select("x", "y")
    sizes = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == len(want) and len(sizes) > 20 and sizes.max() < len(want) / 10
    got = out.toPandas().astype(float)
    pd.testing.assert_frame_equal(*(t.sort_values(["x", "y"]).reset_index(drop=True) for t in (got, want)))


def test_apply_takes_many_groups_at_once(spark):
    """Groups over the bounds of batches, a NaN key, and functions that return a frame, a row or a value."""
    n = 25000
    pdf = pd.DataFrame({"k": np.arange(n) // 7 % 1500 + 0.0, "v": np.arange(n) * 1.0})
    pdf.loc[pdf.k < 2, "k"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "k"] = 3.0
    df = spark.createDataFrame(pdf)
    want = pdf.groupby("k", dropna=False)["v"].sum().reset_index()
    want["k"] = want["k"].fillna(-1)
    show = lambda t: t.assign(k=t["k"].fillna(-1)).sort_values("k").reset_index(drop=True)
    whole = lambda p: pd.DataFrame({"k": p["k"].iloc[:1], "v": [p["v"].sum()]})
    for f in (whole, lambda p: (p["k"].iloc[0], p["v"].sum())):
        out = grouping.apply(df, ["k"], f, "k double, v double")
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        pd.testing.assert_frame_equal(show(out.toPandas()), show(want))
    sizes = grouping.apply(df, ["k"], lambda p: float(len(p)), "n double").toPandas()["n"]
    assert sizes.sum() == n and len(sizes) == len(want)


@pytest.mark.parametrize("most", [8, 1 << 16])
def test_exact_quantiles_in_any_task(spark, monkeypatch, most):
    """Few and many distinct values, missing ones, NaN and an empty column; no task holds the column."""
    monkeypatch.setattr(stats, "MAX_VALUES", most)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=3000), np.repeat(rng.integers(0, 5, 40) * 1.0, 50)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 7, "v double")
    for q in (0.0, 0.001, 0.3, 0.5, 0.97, 1.0):
        for how in ("linear", "lower", "higher", "midpoint"):
            assert stats.quantiles(df, "v", [q], how)[0] == pytest.approx(np.quantile(v, q, method=how), rel=1e-12)
    assert stats.quantiles(df.filter("v IS NULL"), "v", [0.5]) == [None]
    nan = df.union(spark.createDataFrame([(float("nan"),)] * 6000, "v double"))
    assert stats.quantiles(nan, "v", [0.1], "lower")[0] == np.sort(v)[int(np.floor(10999 * 0.1))] and np.isnan(stats.quantiles(nan, "v", [0.9])[0])
    for out in (stats.qcut(df, "v", 4), stats.describe(df, ["v"]), stats.quantile_by_rank(df, "v", 0.3, "linear")):
        text = out._jdf.queryExecution().toString()
        assert "percentile(" not in text and "Window" not in text


def test_erf_makes_no_struct_per_term(spark):
    import math

    x = [-4.0, -2.9, -0.5, 0.0, 1e-9, 0.1, 1.0, 2.5, 2.999, 3.5]
    out = spark.createDataFrame([(v,) for v in x], "x double").select("x", E.erf(F.col("x")).alias("y"))
    assert [r.y for r in out.orderBy("x").collect()] == pytest.approx([math.erf(v) for v in x], rel=1e-11, abs=1e-15)
    assert "sequence(1, 60" not in out._jdf.queryExecution().analyzed().toString()
