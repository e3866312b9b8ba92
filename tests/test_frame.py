"""The data-frame API against pandas."""

import numpy as np
import pandas as pd
import pytest

from quern import frame as Q


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.RandomState(4)
    pdf = pd.DataFrame({"k": rng.choice(list("abc"), 40), "v": np.where(rng.rand(40) < 0.2, np.nan, rng.rand(40).round(3)), "n": rng.randint(-3, 4, 40), "s": rng.choice(["x-1", "yy", "Zed"], 40)})
    return pdf, Q.from_pandas(spark, pdf)


def same(got, want):
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True), check_dtype=False)


def test_filter_assign_arithmetic(both):
    pdf, f = both
    got = f[(f["n"] > 0) & ~(f["v"] < 0.5)].assign(r=lambda t: t["v"] / t["n"], m=lambda t: t["n"] % 3, d=lambda t: 7 // t["n"])
    want = pdf[(pdf["n"] > 0) & ~(pdf["v"] < 0.5)].assign(r=lambda t: t["v"] / t["n"], m=lambda t: t["n"] % 3, d=lambda t: 7 // t["n"])
    same(got.to_pandas(), want)


def test_comparisons_with_missing_values(both):
    pdf, f = both
    assert len(f[f["v"] != 0.5]) == (pdf["v"] != 0.5).sum()
    assert len(f[f["v"] == f["v"]]) == (pdf["v"] == pdf["v"]).sum()
    assert len(f[f["v"].isna()]) == pdf["v"].isna().sum()


def test_positions(both):
    pdf, f = both
    same(f.head(3).to_pandas(), pdf.head(3))
    same(f.tail(3).to_pandas(), pdf.tail(3))
    same(f.iloc(5, 9).to_pandas(), pdf.iloc[5:9])
    same(f.iloc(-4, -1).to_pandas(), pdf.iloc[-4:-1])
    same(f[10:12].to_pandas(), pdf[10:12])
    assert f.iat(7, "n") == pdf["n"].iat[7]


def test_groupby(both):
    pdf, f = both
    g = pdf.groupby("k")
    for how in ("sum", "mean", "max", "count", "nunique", "median"):
        got = getattr(f.groupby("k"), how)(["v", "n"]).to_pandas().sort_index()
        np.testing.assert_allclose(got.to_numpy(float), getattr(g[["v", "n"]], how)().to_numpy(float))
    same(f.groupby("k").head(2).to_pandas(), g.head(2))
    same(f.groupby("k").nth(1).to_pandas(), g.nth(1))
    got = f.groupby("k").cumulative(c=("n", "cumsum")).to_pandas()["c"]
    assert got.tolist() == g["n"].cumsum().tolist()
    got = f.groupby("k").rank("n").to_pandas()["rank"]
    np.testing.assert_allclose(got, g["n"].rank())
    got = f.groupby("k").shift("n").to_pandas()["shifted"]
    np.testing.assert_allclose(got.to_numpy(float), g["n"].shift().to_numpy())


def test_whole_frame_windows(both):
    pdf, f = both
    got = f.rolling(4, r=("n", "sum")).to_pandas()["r"]
    np.testing.assert_allclose(got.to_numpy(float), pdf["n"].rolling(4).sum().to_numpy())
    np.testing.assert_allclose(f.shift(2, b="n").to_pandas()["b"].to_numpy(float), pdf["n"].shift(2).to_numpy())
    same(f[["v", "n"]].ffill().to_pandas(), pdf[["v", "n"]].ffill())


def test_index(both, spark):
    pdf, f = both
    a = f.groupby("k").agg(t=("n", "sum"))
    assert a.index == ["k"] and a.at("a", "t") == pdf[pdf["k"] == "a"]["n"].sum()
    got = f.join(a, on="k")
    assert got.columns == ["k", "v", "n", "s", "t"] and len(got) == len(pdf)
    assert a.loc(["a", "b"]).to_pandas().index.tolist() in (["a", "b"], ["b", "a"])
    r = a.reindex(["c", "zz"], 0).to_pandas()
    assert r.loc["zz", "t"] == 0 and r.index.tolist() == ["c", "zz"]
    x, y = a.align(f.groupby("k").agg(u=("n", "max")))
    assert x.columns == y.columns == ["t", "u"]
    assert f.set_index("k").reset_index().columns == f.columns
    assert f.reset_index().to_pandas()["index"].tolist() == list(range(len(pdf)))


def test_columns(both):
    _, f = both
    assert f.insert(1, "z", 5).columns == ["k", "z", "v", "n", "s"]
    assert f.add_prefix("p_").columns == ["p_k", "p_v", "p_n", "p_s"]
    assert f.select_dtypes("number").columns == ["v", "n"]
    assert f.drop("s").columns == ["k", "v", "n"]
    assert f.set_axis(list("wxyz")).columns == list("wxyz")


def test_series_methods(both):
    pdf, f = both
    got = f.assign(u=f["s"].str.upper(), n2=f["s"].str.len(), h=f["s"].str.contains("-"), z=f["n"].np.sign(), c=f["n"].clip(-1, 1), b=f["n"].between(0, 2)).to_pandas()
    s = pdf["s"].str
    assert got["u"].tolist() == s.upper().tolist() and got["n2"].tolist() == s.len().tolist() and got["h"].tolist() == s.contains("-").tolist()
    assert got["z"].tolist() == np.sign(pdf["n"]).tolist() and got["c"].tolist() == pdf["n"].clip(-1, 1).tolist() and got["b"].tolist() == pdf["n"].between(0, 2).tolist()
    assert f["v"].mean() == pytest.approx(pdf["v"].mean())
    assert f["v"].quantile(0.3) == pytest.approx(pdf["v"].quantile(0.3))
    assert f["s"].value_counts().to_pandas()["count"].to_dict() == pdf["s"].value_counts().to_dict()


def test_combination(both):
    pdf, f = both
    assert len(Q.concat([f, f])) == 80
    same(f.drop_duplicates("k").to_pandas(), pdf.drop_duplicates("k"))
    same(f.drop_duplicates("k", "last").to_pandas(), pdf.drop_duplicates("k", keep="last"))
    same(f.nlargest(4, "n").to_pandas(), pdf.nlargest(4, "n").sort_index())
    got = f.merge(f.groupby("k").agg(t=("n", "sum")), "inner", left_on="k", right_on="k")
    assert len(got) == len(pdf)
    same(f.query("n > 1 and v > 0.2").to_pandas(), pdf.query("n > 1 and v > 0.2"))


def test_arithmetic_of_frames_aligns_on_the_index(spark):
    a = pd.DataFrame({"k": [1, 2, 3, 5], "x": [1.0, np.nan, 3.0, 4.0], "y": [1.0, 2.0, 3.0, 4.0]}).set_index("k")
    b = pd.DataFrame({"k": [2, 3, 4, 5], "x": [10.0, np.nan, 30.0, 0.0], "z": [1.0, 2.0, 3.0, 4.0]}).set_index("k")
    fa, fb = (Q.from_pandas(spark, p.reset_index()).set_index("k") for p in (a, b))

    def check(got, want):
        got = got.to_pandas().reset_index().sort_values("k").set_index("k")[list(want.columns)]
        pd.testing.assert_frame_equal(got[sorted(got)].astype(float), want[sorted(want)].astype(float), check_dtype=False, check_index_type=False)

    check(fa + fb, a + b)
    check(fa.add(fb, fill_value=1.0), a.add(b, fill_value=1.0))
    check(fa.rsub(fb), a.rsub(b))
    check(fa.combine_first(fb), a.combine_first(b))
    check(fa * 3, a * 3)
    check(2 - fa, 2 - a)
    got = fa.corrwith(fb).sdf.collect()
    assert [r["column"] for r in got] == ["x"]


def test_more_of_the_frame_api(spark):
    pdf = pd.DataFrame({"k": list("aabbc"), "n": [1, 2, 1, 2, 1], "v": [5.0, np.nan, 5.0, -2.0, 9.0]})
    f = Q.from_pandas(spark, pdf)
    same(f.rank("v").to_pandas(), pdf.assign(v=pdf["v"].rank()))
    same(f.rank("v", "dense", pct=True).to_pandas(), pdf.assign(v=pdf["v"].rank(method="dense", pct=True)))
    same(f.clip(-1, 6, "v").to_pandas(), pdf.assign(v=pdf["v"].clip(-1, 6)))
    got = f.groupby("k")["v"].max().sdf.toPandas().sort_values("k")
    assert got["v"].tolist() == [5.0, 5.0, 9.0] and list(got.columns) == ["k", "v"]
    g = f.set_index(["k", "n"])
    assert {r.k: (r.v_1, r.v_2) for r in g.unstack([1, 2]).sdf.collect()} == {"a": (5.0, None), "b": (5.0, -2.0), "c": (9.0, None)}
    assert sorted(r.k for r in g.xs(2, "n").sdf.collect()) == ["a", "b"]
    assert g.rename_axis({"k": "key"}).index == ["key", "n"]
    assert {r["column"]: r["bytes"] for r in g.memory_usage().sdf.collect()} == {"v": 40}


def test_folds_part_the_rows(spark):
    from quern.operators import learn

    t = spark.range(2000).withColumnRenamed("id", "k")
    folds = learn.kfold(t, "k", 5).groupBy("fold").count().collect()
    assert len(folds) == 5 and sum(r["count"] for r in folds) == 2000 and min(r["count"] for r in folds) > 300


def test_triangular_systems_and_transforms(spark):
    from quern.operators import arrays as A

    rng = np.random.RandomState(0)
    m, x = np.triu(rng.rand(6, 6) + np.eye(6)), rng.rand(6)
    long = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(6)], "i long, j long, v double")
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(m @ x)], "i long, v double")
    got = A.solve_triangular(long, right, 6, lower=False).orderBy("i").toPandas()["v"]
    np.testing.assert_allclose(got, x)
    for n in (7, 8):
        np.testing.assert_allclose(A.fftfreq(spark, n, 0.1).orderBy("i").toPandas()["f"], np.fft.fftfreq(n, 0.1))
        v = spark.createDataFrame([(i, float(i)) for i in range(n)], "i long, v double")
        assert A.fftshift(v, n).orderBy("i").toPandas()["v"].tolist() == np.fft.fftshift(np.arange(n)).tolist()
        assert A.fftshift(A.fftshift(v, n), n, inverse=True).orderBy("i").toPandas()["v"].tolist() == list(range(n))
    with pytest.raises(ValueError):
        A.inverse(long, 5000)


def test_truncated_svd(spark):
    from quern.operators import learn

    x = np.random.RandomState(1).rand(50, 5)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    got = learn.TruncatedSVD(2).fit(df, "x", 5)
    _, values, vectors = np.linalg.svd(x)
    np.testing.assert_allclose(got.singular_values, values[:2], rtol=1e-6)
    np.testing.assert_allclose(np.abs(got.components), np.abs(vectors[:2]), atol=1e-6)
    assert len(got.transform(df, "x").first()["projected"]) == 2


def test_entry_survives_a_missing_dependency(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quern", tmp_path / "quern", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    assert subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path).returncode == 0
