from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causalframe.functions import fin, linalg
from causalframe.operators import reshape, stats
from causalframe.operators import windows as win

T0 = datetime(2020, 1, 1)


def series(spark, n=400, seed=0, gaps=0.1, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": [T0 + timedelta(days=i) for i in range(n)], "v": 100 + rng.normal(size=n).cumsum()}) for k in keys])
    pdf.loc[rng.random(len(pdf)) < gaps, "v"] = np.nan
    rows = [(r.k, r.ts.to_pydatetime(), None if np.isnan(r.v) else r.v) for r in pdf.itertuples()]
    return pdf.reset_index(drop=True), spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def column(df, name):
    return df.orderBy("k", "ts").select(name).toPandas()[name].to_numpy(dtype=float)


@pytest.mark.parametrize("span", [2, 10, 60])
def test_ewma_in_blocks(spark, span):
    pdf, df = series(spark)
    want = pdf.groupby("k")["v"].transform(lambda s: s.ewm(span=span, min_periods=3 * span).mean()).to_numpy()
    np.testing.assert_allclose(column(win.ewma(df, "v", span, "e", ["k"]), "e"), want, rtol=1e-10, equal_nan=True)


def test_ewma_over_a_long_gap(spark):
    rows = [("a", T0 + timedelta(days=i), float(i) if i < 9 or i > 200 else None) for i in range(230)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    s = pd.Series([r[2] for r in rows], dtype=float)
    np.testing.assert_allclose(column(win.ewma(df, "v", 3, "e", ["k"]), "e"), s.ewm(span=3, min_periods=9).mean().to_numpy(), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("centered", [False, True])
def test_ewm_volatility(spark, centered):
    pdf, df = series(spark, seed=3)
    f = (lambda s: s.ewm(span=12, min_periods=36).std()) if centered else (lambda s: np.sqrt((s**2).ewm(span=12, min_periods=36).mean()))
    want = pdf.groupby("k")["v"].transform(f).to_numpy()
    np.testing.assert_allclose(column(win.ewm_volatility(df, "v", 12, "s", ["k"], centered=centered), "s"), want, rtol=1e-6, equal_nan=True)


def test_fills_products_and_rolls(spark):
    pdf, df = series(spark, 60, gaps=0.3)
    w = win.ordered(["k"])
    g = pdf.groupby("k")["v"]
    out = df.withColumns({"f": win.ffill("v", w, 2), "b": win.bfill("v", ["k"], limit=2), "r": win.rolling("v", w, 3), "d": win.diff("v", w, 2)})
    np.testing.assert_allclose(column(out, "f"), g.ffill(limit=2), equal_nan=True)
    np.testing.assert_allclose(column(out, "b"), g.bfill(limit=2), equal_nan=True)
    np.testing.assert_allclose(column(out, "r"), g.rolling(3).sum(), equal_nan=True)
    np.testing.assert_allclose(column(out, "d"), g.diff(2), equal_nan=True)
    signs = spark.createDataFrame([("a", T0 + timedelta(days=i), x) for i, x in enumerate([2.0, -3.0, None, -1.0, 0.0, 5.0])], "k string, ts timestamp_ntz, v double")
    assert column(signs.withColumn("p", win.cumprod("v", w)), "p").tolist() == pytest.approx([2, -6, -6, 6, 0, 0])


def test_bar_returns(spark):
    rows = [("a", T0 + timedelta(days=i), x) for i, x in enumerate([1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, price double")
    got = [r.ret for r in fin.arithmetic_bar_returns(df, keys=["k"]).orderBy("end").collect()]
    assert got == [None, 1.0]
    got = fin.arithmetic_bar_returns(df, return_type="trading", keys=["k"]).orderBy("end").collect()
    assert [r.ret for r in got] == [None, 0.0] and got[0].start == T0
    with pytest.raises(ValueError):
        fin.arithmetic_bar_returns(df, return_type="other")


def test_macd_of_a_random_walk_is_standard(spark):
    prices = fin.brownian_prices(spark, 4000, {"a": 0.1, "b": 1.0, "c": 100.0}, seed=11)
    assert prices.groupBy("asset").agg(F.min("price").alias("m")).where("abs(m - 1) > 1e-9").count() == 0
    m = fin.macd(prices, 10, 20, 100, keys=["asset"], on="i").na.drop()
    for r in m.groupBy("asset").agg(F.avg("macd").alias("m"), F.var_samp("macd").alias("v")).collect():
        assert abs(r.m) < 0.35 and 0.6 < r.v < 1.5
    assert fin.ou_factor(10, 20) == pytest.approx(0.91515, abs=1e-4)
    long = fin.macd_multi_horizon(prices, [(10, 20), (20, 40)], 100, keys=["asset"], on="i")
    assert long.count() == 2 * 12000 and set(long.columns) == {"asset", "i", "fast", "slow", "macd"}


def test_strict_algebra(spark):
    v = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, 3.0), (2, 1, 4.0)], "t int, col int, v double")
    m = spark.createDataFrame([(t, r, c, float(r + c)) for t in (1, 2) for r in (0, 1, 2) for c in (0, 1)], "t int, row int, col int, m double")
    assert {r.t: r.v for r in linalg.dot(v, v, ["t"]).collect()} == {1: None, 2: 25.0}
    assert {(r.t, r.col): r.v for r in linalg.mat_vec(m, v, ["t"]).collect()} == {(1, 0): None, (1, 1): None, (1, 2): None, (2, 0): 4.0, (2, 1): 11.0, (2, 2): 18.0}
    left = spark.createDataFrame([(2, 0, 1.0), (2, 1, 2.0), (2, 2, 0.5)], "t int, col int, v double")
    assert [r.v for r in linalg.bilinear(left, m.where("t = 2"), v.where("t = 2"), ["t"]).collect()] == [35.0]
    with pytest.raises(Exception, match="different columns"):
        linalg.hadamard(v, v.where("col = 0"), ["t"]).collect()
    assert {(r.t, r.col): r.v for r in linalg.hadamard(v, v, ["t"]).collect()} == {(1, 0): 1.0, (1, 1): None, (2, 0): 9.0, (2, 1): 16.0}


def test_reshape_and_stats(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "id int, a double, b double")
    long = reshape.stack(df, ["id"], ["a", "b"])
    assert long.count() == 3
    assert sorted(map(tuple, reshape.unstack(long, ["id"], "variable", "value", ["a", "b"]).collect())) == [(1, 1.0, None), (2, 3.0, 4.0)]
    new = spark.createDataFrame([(1, 9.0, 7.0, "x"), (3, 5.0, 5.0, "y")], "id int, a double, b double, c string")
    assert sorted(map(tuple, reshape.combine_first(df, new, ["id"]).collect())) == [(1, 1.0, 7.0, "x"), (2, 3.0, 4.0, None), (3, 5.0, 5.0, "y")]
    assert {(r.row, r.col): round(r.corr, 6) for r in stats.correlations(new, ["a", "b"]).collect()}[("a", "b")] == 1.0
    assert stats.histogram(spark.range(10).selectExpr("double(id) as x"), "x", 3).groupBy().sum("n").first()[0] == 10


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 3000), "small": rng.normal(size=3000) / 1e6, "ties": rng.integers(0, 5, 3000).astype(float)})
    pdf.loc[rng.random(3000) < 0.1, "small"] = np.nan
    rows = [(r.k, None if np.isnan(r.small) else float(r.small), float(r.ties)) for r in pdf.itertuples()] + [("empty", None, None)]
    df = spark.createDataFrame(rows, "k string, small double, ties double")
    found = {(r.k, r.variable): r for r in stats.describe(df, ["small", "ties"], ["k"]).collect()}
    assert found["empty", "small"]["count"] == 0 and found["empty", "small"].p50 is None
    for (k, c), r in found.items():
        if k != "empty":
            x = pdf[pdf["k"].isna() if k is None else pdf["k"] == k][c].dropna()
            assert (r.p25, r.p50, r.p75) == tuple(pytest.approx(v) for v in np.quantile(x, [0.25, 0.5, 0.75])) and r["count"] == len(x)
    edges = stats.quantile_edges(df, "small").first().edges
    np.testing.assert_allclose(edges, np.quantile(pdf["small"].dropna(), np.arange(10) / 10))


def test_describe_without_values(spark):
    df = spark.createDataFrame([("a", None, 1e9 + 1), ("a", None, 1e9 + 3), ("b", 2.0, None)], "k string, x double, y double")
    found = {(r.k, r.variable): r for r in stats.describe(df, ["x", "y"], ["k"]).collect()}
    assert len(found) == 4 and found["a", "x"]["count"] == 0
    assert all(found["a", "x"][c] is None for c in ("mean", "std", "min", "p50", "max"))
    r = found["a", "y"]
    assert (r["count"], r.mean, r.std, r.min, r.p25, r.p50, r.max) == (2, 1e9 + 2, pytest.approx(2**0.5), 1e9 + 1, 1e9 + 1.5, 1e9 + 2, 1e9 + 3)
    assert found["b", "x"].std is None and found["b", "x"].mean == 2.0 and found["b", "y"]["count"] == 0
    assert stats.describe(df.where("false"), ["x"]).count() == 0
