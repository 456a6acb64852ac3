import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aisleflow.operators import blend as bl
from aisleflow.operators import metrics as mt
from aisleflow.operators import models as md
from aisleflow.operators import quantiles as qt
from aisleflow.operators import recursive as rc


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 300
    p = pd.DataFrame({"series_id": np.repeat(["a", "b"], n // 2), "date": pd.date_range("2020-01-01", periods=n // 2).tolist() * 2, "x1": rng.normal(5, 2, n), "x2": rng.normal(-1, 9, n), "x3": rng.uniform(0, 1, n)})
    p["y"] = 3 + 2 * p.x1 - 0.5 * p.x2 + p.x3 + rng.normal(0, 1, n)
    return p, spark.createDataFrame(p).withColumn("date", F.col("date").cast("date"))


def ridge(X, y, alpha):
    m, s = X.mean(0), X.std(0)
    Z = np.column_stack([np.ones(len(X)), (X - m) / s])
    pen = alpha * np.eye(Z.shape[1])
    pen[0, 0] = 0
    b = np.linalg.solve(Z.T @ Z + pen, Z.T @ y)
    coef = b[1:] / s
    return np.array([b[0] - coef @ m, *coef])


def test_ridge_equals_closed_form(table):
    p, df = table
    got = {r.series_id: np.array(r.coef) for r in md.fit_ridge(df, ["x1", "x2", "x3"], "y", 7.0, ["series_id"]).collect()}
    for k, g in p.groupby("series_id"):
        np.testing.assert_allclose(got[k], ridge(g[["x1", "x2", "x3"]].to_numpy(), g.y.to_numpy(), 7.0), rtol=1e-8)


def test_weights_act_like_repetition(table):
    _, df = table
    twice = df.unionByName(df.where("x3 > 0.5"))
    a = md.fit_ridge(df.withColumn("w", F.when(F.col("x3") > 0.5, 2.0).otherwise(1.0)), ["x1", "x2"], "y", 3.0, ["series_id"], "w").orderBy("series_id").collect()
    b = md.fit_ridge(twice, ["x1", "x2"], "y", 3.0, ["series_id"]).orderBy("series_id").collect()
    for r, t in zip(a, b):
        np.testing.assert_allclose(r.coef, t.coef, rtol=1e-8)


def test_constant_feature_gets_no_slope(table):
    p, df = table
    got = md.fit_ridge(df.withColumn("c", F.lit(1234567.1)), ["x1", "c"], "y", 7.0, ["series_id"]).orderBy("series_id").first().coef
    g = p[p.series_id == "a"]
    b = ridge(g[["x1"]].to_numpy(), g.y.to_numpy(), 7.0)
    np.testing.assert_allclose(got, [b[0], b[1], 0.0], rtol=1e-7, atol=1e-12)


def test_walk_forward_equals_refitting(table):
    p, df = table
    d = df.withColumn("fold", F.trunc("date", "month"))
    got = md.walk_forward(d, ["x1", "x2"], "y", "fold", 5.0, "series_id", 45, "p", F.lit(-1.0)).orderBy("series_id", "date").toPandas()
    q = p.sort_values(["series_id", "date"]).reset_index(drop=True)
    q["fold"] = q.date.dt.to_period("M")
    for k, g in q.groupby("series_id"):
        for f in g.fold.unique():
            past, now = g[g.fold < f], g[g.fold == f]
            want = -np.ones(len(now))
            if len(past) >= 45:
                b = ridge(past[["x1", "x2"]].to_numpy(), past.y.to_numpy(), 5.0)
                want = b[0] + now[["x1", "x2"]].to_numpy() @ b[1:]
            np.testing.assert_allclose(got.p.to_numpy()[now.index], want, rtol=1e-8)


def test_recursion_equals_a_loop(spark, series):
    s = series(400)
    hist, ahead = s.where("date < date'2020-06-01'"), s.where("date >= date'2020-06-01'").select("series_id", "date")
    models = spark.createDataFrame([("a", [5.0, 0.6, 0.3])], "series_id string, coef array<double>")
    got = rc.recursive_linear(hist, ahead, "revenue", ["series_id"], models, [("lag", 7), ("mean", 30)]).orderBy("date").toPandas()
    v = [r.revenue for r in hist.orderBy("date").collect()]
    for x in got.predicted:
        want = max(0.0, 5.0 + 0.6 * v[-7] + 0.3 * np.mean(v[-30:]))
        assert x == pytest.approx(want, rel=1e-9)
        v.append(want)


def test_recursion_fills_short_history(spark, series):
    s = series(10)
    models = spark.createDataFrame([("a", [1.0, 1.0], [40.0])], "series_id string, coef array<double>, fill array<double>")
    ahead = spark.createDataFrame([("a", "2019-06-11")], "series_id string, d string").select("series_id", F.to_date("d").alias("date"))
    assert rc.recursive_linear(s, ahead, "revenue", ["series_id"], models, [("mean", 30)]).first().predicted == 41.0


def test_adaptive_blend_equals_a_loop(spark, series):
    s = series(420)
    hist = s.where("date < date'2020-07-01'")
    f = s.where("date >= date'2020-07-01'").select("series_id", "date", (F.col("revenue") + 5).alias("calm"), (F.col("revenue") * 2).alias("spiky"))
    thr = spark.createDataFrame([("a", 0.5)], "series_id string, volatility_threshold double")
    got = rc.adaptive_blend(hist, f, "revenue", ["series_id"], thr, 0.5).orderBy("date").toPandas()
    v = [r.revenue for r in hist.orderBy("date").collect()]
    for x, r in zip(got.predicted, f.orderBy("date").collect()):
        m, sd = np.mean(v[-30:]), np.std(v[-30:], ddof=1)
        w = 0.5 + 0.2 * (v[-7] / m > 1.2) + 0.1 * (sd / m > 0.5) + 0.1 * (v[-365] / m > 1.3)
        w = min(0.85, max(0.15, w))
        want = max(0.0, w * r.spiky + (1 - w) * r.calm)
        assert x == pytest.approx(want, rel=1e-9)
        v.append(want)


def test_simplex(spark):
    got = {tuple(round(x * 20) for x in r) for r in bl.add_simplex(spark.range(1), 3, 20, 12).select("w1", "w2", "w3").collect()}
    want = {c for c in itertools.product(range(13), repeat=3) if sum(c) == 20}
    assert got == want


def test_gram_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame(rng.uniform(50, 150, (30, 4)), columns=["actual", "a", "b", "c"])
    p["actual"] = 0.2 * p.a + 0.5 * p.b + 0.3 * p.c
    p["series_id"] = "s"
    g = bl.grid_search(spark.createDataFrame(p), ["a", "b", "c"], ["series_id"])
    for r in g.orderBy(F.rand(1)).limit(20).collect():
        e = p.actual - (r.w1 * p.a + r.w2 * p.b + r.w3 * p.c)
        assert r.rmse == pytest.approx(np.sqrt((e**2).mean()), abs=1e-5)
    best = bl.best_weights(g, ["series_id"], 3).first()
    assert (best.w1, best.w2, best.w3) == pytest.approx((0.2, 0.5, 0.3))


def test_blend_needs_every_component(spark):
    long = spark.createDataFrame([("s", 1, "a", 10.0), ("s", 1, "b", 20.0), ("s", 2, "a", 10.0), ("s", 3, "a", -50.0), ("s", 3, "b", 10.0)], "series_id string, date int, model string, predicted double")
    w = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "model string, weight double")
    got = {r.date: (r.revenue, r.cogs) for r in bl.blend(long, w).collect()}
    assert got[1] == (12.5, pytest.approx(12.5 * 0.89)) and got[2] == (None, None) and got[3] == (0.0, 0.0)
    kept = {r.model: r.weight for r in bl.renormalize(w, spark.createDataFrame([("a",)], "model string")).collect()}
    assert kept == {"a": 1.0}


def test_metrics(spark):
    df = spark.createDataFrame([("m", 10.0, 8.0), ("m", 20.0, 23.0), ("flat", 5.0, 4.0), ("flat", 5.0, 7.0)], "model string, actual double, predicted double")
    got = {r.model: r for r in mt.regression_metrics(df, ["model"]).collect()}
    assert got["m"].mae == 2.5 and got["m"].rmse == pytest.approx(np.sqrt(6.5)) and got["m"].r2 == pytest.approx(1 - 13 / 50)
    assert got["flat"].r2 is None
    assert {r.model: r.r2 for r in mt.regression_metrics(df, ["model"], 0.0).collect()}["flat"] == 0.0


def test_auc_with_ties(spark):
    rng = np.random.default_rng(5)
    s, y = rng.integers(0, 6, 400).astype(float), rng.integers(0, 2, 400)
    got = mt.auc(spark.createDataFrame(pd.DataFrame({"k": "a", "s": s, "y": y})), "s", "y", ["k"]).first().auc
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(want)
    assert mt.auc(spark.createDataFrame([("a", 1.0, 1)], "k string, s double, y int"), "s", "y", ["k"]).first().auc is None


@pytest.mark.parametrize("hot", [0.0, 0.4, 0.97])
def test_exact_quantiles(spark, hot):
    """A value that fills a third or more of the rows does not disturb the others."""
    rng = np.random.default_rng(9)
    v = np.where(rng.uniform(size=3000) < hot, 7.25, rng.normal(0, 50, 3000))
    k = np.where(rng.uniform(size=3000) < 0.8, "big", "small")
    df = spark.createDataFrame(pd.DataFrame({"k": k, "v": v})).unionByName(spark.createDataFrame([("big", None)], "k string, v double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.p): r.value for r in qt.exact_quantiles(df, "v", probs, ["k"]).collect()}
    for key in ("big", "small"):
        np.testing.assert_allclose([got[(key, p)] for p in probs], np.quantile(v[k == key], probs), rtol=1e-12, atol=1e-12)


def test_fallback_models(table):
    p, df = table
    d = df.withColumn("g", F.when(F.col("date") < "2020-01-20", "few").otherwise("many"))
    got = {(r.series_id, r.g): r.coef for r in md.fit_with_fallback(d, ["x1", "x2"], "y", 2.0, "series_id", "g", 40).collect()}
    whole = p[p.series_id == "a"]
    np.testing.assert_allclose(got[("a", "few")], ridge(whole[["x1", "x2"]].to_numpy(), whole.y.to_numpy(), 2.0), rtol=1e-8)


def test_ratio_targets_stay_unknown_without_baseline(spark):
    df = spark.createDataFrame([(10.0, 5.0), (10.0, None), (10.0, 0.0), (0.0, 5.0)], "y double, b double")
    got = [tuple(r) for r in md.ratio_targets(df, "y", "b").select("target_ratio", "target_log_ratio").collect()]
    assert got[0] == (2.0, pytest.approx(np.log(2))) and got[1] == (None, None) and got[2] == (None, None) and got[3][1] == pytest.approx(np.log(1e-6))
