"""Boosting from moments, robust, quantile and logistic models against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleflow.operators import boosting as bo
from aisleflow.operators import models as md
from aisleflow.operators import robust as rb


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 900
    x = rng.normal(size=(n, 3)) * (1, 5, 0.2)
    y = 40 + 6 * (x[:, 0] > 0.4) - 3 * x[:, 1] + rng.standard_t(3, n)
    rows = [(i, "a" if i % 3 else "b", *map(float, x[i]), float(y[i]), i >= 700) for i in range(n)]
    rows += [(n, "a", None, 1.0, None, 44.0, False), (n + 1, "a", 1.0, 1.0, 0.0, None, False)]
    return spark.createDataFrame(rows, "i int, g string, x0 double, x1 double, x2 double, y double, held boolean").cache()


FEATURES = ["x0", "x1", "x2"]


def plain_boost(rows, cuts, rounds, rate, least):
    """The same rules by rows: residuals, every split tried, one at a time."""
    per = [[0 if r[f] is None else sum(r[f] > e for e in cuts[f]) for f in FEATURES] for r in rows]
    fit = [i for i, r in enumerate(rows) if not r["held"]]
    held = [i for i, r in enumerate(rows) if r["held"]]
    y = np.array([r["y"] for r in rows])
    p = np.full(len(rows), y[fit].mean())
    spread, first = ((y[fit] - p[0]) ** 2).sum(), ((y[held] - p[0]) ** 2).sum()
    path = []
    for _ in range(rounds):
        best = None
        for j in range(len(FEATURES)):
            for t in range(1, bo.BINS):
                left = [i for i in fit if per[i][j] < t]
                right = [i for i in fit if per[i][j] >= t]
                if min(len(left), len(right)) >= least:
                    res = y - p
                    gain = res[left].sum() ** 2 / len(left) + res[right].sum() ** 2 / len(right) - res[fit].sum() ** 2 / len(fit)
                    share = np.floor(gain / spread * 1e9 + 0.5) / 1e9
                    if best is None or share > best[0]:
                        best = share, j, t, res[left].mean(), res[right].mean()
        share, j, t, a, b = best
        p += np.array([rate * (a if x[j] < t else b) for x in per])
        path.append((FEATURES[j], t, share, ((y[held] - p[held]) ** 2).sum() / first, p.copy()))
    return path


def test_boosting_equals_row_by_row(spark, table):
    rows = [r.asDict() for r in table.where("y is not null").orderBy("i").collect()]
    model = bo.boost(table, FEATURES, "y", F.col("held"), rounds=12, rate=0.3, least=15)
    want = plain_boost(rows, model.cuts, 12, 0.3, 15)
    for got, (f, t, share, error, _) in zip(model.path[1:], want, strict=True):
        assert got[1:3] == (f, t)
        assert got[3] == pytest.approx(share, abs=2e-9) and got[4] == pytest.approx(error, abs=2e-9)
    assert model.best == min(range(13), key=lambda r: (model.path[r][4], r))
    predicted = [r[0] for r in table.where("y is not null").orderBy("i").select(model.score()).collect()]
    assert predicted == pytest.approx(want[model.best - 1][4].clip(0).tolist())
    assert dict((f, n) for f, _, n in model.gain())["x1"] > 0


def test_boosting_edge_cases(spark, table):
    empty = bo.boost(table.where("false"), FEATURES, "y", F.col("held"), rounds=3)
    assert empty.base == 0 and empty.best == 0 and table.select(empty.score()).distinct().count() == 1
    flat = bo.boost(table.withColumn("x0", F.lit(None).cast("double")).withColumn("y", F.lit(5.0)), FEATURES, "y", F.col("held"), rounds=3)
    assert len(flat.path) == 1 and table.select(flat.score()).first()[0] == 5
    blind = bo.boost(table, FEATURES, "y", F.lit(False), rounds=5)
    assert blind.best == 5


def test_weighted_boosting_counts_rows_by_weight(spark, table):
    double = table.withColumn("w", F.when(F.col("i") % 2 == 0, 2.0).otherwise(1.0))
    twice = table.unionByName(table.where("i % 2 = 0"))
    cuts = bo.edges(table, FEATURES)
    a = bo.moments(double, bo.binned(cuts), "y", 3, weight="w")
    b = bo.moments(twice, bo.binned(cuts), "y", 3)
    assert np.allclose(a.meet, b.meet) and np.allclose(a.sums, b.sums) and a[2:] == pytest.approx(b[2:])


def dense(table, g=None):
    rows = [r for r in table.orderBy("i").collect() if None not in (r.x0, r.x1, r.y) and (g is None or r.g == g)]
    return np.array([[1, r.x0, r.x1] for r in rows]), np.array([r.y for r in rows])


def test_huber_gradient_is_zero(spark, table):
    for row in rb.fit_huber(table, ["x0", "x1"], "y", ["g"], steps=40).collect():
        x, y = dense(table, row.g)
        r = (y - x @ row.coef) / row.scale
        assert row.n == len(y)
        pull = np.where(np.abs(r) <= rb.EPSILON, r, rb.EPSILON * np.sign(r))
        assert np.abs(x.T @ pull / len(y)).max() < 1e-4
        inside = np.abs(r) <= rb.EPSILON  # the scale's own equation
        assert len(y) - (r[inside] ** 2).sum() - rb.EPSILON**2 * (~inside).sum() == pytest.approx(0, abs=1e-2)


def test_huber_resists_outliers(spark, table):
    wild = table.withColumn("y", F.when(F.col("i") % 20 == 0, 1e5).otherwise(F.col("y")))
    one = lambda df: {r.g: r.coef for r in rb.fit_huber(df, ["x0", "x1"], "y", ["g"], steps=30).collect()}
    plain, robust = one(table), one(wild)
    least = {r.g: r.coef for r in md.fit_ridge(wild, ["x0", "x1"], "y", 0.0, ["g"]).collect()}
    for g in plain:
        assert abs(robust[g][2] - plain[g][2]) < 0.2 < abs(least[g][2] - plain[g][2])


def test_pinball_shares_and_loss(spark, table):
    models = rb.fit_pinball(table, ["x0", "x1"], "y", ["g"], [0.25, 0.7], steps=10, floor=0.01).collect()
    assert len(models) == 4
    for m in models:
        x, y = dense(table, m.g)
        loss = lambda b: np.maximum(m.alpha * (y - x @ b), (m.alpha - 1) * (y - x @ b)).mean()
        below = (y - x @ m.coef <= 1e-9).sum()
        assert abs(below - m.alpha * len(y)) <= 1
        rng = np.random.default_rng(0)
        assert all(loss(m.coef) <= loss(m.coef + rng.normal(size=3) * 0.3) for _ in range(60))


def test_logistic_is_a_minimum(spark, table):
    df = table.withColumn("top", (F.col("y") > 50).cast("int"))
    b, places = rb.fit_logistic(df, ["x0", "x1"], "top", F.lit(2.0), penalty=0.05, steps=8)
    x, y = dense(table)
    z = (x[:, 1:] - [places[f][0] for f in ("x0", "x1")]) / [places[f][1] for f in ("x0", "x1")]
    p = 1 / (1 + np.exp(-(b[0] + z @ b[1:])))
    e = p - (y > 50)
    assert abs(e.mean()) < 1e-9 and np.abs(z.T @ e / len(y) + 0.05 * np.array(b[1:])).max() < 1e-9
    got = [r[0] for r in df.where("x0 is not null and y is not null").orderBy("i").select(rb.logistic((b, places))).collect()]
    assert got == pytest.approx(p.tolist()) and all(0 < v < 1 for v in got)


def test_learners_without_rows(spark, table):
    none = table.where("false")
    assert rb.fit_huber(none, ["x0"], "y", ["g"]).count() == 0
    assert rb.fit_pinball(none, ["x0"], "y", ["g"], [0.5]).count() == 0
    assert rb.fit_logistic(none.withColumn("top", F.lit(1)), ["x0"], "top")[0] == [0.0, 0.0]
