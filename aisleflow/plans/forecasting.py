"""Fitted models, walk-forward validation, direct and recursive forecasts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisleflow.functions import scalars as fx
from aisleflow.functions.scalars import half_up_sql
from aisleflow.operators import boosting as bo
from aisleflow.operators import features as ft
from aisleflow.operators import metrics as mt
from aisleflow.operators import models as md
from aisleflow.operators import promos as pr
from aisleflow.operators import quality as dq
from aisleflow.operators import recursive as rc
from aisleflow.operators import references as ref
from aisleflow.operators import robust as rb
from aisleflow.operators import windows as win
from aisleflow.plans.calendar_promos import active_days, calendar
from aisleflow.plans.daily_facts import funnel
from aisleflow.plans.evaluation import BASIC_OUT, M_SQL, drivers
from aisleflow.plans.feature_blocks import ABOVE, RATIOS, SPIKES, ZS, scored, spike_table
from aisleflow.plans.lookups import _back, _wavg, seasonal_table
from aisleflow.plans.registry import kept, query
from aisleflow.plans.series_windows import FEATURES, importance, lagged, strict
from aisleflow.plans.sqlbase import cte, sql

CUT = "DATE '1999-12-31'"


def ridge_sql(source: str, by: str, y: str, x1: str, x2: str, alpha: float, where: str = "TRUE", min_rows: int = 3) -> str:
    """Closed form of ridge on two standardised features: intercept b0 and slopes b1, b2 per group."""
    a = f"{alpha}::DOUBLE"
    return f"""SELECT {by}, n, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (
      SELECT *, ((n + {a}) * q1 - n * r * q2) / ((n + {a}) * (n + {a}) - n * r * n * r) / s1 AS b1, ((n + {a}) * q2 - n * r * q1) / ((n + {a}) * (n + {a}) - n * r * n * r) / s2 AS b2 FROM (
        SELECT *, c12 / (s1 * s2) AS r, n * c1y / s1 AS q1, n * c2y / s2 AS q2 FROM (
          SELECT {by}, COUNT(*)::DOUBLE AS n, AVG({y}) AS my, AVG({x1}) AS m1, AVG({x2}) AS m2, CASE WHEN STDDEV_POP({x1}) > 1e-9 THEN STDDEV_POP({x1}) ELSE 1 END AS s1, CASE WHEN STDDEV_POP({x2}) > 1e-9 THEN STDDEV_POP({x2}) ELSE 1 END AS s2, COVAR_POP({x1}, {x2}) AS c12, COVAR_POP({x1}, {y}) AS c1y, COVAR_POP({x2}, {y}) AS c2y
          FROM {source} WHERE {where} AND {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL GROUP BY {by} HAVING COUNT(*) >= {min_rows})))"""


cte("phist", "panel", f"SELECT series_id, date, revenue, cogs, {lagged('revenue', 7)} AS lag_7, {strict('revenue', 30)} AS mean_30, {lagged('revenue', 365)} AS lag_365, {strict('revenue', 365)} AS mean_365 FROM panel")
cte("pfit", "phist", ridge_sql("phist", "series_id", "revenue", "lag_7", "mean_30", 10, f"date <= {CUT}"))


@kept
def panel_history(s):
    p = s.panel().select("series_id", "date", "revenue", "cogs")
    return p.select("*", win.lag("revenue", 7).alias("lag_7"), win.roll_mean("revenue", 30).alias("mean_30"), win.lag("revenue", 365).alias("lag_365"), win.roll_mean("revenue", 365).alias("mean_365"))


def until_cut(df):
    return df.where("date <= date'1999-12-31'")


def coefs(m):
    return m.select("*", *[F.get("coef", F.lit(i)).alias(f"b{i}") for i in range(3)])


@query("ridge_coefficients", "series_id:s n:i b0:2 b1:6 b2:6", sql("pfit", "SELECT * FROM pfit"))
def ridge_coefficients(s):
    return coefs(md.fit_ridge(until_cut(panel_history(s)), ["lag_7", "mean_30"], "revenue", 10.0, ["series_id"]))


@query(
    "ridge_validation_metrics",
    "series_id:s rows:i " + BASIC_OUT,
    sql("pfit", f"SELECT series_id, {M_SQL} FROM (SELECT p.series_id, p.revenue AS actual, b0 + b1 * lag_7 + b2 * mean_30 AS predicted FROM phist p JOIN pfit USING (series_id) WHERE date > {CUT}) GROUP BY 1"),
)
def ridge_validation_metrics(s):
    p = panel_history(s)
    m = md.fit_ridge(until_cut(p), ["lag_7", "mean_30"], "revenue", 10.0, ["series_id"])
    v = md.score(p.where("date > date'1999-12-31'").withColumnRenamed("revenue", "actual"), m, ["lag_7", "mean_30"], ["series_id"])
    return mt.regression_metrics(v, ["series_id"])


@query(
    "sample_weights",
    "series_id:s date:d target_weight:2 recency:2 promo:2",
    sql(
        "panel pcal",
        """SELECT p.series_id, p.date, CASE WHEN revenue >= q90 THEN 3 WHEN revenue >= q80 THEN 2 ELSE 1 END AS target_weight, CASE WHEN YEAR(p.date) <= 1997 THEN 0.5 WHEN YEAR(p.date) <= 1999 THEN 0.8 ELSE 1.2 END AS recency,
             CASE WHEN active_promo_count > 3 THEN 1.6 ELSE 1.0 END AS promo
           FROM panel p JOIN (SELECT series_id, QUANTILE_CONT(revenue, 0.8) AS q80, QUANTILE_CONT(revenue, 0.9) AS q90 FROM panel GROUP BY 1) q USING (series_id) JOIN pcal c ON c.date = p.date""",
    ),
)
def sample_weights(s):
    cal = pr.promo_calendar(active_days(s), s.spine()).select("date", (F.col("active_promo_count") > 3).cast("int").alias("heavy"))
    d = md.quantile_weights(s.panel().select("series_id", "date", "revenue"), "revenue", ["series_id"]).join(cal, "date")
    return d.select("series_id", "date", "target_weight", md.recency_weight("date", 1997, 1999).alias("recency"), md.promo_weight("heavy").alias("promo"))


REGIME = "CASE WHEN active_promo_count >= 6 THEN 'high' WHEN active_promo_count >= 1 THEN 'normal' ELSE 'none' END"
cte("rhist", "revenue pcal", f"SELECT r.series_id, r.date, r.revenue, {lagged('r.revenue', 7).replace('series_id', 'r.series_id').replace('BY date', 'BY r.date')} AS lag_7, mean_30, {REGIME} AS regime FROM revenue r JOIN (SELECT date, {strict('revenue', 30)} AS mean_30 FROM revenue) m USING (date) JOIN pcal c USING (date)")


def regime_history(s):
    cal = pr.promo_calendar(active_days(s), s.spine()).select("date", F.expr(REGIME).alias("regime"))
    r = s.revenue().select("series_id", "date", "revenue", win.lag("revenue", 7).alias("lag_7"), win.roll_mean("revenue", 30).alias("mean_30"))
    return r.join(cal, "date")


@query(
    "regime_models",
    "regime:s b0:2 b1:6 b2:6",
    sql(
        "rhist",
        "SELECT g.regime, COALESCE(r.b0, w.b0) AS b0, COALESCE(r.b1, w.b1) AS b1, COALESCE(r.b2, w.b2) AS b2 FROM (SELECT DISTINCT regime FROM train WHERE lag_7 IS NOT NULL AND mean_30 IS NOT NULL) g LEFT JOIN r USING (regime), w",
        train=f"SELECT * FROM rhist WHERE date <= {CUT}", r=ridge_sql("train", "regime", "revenue", "lag_7", "mean_30", 10, min_rows=150), w=ridge_sql("train", "series_id", "revenue", "lag_7", "mean_30", 10),
    ),
)
def regime_models(s):
    """One model per promotion regime; a regime with under 150 training days uses the common one."""
    return coefs(md.fit_with_fallback(until_cut(regime_history(s)), ["lag_7", "mean_30"], "revenue", 10.0, "series_id", "regime", 150))


@query(
    "regime_forecast_metrics",
    "regime:s rows:i " + BASIC_OUT,
    sql(
        "rhist",
        f"SELECT regime, {M_SQL} FROM (SELECT v.regime, v.revenue AS actual, COALESCE(r.b0, w.b0) + COALESCE(r.b1, w.b1) * lag_7 + COALESCE(r.b2, w.b2) * mean_30 AS predicted FROM rhist v LEFT JOIN r USING (regime), w WHERE v.date > {CUT}) GROUP BY 1",
        train=f"SELECT * FROM rhist WHERE date <= {CUT}", r=ridge_sql("train", "regime", "revenue", "lag_7", "mean_30", 10, min_rows=150), w=ridge_sql("train", "series_id", "revenue", "lag_7", "mean_30", 10),
    ),
)
def regime_forecast_metrics(s):
    h = regime_history(s)
    m = md.fit_with_fallback(until_cut(h), ["lag_7", "mean_30"], "revenue", 10.0, "series_id", "regime", 150)
    v = md.score(h.where("date > date'1999-12-31'").withColumnRenamed("revenue", "actual"), m, ["lag_7", "mean_30"], ["series_id", "regime"])
    return mt.regression_metrics(v, ["regime"])


# -- walk-forward -----------------------------------------------------------------------
cte("wf", "scored", "SELECT *, CAST(DATE_TRUNC('month', date) AS DATE) AS fold, GREATEST(0.75, LEAST(1.35, actual / NULLIF(base_pred, 0))) AS target FROM scored")


@query(
    "walk_forward_scale",
    "date:d target:6 raw_scale:6 final_pred:1",
    sql(
        "wf",
        "SELECT w.date, w.target, COALESCE(b0 + b1 * spike_prob + b2 * avg_discount_value, 1) AS raw_scale, base_pred * GREATEST(0.97, LEAST(1.12, COALESCE(b0 + b1 * spike_prob + b2 * avg_discount_value, 1))) AS final_pred FROM wf w LEFT JOIN m USING (fold)",
        past="SELECT f.fold, w.target, w.spike_prob, w.avg_discount_value FROM (SELECT DISTINCT fold FROM wf) f JOIN wf w ON w.fold < f.fold",
        m=ridge_sql("past", "fold", "target", "spike_prob", "avg_discount_value", 10, min_rows=45),
    ),
)
def walk_forward_scale(s):
    """Month-by-month meta scale trained on earlier months only."""
    from aisleflow.operators.blend import scale_target

    d = scored(s).select("*", F.trunc("date", "month").alias("fold"), scale_target().alias("target"))
    w = md.walk_forward(d, ["spike_prob", "avg_discount_value"], "target", "fold", 10.0, "series_id", 45, "raw_scale", F.lit(1.0))
    return w.withColumn("final_pred", F.col("base_pred") * fx.clip("raw_scale", 0.97, 1.12))


cte("ohist", "daily", f"SELECT series_id, date, YEAR(date) AS fold, orders_count::DOUBLE AS orders, {lagged('orders_count', 7)} AS lag_7, {strict('orders_count', 30)} AS mean_30 FROM daily")


@query(
    "orders_out_of_fold",
    "date:d orders:2 predicted_orders:6",
    sql(
        "ohist",
        "SELECT w.date, w.orders, GREATEST(0, b0 + b1 * lag_7 + b2 * mean_30) AS predicted_orders FROM ohist w JOIN m USING (fold)",
        past="SELECT f.fold, w.orders, w.lag_7, w.mean_30 FROM (SELECT DISTINCT fold FROM ohist) f JOIN ohist w ON w.fold < f.fold", m=ridge_sql("past", "fold", "orders", "lag_7", "mean_30", 5, min_rows=200),
    ),
)
def orders_out_of_fold(s):
    """Yearly folds: orders of each year predicted by a model of the years before."""
    d = s.order_series().select("series_id", "date", F.year("date").alias("fold"), F.col("orders_count").cast("double").alias("orders"), win.lag("orders_count", 7).alias("lag_7"), win.roll_mean("orders_count", 30).alias("mean_30"))
    w = md.walk_forward(d, ["lag_7", "mean_30"], "orders", "fold", 5.0, "series_id", 200, "p", F.lit(None).cast("double"))
    return w.where("p is not null").withColumn("predicted_orders", fx.clip("p", lo=0))


WINDOWS = [{"train_window": "from_1995", "start": "1995-01-01"}, {"train_window": "from_1997", "start": "1997-01-01"}, {"train_window": "from_1999", "start": "1999-01-01"}]


@query(
    "training_window_comparison",
    "train_window:s rows:i " + BASIC_OUT,
    sql(
        "phist",
        f"SELECT train_window, {M_SQL} FROM (SELECT m.train_window, v.revenue AS actual, b0 + b1 * lag_7 + b2 * mean_30 AS predicted FROM phist v JOIN m USING (series_id) WHERE v.date > {CUT}) GROUP BY 1",
        t=f"SELECT w.train_window, p.* FROM phist p JOIN (VALUES ('from_1995', DATE '1995-01-01'), ('from_1997', DATE '1997-01-01'), ('from_1999', DATE '1999-01-01')) w(train_window, start) ON p.date >= start AND p.date <= {CUT}",
        m=ridge_sql("t", "train_window, series_id", "revenue", "lag_7", "mean_30", 10),
    ),
)
def training_window_comparison(s):
    """Three training starts fitted for every series in one aggregation."""
    from aisleflow.operators.blend import with_grid

    p = panel_history(s)
    t = with_grid(until_cut(p), WINDOWS).where(F.col("date") >= F.col("start").cast("date"))
    m = md.fit_ridge(t, ["lag_7", "mean_30"], "revenue", 10.0, ["train_window", "series_id"])
    v = p.where("date > date'1999-12-31'").withColumnRenamed("revenue", "actual").join(m.select("train_window", "series_id", "coef"), "series_id")
    return mt.regression_metrics(v.withColumn("predicted", md.linear(["lag_7", "mean_30"])), ["train_window"])


@query(
    "specialist_comparison",
    "specialist:s rows:i " + BASIC_OUT,
    sql(
        "phist",
        f"SELECT specialist, {M_SQL} FROM (SELECT 'short' AS specialist, v.revenue AS actual, b0 + b1 * lag_7 + b2 * mean_30 AS predicted FROM phist v JOIN a USING (series_id) WHERE v.date > {CUT} UNION ALL SELECT 'seasonal', v.revenue, b0 + b1 * lag_365 + b2 * mean_365 FROM phist v JOIN b USING (series_id) WHERE v.date > {CUT}) GROUP BY 1",
        a=ridge_sql("phist", "series_id", "revenue", "lag_7", "mean_30", 10, f"date <= {CUT}"), b=ridge_sql("phist", "series_id", "revenue", "lag_365", "mean_365", 10, f"date <= {CUT}"),
    ),
)
def specialist_comparison(s):
    """Models on different feature subsets, compared on the same days."""
    p = panel_history(s)
    valid = p.where("date > date'1999-12-31'").withColumnRenamed("revenue", "actual")
    out = []
    for name, feats in (("short", ["lag_7", "mean_30"]), ("seasonal", ["lag_365", "mean_365"])):
        m = md.fit_ridge(until_cut(p), feats, "revenue", 10.0, ["series_id"])
        out.append(md.score(valid, m, feats, ["series_id"]).withColumn("specialist", F.lit(name)))
    return mt.regression_metrics(out[0].unionByName(out[1]), ["specialist"])


@query(
    "residual_model",
    "date:d base:2 residual_pred:2 final_pred:2",
    sql(
        "components",
        "SELECT c.date, c.weekday AS base, b0 + b1 * last_year + b2 * level AS residual_pred, GREATEST(0, c.weekday + b0 + b1 * last_year + b2 * level) AS final_pred FROM components c, m WHERE c.date > DATE '1999-12-31'",
        m=ridge_sql("(SELECT *, actual - weekday AS res FROM components)", "series_id", "res", "last_year", "level", 10, f"date <= {CUT}"),
    ),
)
def residual_model(s):
    """Second stage: what a base forecast still misses, from two more signals."""
    d = s.components().withColumn("res", F.col("actual") - F.col("weekday"))
    m = md.fit_ridge(until_cut(d), ["last_year", "level"], "res", 10.0, ["series_id"])
    v = md.score(d.where("date > date'1999-12-31'"), m, ["last_year", "level"], ["series_id"], "residual_pred")
    return v.select("date", F.col("weekday").alias("base"), "residual_pred", fx.clip(F.col("weekday") + F.col("residual_pred"), lo=0).alias("final_pred"))


@query(
    "quantile_forecast",
    "date:d regime:s q65:2 q70:2 q75:2",
    sql(
        "components pcal",
        "SELECT d.date, d.regime, " + ", ".join(f"GREATEST(0, d.weekday + q.q{a}) AS q{a}" for a in (65, 70, 75)) + " FROM d LEFT JOIN (SELECT regime, " + ", ".join(f"QUANTILE_CONT(actual - weekday, 0.{a}) AS q{a}" for a in (65, 70, 75)) + f" FROM d WHERE date <= {CUT} GROUP BY 1) q USING (regime) WHERE d.date > {CUT}",
        d=f"SELECT c.*, {REGIME} AS regime FROM components c JOIN pcal USING (date)",
    ),
)
def quantile_forecast(s):
    cal = pr.promo_calendar(active_days(s), s.spine()).select("date", F.expr(REGIME).alias("regime"))
    d = s.components().select("date", "actual", F.col("weekday").alias("predicted")).join(cal, "date")
    return md.conformal_quantile(d, F.col("date") <= F.lit("1999-12-31").cast("date"), ["regime"], [0.65, 0.70, 0.75])


def chained(needs: str, steps: dict[str, str], body: str) -> str:
    """SQL with named steps, each kept once it is computed."""
    given = sql(needs, "").strip().removeprefix("WITH ")
    return "WITH " + ",\n".join([given, *[f"{k} AS MATERIALIZED ({b})" for k, b in steps.items()]]) + "\n" + body


def wls_sql(source: str, by: str, w: str, extra: str = "") -> str:
    """Weighted least squares of y on x1 and x2 per group by centred sums, in closed form."""
    sums = ", ".join(f"SUM(w * ({a} - m{a}) * ({b} - m{b})) AS {n}" for n, a, b in (("c11", "x1", "x1"), ("c12", "x1", "x2"), ("c22", "x2", "x2"), ("c1", "x1", "y"), ("c2", "x2", "y")))
    means = ", ".join(f"SUM(w * {a}) OVER p / SUM(w) OVER p AS m{a}" for a in ("x1", "x2", "y"))
    return f"""SELECT *, my - b1 * mx1 - b2 * mx2 AS b0 FROM (
      SELECT *, (c22 * c1 - c12 * c2) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2 - c12 * c1) / (c11 * c22 - c12 * c12) AS b2 FROM (
        SELECT {by}, ANY_VALUE(mx1) AS mx1, ANY_VALUE(mx2) AS mx2, ANY_VALUE(my) AS my, {sums}{extra} FROM (
          SELECT *, {means} FROM (SELECT *, {w} AS w FROM ({source})) WINDOW p AS (PARTITION BY {by})) GROUP BY {by}))"""


ALPHAS = [0.65, 0.70, 0.75]


def pinball_sql(body: str) -> str:
    rows = f"SELECT series_id, date, lag_7 AS x1, mean_30 AS x2, revenue AS y, UNNEST([{', '.join(f'{a}::DOUBLE' for a in ALPHAS)}]) AS alpha FROM phist WHERE date <= {CUT} AND lag_7 IS NOT NULL AND mean_30 IS NOT NULL"
    steps = {"prow": rows, "pin0": wls_sql("SELECT * FROM prow", "series_id, alpha", "1::DOUBLE")}
    r = "(y - (b0 + b1 * x1 + b2 * x2))"
    steps["least"] = f"SELECT series_id, alpha, 0.1::DOUBLE * AVG(ABS({r})) AS least FROM prow JOIN pin0 USING (series_id, alpha) GROUP BY 1, 2"
    for i in range(rb.STEPS):
        source = f"SELECT p.*, least, {r} AS r FROM prow p JOIN (SELECT series_id, alpha, b0, b1, b2 FROM pin{i}) USING (series_id, alpha) JOIN least USING (series_id, alpha)"
        steps[f"pin{i + 1}"] = wls_sql(source, "series_id, alpha", "(CASE WHEN r >= 0 THEN alpha ELSE 1 - alpha END) / GREATEST(ABS(r), least, 1e-9::DOUBLE)")
    last = f"pin{rb.STEPS}"
    pick = " ".join(f"WHEN {a}::DOUBLE THEN QUANTILE_CONT(r, {a})" for a in ALPHAS)
    steps["pinned"] = f"SELECT series_id, alpha, ANY_VALUE(b0) + CASE alpha {pick} END AS b0, ANY_VALUE(b1) AS b1, ANY_VALUE(b2) AS b2 FROM (SELECT p.*, b0, b1, b2, {r} AS r FROM prow p JOIN {last} USING (series_id, alpha)) GROUP BY series_id, alpha"
    return chained("phist", steps, body)


def pinball_models(s):
    return rb.fit_pinball(until_cut(panel_history(s)).select("series_id", "date", "revenue", "lag_7", "mean_30"), ["lag_7", "mean_30"], "revenue", ["series_id"], ALPHAS, rb.STEPS)


@query(
    "pinball_forecast",
    "series_id:s date:d q65:1 q70:1 q75:1",
    pinball_sql("SELECT p.series_id, date, " + ", ".join(f"MAX(CASE WHEN alpha = {a}::DOUBLE THEN GREATEST(0, b0 + b1 * lag_7 + b2 * mean_30) END) AS q{round(a * 100)}" for a in ALPHAS) + f" FROM phist p JOIN pinned USING (series_id) WHERE date > {CUT} GROUP BY 1, 2"),
)
def pinball_forecast(s):
    """Quantile forecasts by pinball loss, one model per series and alpha."""
    v = panel_history(s).where("date > date'1999-12-31'").join(pinball_models(s), "series_id")
    value = fx.clip(md.linear(["lag_7", "mean_30"]), lo=0)
    return v.groupBy("series_id", "date").agg(*[F.max(F.when(F.col("alpha") == a, value)).alias(f"q{round(a * 100)}") for a in ALPHAS])


@query(
    "pinball_coverage",
    "series_id:s alpha:2 n:i within_one_row:b",
    pinball_sql("SELECT series_id, alpha, COUNT(*) AS n, ABS(COUNT(*) FILTER (y - (b0 + b1 * x1 + b2 * x2) <= 1e-6::DOUBLE) - alpha * COUNT(*)) <= 1 AS within_one_row FROM prow JOIN pinned USING (series_id, alpha) GROUP BY 1, 2"),
)
def pinball_coverage(s):
    """Whether the training rows at or below each quantile line are alpha of all, up to one row."""
    t = until_cut(panel_history(s)).na.drop(subset=["lag_7", "mean_30"]).join(pinball_models(s), "series_id")
    below = F.count_if(F.col("revenue") - md.linear(["lag_7", "mean_30"]) <= 1e-6)
    return t.groupBy("series_id", "alpha").agg(F.count(F.lit(1)).alias("n"), below.alias("below")).withColumn("within_one_row", F.abs(F.col("below") - F.col("alpha") * F.col("n")) <= 1)


# -- direct forecasts ------------------------------------------------------------------
cte(
    "direct",
    "seasonal",
    "SELECT *, CASE WHEN baseline > 0 THEN revenue / baseline END AS target_ratio, CASE WHEN baseline > 0 THEN LN(GREATEST(revenue / baseline, 1e-6)) END AS target_log_ratio FROM seasonal",
)


def _direct_sql(target, expr, lo, hi):
    filled = ", ".join(f"COALESCE({c}, (SELECT MEDIAN({c}) FROM direct WHERE date <= {CUT})) AS {c}" for c in ("lag1_to_same_day", "lag1_to_lag2"))
    return f"SELECT d.date, d.baseline, GREATEST({lo}, LEAST({hi}, {expr})) AS ratio, GREATEST(0, d.baseline * GREATEST({lo}, LEAST({hi}, {expr}))) AS predicted FROM (SELECT series_id, date, baseline, {filled} FROM direct) d JOIN m USING (series_id) WHERE d.date > {CUT}"


@query(
    "direct_ratio_forecast",
    "target_type:s date:d baseline:3 ratio:6 predicted:1",
    sql(
        "direct",
        "SELECT 'ratio' AS target_type, * FROM (" + _direct_sql("target_ratio", "b0 + b1 * lag1_to_same_day + b2 * lag1_to_lag2", 0.4, 2.5) + ") UNION ALL SELECT 'log_ratio', * FROM ("
        + _direct_sql("target_log_ratio", "EXP(n0 + n1 * lag1_to_same_day + n2 * lag1_to_lag2)", 0.4, 2.5).replace("JOIN m", "JOIN (SELECT series_id, b0 AS n0, b1 AS n1, b2 AS n2 FROM ml)") + ")",
        m=ridge_sql("direct", "series_id", "target_ratio", "lag1_to_same_day", "lag1_to_lag2", 10, f"date <= {CUT}"), ml=ridge_sql("direct", "series_id", "target_log_ratio", "lag1_to_same_day", "lag1_to_lag2", 10, f"date <= {CUT}"),
    ),
)
def direct_ratio_forecast(s):
    """Long horizon without recursion: a seasonal baseline times a fitted ratio or log ratio."""
    feats = ["lag1_to_same_day", "lag1_to_lag2"]
    d = md.ratio_targets(seasonal_table(s), "revenue", "baseline")
    train = until_cut(d)
    # after the cutoff some references are unknown: training medians stand in
    ahead = fx.apply_medians(d.where("date > date'1999-12-31'"), fx.fit_medians(train, feats, ["series_id"]), feats, ["series_id"])
    out = []
    for kind, target in (("ratio", "target_ratio"), ("log_ratio", "target_log_ratio")):
        raw = md.score(ahead, md.fit_ridge(train, feats, target, 10.0, ["series_id"]), feats, ["series_id"], "_r")
        ratio = fx.clip(F.exp("_r") if kind == "log_ratio" else F.col("_r"), 0.4, 2.5)
        out.append(raw.select(F.lit(kind).alias("target_type"), "date", "baseline", ratio.alias("ratio"), md.from_ratio("baseline", ratio, 0.4, 2.5).alias("predicted")))
    return out[0].unionByName(out[1])


cte(
    "pbase",
    "panel",
    f"""SELECT *, CASE WHEN baseline > 0 THEN LN(GREATEST(revenue / baseline, 1e-6)) END AS y FROM (SELECT t.series_id, t.date, t.revenue, {_wavg([(0.5, 'a.revenue'), (0.3, 'b.revenue'), (0.2, 'c.revenue')])} AS baseline, MONTH(t.date)::DOUBLE AS month, (ISODOW(t.date) - 1)::DOUBLE AS dow
         FROM panel t {_back(1, 'a', 'panel', guard=False)} {_back(2, 'b', 'panel', guard=False)} {_back(3, 'c', 'panel', guard=False)})""",
)


@query(
    "direct_panel_forecast",
    "date:d predicted_revenue:1 predicted_cogs:1 series:i",
    sql(
        "pbase panel",
        f"""SELECT date, SUM(p) AS predicted_revenue, SUM(p * ratio) AS predicted_cogs, COUNT(p) AS series FROM (SELECT d.date, ratio, GREATEST(0, baseline * GREATEST(0.2, LEAST(5, EXP(b0 + b1 * month + b2 * dow)))) AS p
           FROM pbase d JOIN m USING (series_id) JOIN (SELECT series_id, SUM(cogs) / SUM(revenue) AS ratio FROM panel WHERE date <= {CUT} GROUP BY 1) r USING (series_id) WHERE d.date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') GROUP BY date""",
        m=ridge_sql("pbase", "series_id", "y", "month", "dow", 10, f"date <= {CUT}"),
    ),
)
def direct_panel_forecast(s):
    """Per-series log-ratio models, COGS by the series' own ratio, summed bottom-up."""
    p = s.panel()
    t = ref.year_references(p.select("series_id", "date", "revenue"), p, "revenue", "lag")
    t = t.select("*", fx.weighted_avg([(w, f"lag_{k}y") for k, w in ref.YEAR_WEIGHTS]).alias("baseline"), F.month("date").cast("double").alias("month"), F.weekday("date").cast("double").alias("dow"))
    d = md.ratio_targets(t, "revenue", "baseline")
    m = md.fit_ridge(until_cut(d), ["month", "dow"], "target_log_ratio", 10.0, ["series_id"])
    ratios = ref.cogs_ratio_by_series(p, F.lit("1999-12-31").cast("date"))
    v = md.score(d.where("date between date'2000-01-01' and date'2000-12-31'"), m, ["month", "dow"], ["series_id"], "_r").join(ratios, "series_id")
    v = v.withColumn("p", md.from_ratio("baseline", F.exp("_r"), 0.2, 5.0))
    return v.groupBy("date").agg(F.sum("p").alias("predicted_revenue"), F.sum(F.col("p") * F.col("cogs_ratio")).alias("predicted_cogs"), F.count("p").alias("series"))


# -- recursive forecasts -----------------------------------------------------------------
REC = f"""WITH RECURSIVE __CTES__,
rec AS (
  SELECT series_id, 0 AS i, h, NULL::DOUBLE AS p FROM (SELECT series_id, LIST(revenue ORDER BY date) AS h FROM panel WHERE date <= {CUT} GROUP BY 1)
  UNION ALL
  SELECT series_id, i + 1, LIST_APPEND(h, np), np FROM (SELECT r.series_id, r.i, r.h, GREATEST(0, b0 + b1 * h[-7] + b2 * LIST_AVG(h[-30:])) AS np FROM rec r JOIN pfit USING (series_id) WHERE i < 579))
"""


def rec_sql(body):
    full = sql("pfit", "SELECT 1")
    return REC.replace("__CTES__", full[len("WITH "): full.rindex("\nSELECT 1")]) + body


def recursive_panel(s):
    p = panel_history(s)
    m = md.fit_ridge(until_cut(p), ["lag_7", "mean_30"], "revenue", 10.0, ["series_id"])
    ahead = p.where("date > date'1999-12-31'").select("series_id", "date")
    return rc.recursive_linear(until_cut(p).select("series_id", "date", "revenue"), ahead, "revenue", ["series_id"], m, [("lag", 7), ("mean", 30)])


@query(
    "recursive_panel_forecast",
    "series_id:s date:d predicted:1",
    rec_sql(f"SELECT series_id, {CUT} + i::INT AS date, p AS predicted FROM rec WHERE i > 0"),
)
def recursive_panel_forecast(s):
    return recursive_panel(s)


@query(
    "recursive_bottom_up_forecast",
    "date:d predicted_revenue:1 series:i",
    rec_sql(f"SELECT {CUT} + i::INT AS date, SUM(p) AS predicted_revenue, COUNT(p) AS series FROM rec WHERE i > 0 GROUP BY 1"),
)
def recursive_bottom_up_forecast(s):
    return recursive_panel(s).groupBy("date").agg(F.sum("predicted").alias("predicted_revenue"), F.count("predicted").alias("series"))


ADA = f"""WITH RECURSIVE __CTES__,
thr AS (SELECT MEDIAN(v) AS t FROM (SELECT sd / (ABS(m) + 1e-6::DOUBLE) AS v FROM (SELECT {strict('revenue', 30, 'STDDEV_SAMP')} AS sd, {strict('revenue', 30)} AS m FROM revenue WHERE date <= {CUT}))),
fc AS (SELECT DATE_DIFF('day', {CUT}, date) AS k, recent AS calm, last_year AS spiky FROM components WHERE date > {CUT}),
ada AS (
  SELECT 0 AS i, h, NULL::DOUBLE AS p FROM (SELECT LIST(revenue ORDER BY date) AS h FROM revenue WHERE date <= {CUT})
  UNION ALL
  SELECT i + 1, LIST_APPEND(h, np), np FROM (SELECT i, h, GREATEST(0, w * spiky + (1 - w) * calm) AS np FROM (
    SELECT a.i, a.h, f.calm, f.spiky, GREATEST(0.15::DOUBLE, LEAST(0.85::DOUBLE, 0.5::DOUBLE + CASE WHEN h[-7] / m > 1.2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN sd / m > (SELECT t FROM thr) THEN 0.1::DOUBLE ELSE 0 END
        + CASE WHEN h[-365] / m > 1.3 THEN 0.1::DOUBLE ELSE 0 END)) AS w
    FROM (SELECT i, h, LIST_AVG(h[-30:]) AS m, LIST_STDDEV_SAMP(h[-30:]) AS sd FROM ada) a JOIN fc f ON f.k = a.i + 1)))
SELECT {CUT} + i::INT AS date, p AS predicted FROM ada WHERE i > 0"""


def ada_sql():
    full = sql("components", "SELECT 1")
    return ADA.replace("__CTES__", full[len("WITH "): full.rindex("\nSELECT 1")])


@query("adaptive_spike_blend", "date:d predicted:2", ada_sql())
def adaptive_spike_blend(s):
    """Two forecasts blended with a weight that reads the blended past."""
    r = until_cut(s.revenue())
    f = s.components().where("date > date'1999-12-31'").select("series_id", "date", F.col("recent").alias("calm"), F.col("last_year").alias("spiky"))
    return rc.adaptive_blend(r, f, "revenue", ["series_id"], ft.volatility_threshold(r), 0.5)


# -- driver composition -------------------------------------------------------------------
@query(
    "orders_times_value",
    "date:d predicted_revenue:3 stabilized_revenue:3",
    sql("drivers components", "SELECT date, GREATEST(0, predicted_orders * predicted_aov) AS predicted_revenue, GREATEST(0, 0.7::DOUBLE * GREATEST(0, predicted_orders * predicted_aov) + 0.3::DOUBLE * COALESCE(last_year, GREATEST(0, predicted_orders * predicted_aov))) AS stabilized_revenue FROM drivers JOIN components USING (date)"),
)
def orders_times_value(s):
    d = drivers(s).join(s.components().select("date", "last_year"), "date")
    o, v = F.col("predicted_orders"), F.col("predicted_aov")
    return d.select("date", md.compose(o, v).alias("predicted_revenue"), md.compose(o, v, F.col("last_year")).alias("stabilized_revenue"))


@query(
    "orders_from_conversion",
    "date:d predicted_conversion:6 predicted_orders:4",
    sql("funnel", f"SELECT date, c AS predicted_conversion, c * s AS predicted_orders FROM (SELECT date, CASE WHEN {strict('conversion_rate', 30)} IS NOT NULL THEN GREATEST(0, LEAST(1, {strict('conversion_rate', 30)})) END AS c, {strict('web_sessions', 7)} AS s FROM funnel)"),
)
def orders_from_conversion(s):
    """Forecast conversion (kept within 0..1) times forecast sessions, both from earlier days only."""
    f = funnel(s).select("series_id", "date", "conversion_rate", "web_sessions")
    d = f.select("date", fx.clip(win.roll_mean("conversion_rate", 30), 0, 1).alias("predicted_conversion"), win.roll_mean("web_sessions", 7).alias("_s"))
    return d.withColumn("predicted_orders", F.col("predicted_conversion") * F.col("_s"))


cte("aovf", "funnel", f"SELECT date, series_id, aov, {lagged('aov', 365)} AS aov_lag_365, {strict('aov', 30)} AS m30, {strict('aov', 365)} AS m365 FROM funnel")


@query(
    "order_value_ratio_forecast",
    "clip_name:s date:d ratio:6 predicted_aov:3",
    sql(
        "aovf",
        f"""SELECT n AS clip_name, date, GREATEST(lo, LEAST(hi, m30 / NULLIF(m365, 0))) AS ratio, GREATEST(0, GREATEST(lo, LEAST(hi, m30 / NULLIF(m365, 0))) * COALESCE(NULLIF(aov_lag_365, 0), m365)) AS predicted_aov FROM aovf, (
             SELECT 'p5p95' AS n, QUANTILE_CONT(r, 0.05) AS lo, QUANTILE_CONT(r, 0.95) AS hi FROM tr UNION ALL SELECT 'p10p90', QUANTILE_CONT(r, 0.10), QUANTILE_CONT(r, 0.90) FROM tr) WHERE date > {CUT}""",
        tr=f"SELECT aov / NULLIF(aov_lag_365, 0) AS r FROM aovf WHERE date <= {CUT}",
    ),
)
def order_value_ratio_forecast(s):
    """Recent level against the yearly level, clipped to the training ratios, times last year."""
    f = funnel(s).select("series_id", "date", "aov", win.lag("aov", 365).alias("aov_lag_365"), win.roll_mean("aov", 30).alias("m30"), win.roll_mean("aov", 365).alias("m365"))
    r = until_cut(f).select("series_id", F.try_divide(F.col("aov"), F.col("aov_lag_365")).alias("r"))
    q = r.groupBy("series_id").agg(F.percentile("r", F.array(*[F.lit(p) for p in (0.05, 0.95, 0.10, 0.90)])).alias("q"))
    d = f.where("date > date'1999-12-31'").join(q, "series_id")
    clips = F.array(*[F.struct(F.lit(n).alias("clip_name"), F.col("q")[i].alias("lo"), F.col("q")[i + 1].alias("hi")) for n, i in (("p5p95", 0), ("p10p90", 2))])
    g = d.select("date", "aov_lag_365", "m30", "m365", F.inline(clips))
    ratio = F.greatest("lo", F.least("hi", F.try_divide(F.col("m30"), F.col("m365"))))
    base = F.coalesce(F.when(F.col("aov_lag_365") != 0, F.col("aov_lag_365")), F.col("m365"))
    return g.select("clip_name", "date", ratio.alias("ratio"), fx.clip(ratio * base, lo=0).alias("predicted_aov"))


# -- preparation, importance and selection ---------------------------------------------------
@query(
    "median_imputed_features",
    "series_id:s date:d lag_365:4 mean_30:3",
    sql("phist", f"SELECT p.series_id, p.date, COALESCE(p.lag_365, a, 0) AS lag_365, COALESCE(p.mean_30, b, 0) AS mean_30 FROM phist p JOIN (SELECT series_id, MEDIAN(lag_365) AS a, MEDIAN(mean_30) AS b FROM phist WHERE date <= {CUT} GROUP BY 1) USING (series_id)"),
)
def median_imputed_features(s):
    p = panel_history(s)
    med = fx.fit_medians(until_cut(p), ["lag_365", "mean_30"], ["series_id"])
    return fx.apply_medians(p, med, ["lag_365", "mean_30"], ["series_id"])


SEGMENTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]


cte("fitted", "facts", f"SELECT segment, ROW_NUMBER() OVER (ORDER BY segment) - 1 AS i FROM (SELECT DISTINCT segment FROM facts WHERE date <= {CUT} AND segment IS NOT NULL)")


@query(
    "one_hot_segments",
    "product_id:i " + " ".join(f"segment_{v}:i" for v in [*SEGMENTS, "other"]),
    sql("", "SELECT p_partkey AS product_id, " + ", ".join(f"CAST(p_type = '{v}' AS INT) AS segment_{v}" for v in SEGMENTS) + f", CAST(p_type NOT IN ({', '.join(repr(v) for v in SEGMENTS)}) AS INT) AS segment_other FROM part"),
)
def one_hot_segments(s):
    """A given template of five segments; any other segment goes to the last column."""
    return fx.one_hot(s.products().select("product_id", "segment"), "segment", SEGMENTS, other="other")


@query(
    "one_hot_fitted",
    "product_id:i segment_code:i width:i segment_onehot:s",
    sql(
        "fitted",
        """SELECT p_partkey AS product_id, code AS segment_code, n + 1 AS width, array_to_string(list_transform(range(0, n + 1), lambda i: CAST(i = code AS INT)), ',') AS segment_onehot
           FROM (SELECT p_partkey, COALESCE(i, n) AS code, n FROM part LEFT JOIN fitted ON p_type = segment, (SELECT COUNT(*) AS n FROM fitted))""",
    ),
)
def one_hot_fitted(s):
    """Segments of the products sold in training; a segment first sold later is other."""
    train = until_cut(s.lines()).select("product_id").distinct().join(s.products().select("product_id", "segment"), "product_id")
    out = fx.one_hot_codes(s.products().select("product_id", "segment"), "segment", fx.fit_categories(train, "segment"))
    return out.select("product_id", "segment_code", F.size("segment_onehot").alias("width"), F.array_join("segment_onehot", ",").alias("segment_onehot"))


@query(
    "permutation_importance",
    "series_id:s feature:s base_rmse:2 shuffled_rmse:2",
    sql(
        "pfit",
        """SELECT s.series_id, s.feature, b.rmse AS base_rmse, s.rmse AS shuffled_rmse FROM (
             SELECT series_id, feature, SQRT(AVG(e * e)) AS rmse FROM (
               SELECT v.series_id, 'lag_7' AS feature, v.revenue - (b0 + b1 * m.x + b2 * v.mean_30) AS e FROM v JOIN (SELECT series_id, lag_7 AS x, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY md5(CAST(date AS VARCHAR) || 'lag_7'), date) AS i FROM v) m USING (series_id, i) JOIN pfit USING (series_id)
               UNION ALL SELECT v.series_id, 'mean_30', v.revenue - (b0 + b1 * v.lag_7 + b2 * m.x) FROM v JOIN (SELECT series_id, mean_30 AS x, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY md5(CAST(date AS VARCHAR) || 'mean_30'), date) AS i FROM v) m USING (series_id, i) JOIN pfit USING (series_id)) GROUP BY ALL) s
           JOIN (SELECT series_id, SQRT(AVG((revenue - (b0 + b1 * lag_7 + b2 * mean_30)) * (revenue - (b0 + b1 * lag_7 + b2 * mean_30)))) AS rmse FROM v JOIN pfit USING (series_id) GROUP BY 1) b USING (series_id)""",
        v=f"SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS i FROM phist WHERE date > {CUT}",
    ),
)
def permutation_importance(s):
    p = panel_history(s)
    m = md.fit_ridge(until_cut(p), ["lag_7", "mean_30"], "revenue", 10.0, ["series_id"])
    v = p.where("date > date'1999-12-31'").withColumn("actual", F.col("revenue"))
    return md.permutation_importance(v, m, ["lag_7", "mean_30"])


@query(
    "correlation_pruned_features",
    "position:i feature:s",
    sql(
        "importance g",
        """SELECT UNNEST(range(LEN(sel))) AS position, UNNEST(sel) AS feature FROM (SELECT STRING_SPLIT(LIST_REDUCE(names, lambda acc, x:
             CASE WHEN LEN(STRING_SPLIT(acc, ';')) >= 5 OR LEN(LIST_FILTER(STRING_SPLIT(acc, ';'), lambda k: COALESCE(m[k || '|' || x], 0) >= 0.5)) > 0 THEN acc ELSE acc || ';' || x END), ';') AS sel
             FROM (SELECT (SELECT LIST(feature ORDER BY importance DESC, feature) FROM importance) AS names, (SELECT MAP(LIST(a || '|' || b ORDER BY a, b), LIST(c ORDER BY a, b)) FROM corr) AS m))""",
        corr=" SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ABS(CORR({a}, {b})) AS c FROM g" for a in FEATURES for b in FEATURES if a != b) + ")",
    ),
)
def correlation_pruned_features(s):
    g = win.add_lag_grid(s.daily(), ["revenue", "orders_count"], [7, 14, 30], [7, 30])
    return md.select_features(importance(s), dq.corr_matrix(g, FEATURES), 0.5, 5)


# -- boosting from moments --------------------------------------------------------------------
#: Columns of the feature blocks that the boosted model may split: history, spikes, strengths, calendar and promotions.
BOOSTED = [
    *[f"revenue_lag_{k}" for k in ft.LAGS], *[f"revenue_roll_mean_{w}" for w in ft.MEANS], *[f"revenue_roll_std_{w}" for w in ft.STDS], *[f"rel_volatility_{w}" for w in ft.STDS], *RATIOS, *SPIKES,
    *[f"z_{k}_{w}" for k, w in ZS], *[f"lag{k}_above_p{q}" for k, q in ABOVE], "momentum_7_30", "momentum_14_60", "momentum_30_90", "month", "day_of_week", "day_of_year", "any_promo", "avg_discount_value", "active_promo_count",
]


def boosted_sql(body: str) -> str:
    """The rounds of the boosted model by lists of bins: one recursion step per round."""
    n, bins, cells = len(BOOSTED), bo.BINS, len(BOOSTED) * bo.BINS
    digits = lambda x: f"(FLOOR(({x}) * 1000000000 + 0.5::DOUBLE) / 1000000000)"
    cut = lambda f: f"LIST_TRANSFORM(QUANTILE_CONT({f}, [{', '.join(f'{i / bins}::DOUBLE' for i in range(1, bins))}]) FILTER (part = 0), lambda x: {half_up_sql('x', 6)})"
    pairs = lambda part: f"SELECT LIST(own ORDER BY i) AS m FROM (SELECT i, LIST(COALESCE(n, 0) ORDER BY j) AS own FROM (SELECT i, j FROM RANGE({cells}) a(i), RANGE({cells}) b(j)) LEFT JOIN (SELECT p.k AS i, q.k AS j, COUNT(*)::DOUBLE AS n FROM cell p JOIN cell q USING (date) WHERE p.part = {part} GROUP BY ALL) USING (i, j) GROUP BY i)"
    sums = lambda part: f"SELECT LIST(COALESCE(s, 0) ORDER BY k) AS g FROM RANGE({cells}) a(k) LEFT JOIN (SELECT k, SUM(revenue - base) AS s FROM cell, ends WHERE part = {part} GROUP BY k) USING (k)"
    rows = f"SELECT date, revenue, CASE WHEN date > {CUT} THEN 2 WHEN date > {CUT} - 365 THEN 1 ELSE 0 END AS part, " + ", ".join(f"{f}::DOUBLE AS {f}" for f in BOOSTED) + " FROM v2"
    steps = {
        "rows_": rows,
        "edge": "SELECT " + ", ".join(f"{cut(f)} AS {f}" for f in BOOSTED) + " FROM rows_",
        "bin": "SELECT date, revenue, part, [" + ", ".join(f"COALESCE(LEN(LIST_FILTER(e.{f}, lambda x: r.{f} > x)), 0)" for f in BOOSTED) + "] AS b FROM rows_ r, edge e",
        "cell": f"SELECT date, revenue, part, (j - 1) * {bins} + b[j] AS k FROM bin, RANGE(1, {n + 1}) t(j)",
        "ends": "SELECT AVG(revenue) FILTER (part = 0) AS base, VAR_POP(revenue) FILTER (part = 0) * COUNT(*) FILTER (part = 0) AS spread FROM bin",
        "vends": "SELECT SUM((revenue - base) * (revenue - base)) AS first FROM bin, ends WHERE part = 1",
        "fitm": pairs(0), "heldm": pairs(1), "fitg": sums(0), "heldg": sums(1),
        "cuts": f"""SELECT LIST({{'o': o, 't': t, 'nl': nl, 'nr': nr}} ORDER BY o, t) AS c FROM (
            SELECT o, t, LIST_SUM(LIST_TRANSFORM(RANGE(o, o + t), lambda k: m[k + 1][k + 1])) AS nl, LIST_SUM(LIST_TRANSFORM(RANGE(o + t, o + {bins}), lambda k: m[k + 1][k + 1])) AS nr
            FROM fitm, (SELECT j * {bins} AS o, t FROM RANGE({n}) a(j), RANGE(1, {bins}) b(t))) WHERE nl >= {bo.LEAST_ROWS} AND nr >= {bo.LEAST_ROWS}""",
    }
    own = f"c.o + 1 : c.o + {bins}"
    rounds = f"""boost AS (
      SELECT 0 AS round, 0 AS o, 0 AS t, 0::DOUBLE AS gain, LIST_TRANSFORM(RANGE({cells}), lambda k: 0::DOUBLE) AS f, fitg.g AS g, heldg.g AS gv, first AS error FROM fitg, heldg, vends
      UNION ALL
      SELECT round + 1, c.o, c.t, share, LIST_TRANSFORM(RANGE({cells}), lambda k: f[k + 1] + CASE WHEN k BETWEEN c.o AND c.o + {bins - 1} THEN u[k - c.o + 1] ELSE 0 END),
        LIST_TRANSFORM(RANGE({cells}), lambda k: g[k + 1] - LIST_DOT_PRODUCT(fm[k + 1][{own}], u)), LIST_TRANSFORM(RANGE({cells}), lambda k: gv[k + 1] - LIST_DOT_PRODUCT(hm[k + 1][{own}], u)),
        error - 2 * LIST_DOT_PRODUCT(gv[{own}], u) + LIST_DOT_PRODUCT(LIST_TRANSFORM(RANGE({bins}), lambda b: LIST_DOT_PRODUCT(hm[c.o + b + 1][{own}], u)), u)
      FROM (SELECT *, LIST_TRANSFORM(RANGE({bins}), lambda b: CASE WHEN b < c.t THEN {bo.RATE}::DOUBLE * gl / c.nl ELSE {bo.RATE}::DOUBLE * (gs - gl) / c.nr END) AS u
        FROM (SELECT *, LIST_SUM(g[c.o + 1 : c.o + c.t]) AS gl, LIST_SUM(g[{own}]) AS gs
          FROM (SELECT *, all_cuts[place] AS c, shares[place] AS share
            FROM (SELECT *, LIST_POSITION(shares, LIST_MAX(shares)) AS place
              FROM (SELECT round, f, g, gv, error, fitm.m AS fm, heldm.m AS hm, cuts.c AS all_cuts, LIST_TRANSFORM(cuts.c, lambda x: {digits(f"(LIST_SUM(g[x.o + 1 : x.o + x.t]) ** 2 / x.nl + LIST_SUM(g[x.o + x.t + 1 : x.o + {bins}]) ** 2 / x.nr - LIST_SUM(g[x.o + 1 : x.o + {bins}]) ** 2 / (x.nl + x.nr)) / spread")}) AS shares
                FROM boost, fitm, heldm, cuts, ends WHERE round < {bo.ROUNDS}))))
        WHERE share > 0))"""
    path = f"path AS (SELECT round, CASE WHEN round > 0 THEN ({BOOSTED!r})[o // {bins} + 1] ELSE '' END AS feature, t AS cut, gain, f, CASE WHEN first > 0 THEN {digits('error / first')} ELSE 1 END AS error FROM boost, vends)"
    chosen = "chosen AS (SELECT * FROM path ORDER BY error, round LIMIT 1)"
    given = sql("v2", "").strip().removeprefix("WITH ")
    return "WITH RECURSIVE " + ",\n".join([given, *[f"{k} AS MATERIALIZED ({b})" for k, b in steps.items()], rounds, path, chosen]) + "\n" + body


@kept
def boosted_table(s):
    return spike_table(s).select("date", "revenue", *BOOSTED)


def boosted_model(s):
    """Boosted split rules over the feature blocks; the last 365 days before the cutoff choose the rounds."""
    return bo.boost(until_cut(boosted_table(s)), BOOSTED, "revenue", F.col("date") > F.date_add(F.lit("1999-12-31").cast("date"), -365))


@query(
    "boosted_forecast",
    "date:d actual:4 predicted:2",
    boosted_sql(f"SELECT date, revenue AS actual, GREATEST(0, base + LIST_SUM(LIST_TRANSFORM(RANGE({len(BOOSTED)}), lambda j: f[j * {bo.BINS} + b[j + 1] + 1]))) AS predicted FROM bin, chosen, ends WHERE part = 2"),
)
def boosted_forecast(s):
    """Days after the cutoff by a model of up to 360 rounds over 40 and more block columns."""
    return boosted_table(s).where("date > date'1999-12-31'").select("date", F.col("revenue").alias("actual"), boosted_model(s).score())


def literal_rows(s, rows, names):
    return s.spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


@query("boosted_rounds", "round:i feature:s cut:i gain:7 error:7 chosen:i", boosted_sql("SELECT p.round, p.feature, p.cut, p.gain, p.error, CAST(p.round = c.round AS INT) AS chosen FROM path p, chosen c"))
def boosted_rounds(s):
    """Every round: the exact best split, the share of squared error it gains, the validation error left."""
    m = boosted_model(s)
    return literal_rows(s, [(*p, int(p[0] == m.best)) for p in m.path], ["round", "feature", "cut", "gain", "error", "chosen"])


@query(
    "boosted_gain_importance",
    "feature:s gain:6 splits:i",
    boosted_sql(f"SELECT feature, COALESCE(gain, 0) AS gain, COALESCE(splits, 0) AS splits FROM (SELECT UNNEST({BOOSTED!r}) AS feature) LEFT JOIN (SELECT p.feature, SUM(p.gain) AS gain, COUNT(*) AS splits FROM path p, chosen c WHERE p.round BETWEEN 1 AND c.round GROUP BY 1) USING (feature)"),
)
def boosted_gain_importance(s):
    return literal_rows(s, boosted_model(s).gain(), ["feature", "gain", "splits"])


# -- trees of pyspark.ml, robust and logistic models ------------------------------------------
ML_FEATURES = ["lag_7", "mean_30", "lag_365", "month", "day_of_week"]
GBT_FEATURES = [*ML_FEATURES, *[f"revenue_lag_{k}" for k in ft.LAGS], *[f"revenue_roll_mean_{w}" for w in ft.MEANS], *[f"revenue_roll_std_{w}" for w in ft.STDS], "day_of_year"]


def ml_table(s, features=tuple(ML_FEATURES)):
    """All rows; look-backs that are not complete get the training median of their series, else 0."""
    history = [f for f in features if f not in ("month", "day_of_week", "day_of_year")]
    p = panel_history(s).join(calendar(s).select("date", "month", "day_of_week", "day_of_year"), "date")
    if set(history) - set(ML_FEATURES):
        p = ft.revenue_history(p)
    return fx.apply_medians(p, fx.fit_medians(until_cut(p), history, ["series_id"]), history, ["series_id"])


@query("gbt_forecast", "series_id:s date:d actual:4 predicted:2")
def gbt_forecast(s):
    """Gradient-boosted trees of depth 5 over the history block of all series, with target weights; the
    last 365 days before the cutoff end the boosting, after 360 rounds at most. Scored after the cutoff."""
    t = ml_table(s, tuple(GBT_FEATURES))
    train = md.quantile_weights(until_cut(t), "revenue", ["series_id"]).withColumn("held", F.col("date") > F.date_add(F.lit("1999-12-31").cast("date"), -365))
    model = md.fit_gbt(train, GBT_FEATURES, "revenue", "target_weight", "held")
    v = model.transform(md.assembled(t.where("date > date'1999-12-31'"), GBT_FEATURES))
    return v.select("series_id", "date", F.col("revenue").alias("actual"), fx.clip("predicted", lo=0).alias("predicted"))


@query("gbt_feature_importance", "feature:s importance:6")
def gbt_feature_importance(s):
    return md.tree_importance(s.spark, md.fit_gbt(until_cut(ml_table(s)), ML_FEATURES, "revenue", maxIter=10, maxDepth=4), ML_FEATURES)


def huber_sql() -> str:
    filled = f"SELECT p.series_id, date, revenue, COALESCE(lag_7, a, 0) AS x1, COALESCE(mean_30, b, 0) AS x2 FROM phist p JOIN (SELECT series_id, MEDIAN(lag_7) AS a, MEDIAN(mean_30) AS b FROM phist WHERE date <= {CUT} GROUP BY 1) USING (series_id)"
    e = f"{rb.EPSILON}::DOUBLE"
    steps = {"filled": filled, "hrow": f"SELECT 1 AS g, x1, x2, revenue AS y FROM filled WHERE date <= {CUT}", "hub0": f"SELECT *, NULL::DOUBLE AS scale FROM ({wls_sql('SELECT * FROM hrow', 'g', '1::DOUBLE')})"}
    for i in range(rb.STEPS):
        source = f"SELECT h.*, y - (b0 + b1 * x1 + b2 * x2) AS r, COALESCE({e} * scale, 'Infinity'::DOUBLE) AS lim FROM hrow h JOIN (SELECT g, b0, b1, b2, scale FROM hub{i}) USING (g)"
        extra = ", SUM(CASE WHEN ABS(r) <= lim THEN r * r END) AS inner_, COUNT(*) FILTER (ABS(r) > lim) AS outer_, COUNT(*) AS n"
        steps[f"hub{i + 1}"] = f"SELECT *, SQRT(COALESCE(inner_, 0) / GREATEST(n - {e} * {e} * outer_, 1)) AS scale FROM ({wls_sql(source, 'g', 'CASE WHEN ABS(r) <= lim THEN 1 ELSE GREATEST(lim, 1e-12::DOUBLE) / ABS(r) END', extra)})"
    return chained("phist", steps, f"SELECT series_id, date, revenue AS actual, b0 + b1 * x1 + b2 * x2 AS predicted FROM filled, hub{rb.STEPS} WHERE date > {CUT}")


@query("huber_forecast", "series_id:s date:d actual:4 predicted:1", huber_sql())
def huber_forecast(s):
    t = ml_table(s).select("series_id", "date", "revenue", "lag_7", "mean_30").withColumn("_g", F.lit(1))
    model = rb.fit_huber(until_cut(t), ["lag_7", "mean_30"], "revenue", ["_g"])
    return md.score(t.where("date > date'1999-12-31'"), model, ["lag_7", "mean_30"], ["_g"]).select("series_id", "date", F.col("revenue").alias("actual"), "predicted")


SPIKE_FEATURES = ["revenue_lag_7", "revenue_roll_mean_30", "revenue_lag_365", "month", "day_of_week"]


def solve_sql(k: int, source: str) -> str:
    """x0 .. of the symmetric system a{i}_{j} (i <= j), r{i}, by elimination one unknown at a time."""
    out = source
    for p in range(k):
        rows = [f"a{i}_{j} - a{p}_{i} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i in range(p + 1, k) for j in range(i, k)] + [f"r{i} - a{p}_{i} * r{p} / a{p}_{p} AS r{i}" for i in range(p + 1, k)]
        out = f"SELECT * REPLACE ({', '.join(rows)}) FROM ({out})" if rows else out
    for p in range(k - 1, -1, -1):
        out = f"SELECT *, (r{p}{''.join(f' - a{p}_{j} * x{j}' for j in range(p + 1, k))}) / a{p}_{p} AS x{p} FROM ({out})"
    return out


def spike_sql() -> str:
    k, held = len(SPIKE_FEATURES) + 1, 0.01
    history = SPIKE_FEATURES[:3]
    filled = "SELECT date, revenue, " + ", ".join(f"COALESCE({f}, m_{f}, 0)::DOUBLE AS {f}" for f in history) + ", month::DOUBLE AS month, day_of_week::DOUBLE AS day_of_week FROM hist JOIN calendar USING (date), (SELECT " + ", ".join(f"MEDIAN({f}) AS m_{f}" for f in history) + f" FROM hist WHERE date <= {CUT})"
    steps = {
        "filled": filled,
        "labelled": f"SELECT *, CAST(revenue >= (SELECT QUANTILE_CONT(revenue, 0.9) FROM revenue WHERE date <= {CUT}) AS INT) AS top10 FROM filled",
        "places": "SELECT AVG(top10) AS share, COUNT(*) AS n, " + ", ".join(f"AVG({f}) AS m_{i}, CASE WHEN STDDEV_POP({f}) > 1e-9 THEN STDDEV_POP({f}) ELSE 1 END AS s_{i}" for i, f in enumerate(SPIKE_FEATURES, 1)) + f" FROM labelled WHERE date <= {CUT}",
        "zrow": "SELECT date, top10, CASE WHEN top10 = 1 THEN 0.5::DOUBLE / share ELSE 0.5::DOUBLE / (1 - share) END AS w, 1::DOUBLE AS z0, " + ", ".join(f"({f} - m_{i}) / s_{i} AS z{i}" for i, f in enumerate(SPIKE_FEATURES, 1)) + " FROM labelled, places",
        "log0": "SELECT " + ", ".join(f"0::DOUBLE AS b{i}" for i in range(k)),
    }
    for step in range(rb.STEPS):
        p = f"SELECT *, 1 / (1 + EXP(-({' + '.join(f'b{i} * z{i}' for i in range(k))}))) AS p FROM zrow, log{step} WHERE date <= {CUT}"
        a = [f"SUM(w * p * (1 - p) * z{i} * z{j}) / SUM(w){f' + {held}::DOUBLE' if i == j > 0 else ''} AS a{i}_{j}" for i in range(k) for j in range(i, k)]
        r = [f"SUM(w * (p - top10) * z{i}) / SUM(w){f' + {held}::DOUBLE * ANY_VALUE(b{i})' if i else ''} AS r{i}" for i in range(k)]
        source = f"SELECT {', '.join(a + r)}, {', '.join(f'ANY_VALUE(b{i}) AS o{i}' for i in range(k))} FROM ({p})"
        steps[f"log{step + 1}"] = f"SELECT {', '.join(f'o{i} - x{i} AS b{i}' for i in range(k))} FROM ({solve_sql(k, source)})"
    return chained("hist calendar", steps, f"SELECT date, top10, 1 / (1 + EXP(-({' + '.join(f'b{i} * z{i}' for i in range(k))}))) AS prob_top10 FROM zrow, log{rb.STEPS} WHERE date > {CUT}")


@query("spike_probabilities", "date:d top10:i prob_top10:6", spike_sql())
def spike_probabilities(s):
    """Class-balanced probability that a day is in the top decile of the training period."""
    r = ft.revenue_history(s.revenue()).join(calendar(s).select("date", "month", "day_of_week"), "date")
    p90 = until_cut(s.revenue()).agg(F.percentile("revenue", F.lit(0.9))).scalar()
    filled = fx.apply_medians(r, fx.fit_medians(until_cut(r), SPIKE_FEATURES[:3], ["series_id"]), SPIKE_FEATURES[:3], ["series_id"])
    d = s.kept("spike_rows", lambda: filled.withColumn("top10", (F.col("revenue") >= p90).cast("int")))
    share = until_cut(d).agg(F.avg("top10")).scalar()
    model = rb.fit_logistic(until_cut(d), SPIKE_FEATURES, "top10", F.when(F.col("top10") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    return d.where("date > date'1999-12-31'").select("date", "top10", rb.logistic(model).alias("prob_top10"))


@query(
    "model_output_coverage",
    "model:s rows:i first_day:d last_day:d valid:i",
    sql(
        "panel revenue",
        f"""SELECT model, COUNT(*) AS rows, MIN(date) AS first_day, MAX(date) AS last_day, COUNT(*) AS valid FROM (
             SELECT UNNEST(['gbt', 'huber']) AS model, date FROM panel WHERE date > {CUT} UNION ALL SELECT 'spike', date FROM revenue WHERE date > {CUT}) GROUP BY 1""",
    ),
)
def model_output_coverage(s):
    """Every series and day after the cutoff is scored by each fitted model, with a usable value."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    parts = [
        gbt_forecast(s).select(F.lit("gbt").alias("model"), "date", (finite("predicted") & (F.col("predicted") >= 0)).alias("ok")),
        huber_forecast(s).select(F.lit("huber").alias("model"), "date", finite("predicted").alias("ok")),
        spike_probabilities(s).select(F.lit("spike").alias("model"), "date", F.col("prob_top10").between(0, 1).alias("ok")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count_if("ok").alias("valid"))


# -- end to end -------------------------------------------------------------------------------
@query(
    "final_forecast",
    "date:d revenue:3 cogs:3",
    sql(
        "revenue daily",
        f"""SELECT date, GREATEST(0, COALESCE(v, lvl)) AS revenue, GREATEST(0, COALESCE(v, lvl)) * 0.89::DOUBLE AS cogs FROM (
             SELECT t.date, {_wavg([(0.5, 'a.revenue'), (0.3, 'b.revenue'), (0.2, 'c.revenue')])} AS v FROM (SELECT 'total' AS series_id, CAST(UNNEST(generate_series(hi + 1, hi + 548, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT MAX(o_orderdate)::DATE AS hi FROM orders)) t
             {_back(1, 'a', 'revenue', guard=False)} {_back(2, 'b', 'revenue', guard=False)} {_back(3, 'c', 'revenue', guard=False)}), (SELECT AVG(revenue) AS lvl FROM (SELECT revenue FROM revenue ORDER BY date DESC LIMIT 28))""",
    ),
)
def final_forecast(s):
    """548 days after the last order: weighted same dates of three years, else the recent level."""
    from aisleflow.operators.blend import apply_cogs_ratio

    r = s.revenue()
    days = F.sequence(F.date_add("hi", 1), F.date_add("hi", 548), F.expr("interval 1 day"))
    ahead = s.bounds().where("hi is not null").select(F.explode(days).alias("date")).withColumn("series_id", F.lit("total"))
    t = ref.year_references(ahead, r, "revenue", "lag")
    level = win.tail(r, 28).agg(F.avg("revenue")).scalar()
    value = F.coalesce(fx.weighted_avg([(w, f"lag_{k}y") for k, w in ref.YEAR_WEIGHTS]), level)
    return apply_cogs_ratio(t.withColumn("revenue", fx.clip(value, lo=0))).select("date", "revenue", "cogs")
