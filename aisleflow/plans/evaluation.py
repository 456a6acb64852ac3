"""Forecast metrics, backtests, ensembles, gates, scaling grids and risk tables as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from aisleflow.functions import scalars as fx
from aisleflow.operators import blend as bl
from aisleflow.operators import features as ft
from aisleflow.operators import metrics as mt
from aisleflow.operators import references as ref
from aisleflow.operators import windows as win
from aisleflow.plans.calendar_promos import known_calendar
from aisleflow.plans.daily_facts import funnel
from aisleflow.plans.feature_blocks import pred_orders, scored, spike_table, stock_scored
from aisleflow.plans.lookups import _back, _wavg
from aisleflow.plans.registry import kept, query
from aisleflow.plans.series_windows import strict
from aisleflow.plans.sqlbase import cte, sql

MODELS = ["last_year", "recent", "weekday", "level"]
M_SQL = """COUNT(actual - predicted) AS rows, AVG(ABS(actual - predicted)) AS mae, SQRT(AVG((actual - predicted) * (actual - predicted))) AS rmse,
  1 - SUM((actual - predicted) * (actual - predicted)) / NULLIF(VAR_POP(actual) * COUNT(actual), 0) AS r2"""
BASIC_OUT = "mae:2 rmse:2 r2:6"
SPIKE_SQL = """SQRT(AVG((actual - predicted) * (actual - predicted)) FILTER (actual >= p90)) AS top10_rmse, AVG(actual - predicted) FILTER (actual >= p90) AS top10_mean_error,
  COUNT(*) FILTER (actual >= p90 AND actual > predicted) AS top10_under, COUNT(*) FILTER (actual >= p90) AS top10_days,
  SQRT(AVG((actual - predicted) * (actual - predicted)) FILTER (actual >= p95)) AS top5_rmse, COUNT(*) FILTER (actual >= p95 AND actual > predicted) AS top5_under,
  SQRT(AVG((actual - predicted) * (actual - predicted)) FILTER (actual < p90)) AS non_spike_rmse"""
SPIKE_OUT = "top10_rmse:2 top10_mean_error:2 top10_under:i top10_days:i top5_rmse:2 top5_under:i non_spike_rmse:2"

cte("plong", "components", " UNION ALL ".join(f"SELECT series_id, date, actual, '{m}' AS model, {m} AS predicted FROM components" for m in MODELS))
cte("levels2", "components", "SELECT QUANTILE_CONT(actual, 0.9) AS p90, QUANTILE_CONT(actual, 0.95) AS p95 FROM components")


def plong(s):
    return mt.predictions_long(s.components(), MODELS)


def values(rows):
    cells = ["(" + ", ".join(f"'{v}'" if isinstance(v, str) else (f"{v}::DOUBLE" if isinstance(v, float) else str(v)) for v in r.values()) + ")" for r in rows]
    return f"(VALUES {', '.join(cells)}) grid({', '.join(rows[0])})"


# -- metrics --------------------------------------------------------------------
@query("forecast_metrics", "model:s rows:i " + BASIC_OUT, sql("plong", f"SELECT model, {M_SQL} FROM plong GROUP BY model"))
def forecast_metrics(s):
    return mt.regression_metrics(plong(s), ["model"])


@query("spike_error_metrics", "model:s " + BASIC_OUT + " " + SPIKE_OUT, sql("plong levels2", f"SELECT model, {M_SQL}, {SPIKE_SQL} FROM plong, levels2 GROUP BY model"))
def spike_error_metrics(s):
    return mt.spike_metrics(mt.with_spike_levels(plong(s), ["series_id"]), ["model"])


SLICES = {"promo": "active_promo_count > 3", "non_promo": "active_promo_count <= 3", "low_stock": "low_stock = 1", "high_stock": "high_stock = 1", "promo_low_stock": "active_promo_count > 3 AND low_stock = 1", "high_risk": "is_high_risk_month = 1", "busy": "orders_count >= 9", "big_orders": "aov >= 180000"}


@query(
    "sliced_error_metrics",
    "series_id:s " + BASIC_OUT + " " + " ".join(f"{n}_rmse:2 {n}_days:i" for n in SLICES),
    sql(
        "stock_ctx funnel",
        f"SELECT series_id, {M_SQL}, " + ", ".join(f"SQRT(AVG((actual - predicted) * (actual - predicted)) FILTER ({c})) AS {n}_rmse, COUNT(*) FILTER ({c}) AS {n}_days" for n, c in SLICES.items())
        + " FROM (SELECT s.*, s.base_pred AS predicted, f.orders_count, f.aov FROM stock_ctx s JOIN (SELECT date, orders_count, aov FROM funnel) f USING (date)) GROUP BY 1",
    ),
)
def sliced_error_metrics(s):
    f = funnel(s)  # first, so that the forecasts read its revenue and the lines are not read again for it
    d = stock_scored(s).withColumn("predicted", F.col("base_pred")).join(f.select("date", "orders_count", "aov"), "date")
    return mt.slice_metrics(d, ["series_id"], {n: F.expr(c) for n, c in SLICES.items()})


cte(
    "drivers",
    "pred_orders funnel",
    f"SELECT p.date, p.predicted_orders, f.orders_count AS orders, f.aov, f.predicted_aov FROM pred_orders p JOIN (SELECT date, orders_count, aov, {strict('aov', 30)} AS predicted_aov FROM funnel) f USING (date) WHERE predicted_orders IS NOT NULL AND predicted_aov IS NOT NULL",
)


@kept
def drivers(s):
    """Orders and order value with their stand-in forecasts."""
    f = funnel(s).select("date", F.col("orders_count").alias("orders"), "aov", win.roll_mean("aov", 30).alias("predicted_aov"))
    return pred_orders(s).join(f, "date").where("predicted_orders is not null and predicted_aov is not null")


@query(
    "error_decomposition",
    "date:d orders_part:3 value_part:3",
    sql("drivers", "SELECT date, (predicted_orders - orders) * aov AS orders_part, predicted_orders * (predicted_aov - aov) AS value_part FROM drivers"),
)
def error_decomposition(s):
    return mt.error_decomposition(drivers(s))


@query(
    "monthly_rmse",
    "model:s year_month:s rows:i " + BASIC_OUT,
    sql("plong", f"SELECT model, STRFTIME(date, '%Y-%m') AS year_month, {M_SQL} FROM plong GROUP BY ALL"),
)
def monthly_rmse(s):
    return mt.regression_metrics(plong(s).withColumn("year_month", F.date_format("date", "yyyy-MM")), ["model", "year_month"])


@query(
    "best_model_per_month",
    "year_month:s model:s rmse:2",
    sql("plong", f"SELECT year_month, model, rmse FROM (SELECT model, STRFTIME(date, '%Y-%m') AS year_month, {M_SQL} FROM plong GROUP BY ALL) QUALIFY ROW_NUMBER() OVER (PARTITION BY year_month ORDER BY rmse, mae, model) = 1"),
)
def best_model_per_month(s):
    m = mt.regression_metrics(plong(s).withColumn("year_month", F.date_format("date", "yyyy-MM")), ["model", "year_month"])
    return win.best_row(m, ["year_month"], [F.col("rmse"), F.col("mae"), F.col("model")])


@query(
    "error_groups",
    "model:s weekday:s promo_band:s days:i mae:2 rmse:2 mean_actual:3 mean_predicted:3 bias:3 under:i over:i",
    sql(
        "plong pcal",
        f"""SELECT model, DAYNAME(date) AS weekday, CASE WHEN active_promo_count > 4 THEN 'many' WHEN active_promo_count > 2 THEN 'some' END AS promo_band, COUNT(*) AS days, {M_SQL}, AVG(actual) AS mean_actual,
             AVG(predicted) AS mean_predicted, AVG(actual - predicted) AS bias, COUNT(*) FILTER (actual > predicted) AS under, COUNT(*) FILTER (actual < predicted) AS over FROM plong JOIN pcal USING (date) GROUP BY ALL""",
    ),
)
def error_groups(s):
    """Grouped errors; the group without a promotion band (NULL) is kept."""
    band = F.when(F.col("active_promo_count") > 4, "many").when(F.col("active_promo_count") > 2, "some")
    d = plong(s).join(known_calendar(s).select("date", "active_promo_count"), "date")
    return mt.metrics_by(d.select("*", F.date_format("date", "EEEE").alias("weekday"), band.alias("promo_band")), ["model", "weekday", "promo_band"])


@query(
    "error_table",
    "model:s date:d error:2 abs_error:2 pct_error:6 direction:s",
    sql("plong", """SELECT model, date, actual - predicted AS error, ABS(actual - predicted) AS abs_error, (actual - predicted) / NULLIF(actual, 0) AS pct_error,
                      CASE WHEN ABS(actual - predicted) < 1e-9 THEN 'exact' WHEN actual > predicted THEN 'underprediction' ELSE 'overprediction' END AS direction FROM plong"""),
)
def error_table(s):
    return mt.error_columns(plong(s))


@query(
    "spike_classifier_metrics",
    "series_id:s tp:i fp:i fn:i tn:i precision:6 recall:6 f1:6 auc:8",
    sql(
        "scored levels2",
        """SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1 FROM (
             SELECT series_id, tp, fp, fn, tn, COALESCE(tp::DOUBLE / NULLIF(tp + fp, 0), 0) AS precision, COALESCE(tp::DOUBLE / NULLIF(tp + fn, 0), 0) AS recall, (rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn) AS auc
             FROM (SELECT series_id, COUNT(*) FILTER (h AND y = 1) AS tp, COUNT(*) FILTER (h AND y = 0) AS fp, COUNT(*) FILTER (NOT h AND y = 1) AS fn, COUNT(*) FILTER (NOT h AND y = 0) AS tn,
               SUM(r) FILTER (y = 1) AS rs, COUNT(*) FILTER (y = 1) AS np, COUNT(*) FILTER (y = 0) AS nn
               FROM (SELECT series_id, spike_prob >= 0.5 AS h, CAST(actual >= p90 AS INT) AS y, RANK() OVER (ORDER BY spike_prob) + (COUNT(*) OVER (PARTITION BY spike_prob) - 1) / 2.0::DOUBLE AS r FROM scored, levels2) GROUP BY 1))""",
    ),
)
def spike_classifier_metrics(s):
    d = mt.with_spike_levels(scored(s), ["series_id"]).withColumn("y", (F.col("actual") >= F.col("p90")).cast("int"))
    return mt.binary_metrics(d, "spike_prob", "y", ["series_id"])


@query(
    "return_flag_auc",
    "line_status:s auc:8",
    sql(
        "",
        """SELECT line_status, (SUM(r) FILTER (y = 1) - np * (np + 1) / 2.0::DOUBLE) / (np * nn) AS auc FROM (
             SELECT *, COUNT(*) FILTER (y = 1) OVER (PARTITION BY line_status)::DOUBLE AS np, COUNT(*) FILTER (y = 0) OVER (PARTITION BY line_status)::DOUBLE AS nn FROM (
               SELECT l_linestatus AS line_status, CAST(l_returnflag = 'R' AS INT) AS y, RANK() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice)
                 + (COUNT(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0::DOUBLE AS r FROM lineitem)) GROUP BY line_status, np, nn""",
    ),
)
def return_flag_auc(s):
    """AUC of line price as a predictor of returns over every line: ranks without a global sort."""
    li = s.table("lineitem").select(F.col("l_linestatus").alias("line_status"), "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return mt.auc(li, "l_extendedprice", "y", ["line_status"])


# -- backtests --------------------------------------------------------------------
SCOPES = [("year_2000", "1999-12-31", "2000-01-01", "2000-12-31"), ("fold_a", "1998-06-30", "1998-07-01", "1999-12-31"), ("fold_b", "1998-12-31", "1999-01-01", "2000-06-30"), ("fold_c", "1999-06-30", "1999-07-01", "2000-12-31")]
FOLDS = ["fold_a", "fold_b", "fold_c"]
cte(
    "scoped",
    "revenue",
    f"""SELECT t.*, a.revenue AS lag_1y, b.revenue AS lag_2y, c.revenue AS lag_3y FROM (SELECT r.series_id, r.date, r.revenue AS actual, scope, CAST(te AS DATE) AS reference_end FROM revenue r
          JOIN (VALUES {', '.join(f"('{n}', '{a}', '{b}', '{e}')" for n, a, b, e in SCOPES)}) v(scope, te, vs, ve) ON r.date BETWEEN CAST(vs AS DATE) AND CAST(ve AS DATE)) t
          {_back(1, 'a', 'revenue')} {_back(2, 'b', 'revenue')} {_back(3, 'c', 'revenue')}""",
)
cte(
    "backtest",
    "scoped",
    f"""SELECT scope, date, actual, 'naive' AS model, COALESCE(lag_1y, lag_2y) AS predicted FROM scoped
        UNION ALL SELECT scope, date, actual, 'weighted', {_wavg([(0.5, 'lag_1y'), (0.3, 'lag_2y'), (0.2, 'lag_3y')])} FROM scoped""",
)


def backtest(s):
    """Two seasonal forecasts in four scopes; each scope only reads data up to its train_end."""
    r = s.revenue()
    t = mt.in_scopes(r.withColumnRenamed("revenue", "actual"), SCOPES)
    t = ref.year_references(t, r, "revenue", "lag", guarded=True)
    w = F.coalesce
    models = [
        F.struct(F.lit("naive").alias("model"), w("lag_1y", "lag_2y").alias("predicted")),
        F.struct(F.lit("weighted").alias("model"), ref.weighted_avg([(x, f"lag_{k}y") for k, x in ref.YEAR_WEIGHTS]).alias("predicted")),
    ]
    return t.select("series_id", "scope", "date", "actual", F.inline(F.array(*models)))


@query("scoped_backtest", "scope:s model:s rows:i " + BASIC_OUT, sql("backtest", f"SELECT scope, model, {M_SQL} FROM backtest GROUP BY ALL"))
def scoped_backtest(s):
    return mt.regression_metrics(backtest(s), ["scope", "model"])


@query(
    "model_selection_score",
    "model:s main_rmse:2 long_rmse:2 score:2",
    sql("backtest", f"""SELECT model, m AS main_rmse, l AS long_rmse, 0.6::DOUBLE * m + 0.4::DOUBLE * l AS score FROM (SELECT model, MAX(rmse) FILTER (scope = 'year_2000') AS m, AVG(rmse) FILTER (scope LIKE 'fold%') AS l
                          FROM (SELECT scope, model, {M_SQL} FROM backtest GROUP BY ALL) GROUP BY model)"""),
)
def model_selection_score(s):
    return mt.selection_score(mt.regression_metrics(backtest(s), ["scope", "model"]), "year_2000", FOLDS)


@query(
    "challenger_decision",
    "scope:s mae_change:2 rmse_change:2 r2_change:6 replace:b",
    sql(
        "backtest",
        """SELECT a.scope, b.mae - a.mae AS mae_change, b.rmse - a.rmse AS rmse_change, b.r2 - a.r2 AS r2_change, (a.mae - b.mae) / a.mae >= 0.005 AND b.rmse <= a.rmse AND b.r2 >= a.r2 AS replace
           FROM m a JOIN m b ON a.scope = b.scope AND a.model = 'naive' AND b.model = 'weighted'""",
        m=f"SELECT scope, model, {M_SQL} FROM backtest GROUP BY ALL",
    ),
)
def challenger_decision(s):
    m = mt.regression_metrics(backtest(s), ["scope", "model"])
    return mt.challenger(m.where("model = 'naive'"), m.where("model = 'weighted'"), ["scope"])


@query(
    "train_validation_split",
    "part:s rows:i features:i first_date:d last_date:d",
    sql("revenue", """SELECT part, COUNT(*) AS rows, 17 AS features, MIN(date) AS first_date, MAX(date) AS last_date FROM (
                        SELECT date, CASE WHEN date < DATE '2000-01-01' THEN 'train' ELSE 'validation' END AS part FROM revenue WHERE date <= DATE '2000-12-31') GROUP BY part"""),
)
def train_validation_split(s):
    t = ft.revenue_history(s.revenue())
    names = mt.numeric_features(t, ["series_id", "date", "revenue"])
    train, valid = mt.time_split(t, "2000-01-01", "2000-12-31")

    def count(df, name):
        return df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.lit(len(names)).alias("features"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))

    return count(train, "train").unionByName(count(valid, "validation"))


@query("predictions_wide", "date:d actual:4 last_year:2 weekday:2", sql("components", "SELECT date, actual, last_year, weekday FROM components"))
def predictions_wide(s):
    return mt.predictions_wide(plong(s).where("model in ('last_year', 'weekday')"), ["last_year", "weekday"])


def weight_rows(s, weights):
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("weight")) for m, w in weights.items()])
    return s.spark.range(1).select(F.inline(cells))


@query(
    "champion_rebuild",
    "series_id:s rows:i " + BASIC_OUT + " max_actual_gap:4",
    sql("components revenue", f"""SELECT series_id, {M_SQL}, MAX(ABS(actual - revenue)) AS max_actual_gap FROM (SELECT c.series_id, c.actual, r.revenue,
                                 GREATEST(0, 0.425::DOUBLE * last_year + 0.425::DOUBLE * weekday + 0.15::DOUBLE * level) AS predicted FROM components c JOIN revenue r USING (date)) GROUP BY 1"""),
)
def champion_rebuild(s):
    """A past champion rebuilt from its components; the stored actuals must equal the sales."""
    b = bl.blend(plong(s), weight_rows(s, {"last_year": 0.425, "weekday": 0.425, "level": 0.15})).select("date", F.col("revenue").alias("predicted"))
    d = s.components().select("series_id", "date", "actual").join(b, "date").join(s.revenue().select("date", "revenue"), "date")
    return d.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), *mt.basic(), F.max(F.abs(F.col("actual") - F.col("revenue"))).alias("max_actual_gap"))


VARIANTS = [{"variant": f"blend_{round(w * 100)}", "w_a": w, "w_b": round(1 - w, 2)} for w in (0.0, 0.25, 0.5, 0.75, 1.0)]


@query(
    "variant_comparison",
    "variant:s rows:i " + BASIC_OUT + " position:i",
    sql("components", f"SELECT *, ROW_NUMBER() OVER (ORDER BY rmse, variant) AS position FROM (SELECT variant, {M_SQL} FROM (SELECT variant, actual, w_a * recent + w_b * level AS predicted FROM components, {values(VARIANTS)}) GROUP BY variant)"),
)
def variant_comparison(s):
    from pyspark.sql import Window

    g = bl.with_grid(s.components(), VARIANTS).withColumn("predicted", F.col("w_a") * F.col("recent") + F.col("w_b") * F.col("level"))
    m = mt.regression_metrics(g, ["variant"])
    return m.withColumn("position", F.row_number().over(Window.orderBy("rmse", "variant")))


# -- ensembles ----------------------------------------------------------------------
SIMPLEX = "FROM range(0, 21) a(i), range(0, 21) b(j), range(0, 21) c(k) WHERE i + j + k <= 20"
cte("simplex4", "", f"SELECT i / 20.0::DOUBLE AS w1, j / 20.0::DOUBLE AS w2, k / 20.0::DOUBLE AS w3, (20 - i - j - k) / 20.0::DOUBLE AS w4 {SIMPLEX}")
W_SQL = "w1 * last_year + w2 * recent + w3 * weekday + w4 * level"
WS = "w1:2 w2:2 w3:2 w4:2"


@query(
    "ensemble_weight_grid",
    WS + " rmse:2",
    sql("components simplex4", f"SELECT w1, w2, w3, w4, SQRT(AVG((actual - ({W_SQL})) * (actual - ({W_SQL})))) AS rmse FROM components, simplex4 GROUP BY ALL"),
)
def ensemble_weight_grid(s):
    return bl.grid_search(s.components(), MODELS, ["series_id"])


@query(
    "ensemble_best_weights",
    WS + " rmse:2 weights_json:s",
    sql(
        "components simplex4",
        f"""SELECT *, '{{"last_year":' || CAST(w1 AS VARCHAR) || ',"level":' || CAST(w4 AS VARCHAR) || ',"recent":' || CAST(w2 AS VARCHAR) || ',"weekday":' || CAST(w3 AS VARCHAR) || '}}' AS weights_json FROM (
             SELECT w1, w2, w3, w4, SQRT(AVG((actual - ({W_SQL})) * (actual - ({W_SQL})))) AS rmse FROM components, simplex4 GROUP BY ALL ORDER BY ROUND(rmse, 6), w1 DESC, w2 DESC, w3 DESC, w4 DESC LIMIT 1)""",
    ),
)
def ensemble_best_weights(s):
    b = bl.best_weights(bl.grid_search(s.components(), MODELS, ["series_id"]), ["series_id"], 4)
    pairs = F.array(*[F.struct(F.lit(m).alias("name"), F.col(f"w{i}").alias("weight")) for i, m in enumerate(MODELS, 1)])
    return b.withColumn("weights_json", fx.weights_json_column(pairs))


@query(
    "ensemble_constrained_search",
    "w1:2 w2:2 w3:2 rmse:2 mae:2 top10_rmse:2 top10_under:i accepted:i",
    sql(
        "components levels2",
        f"""SELECT w1, w2, w3, {M_SQL}, {SPIKE_SQL}, CAST(top10_rmse <= (SELECT SQRT(AVG((actual - last_year) * (actual - last_year)) FILTER (actual >= p90)) FROM components, levels2) AS INT) AS accepted
           FROM (SELECT w1, w2, w3, actual, p90, p95, w1 * last_year + w2 * weekday + w3 * level AS predicted FROM components, levels2,
             (SELECT i / 20.0::DOUBLE AS w1, j / 20.0::DOUBLE AS w2, (20 - i - j) / 20.0::DOUBLE AS w3 FROM range(6, 19) a(i), range(0, 21) b(j) WHERE i + j <= 20 AND 20 - i - j <= 4)) GROUP BY w1, w2, w3""",
    ),
)
def ensemble_constrained_search(s):
    """Anchor weight 0.30..0.90, last component at most 0.20, spike error not above the anchor's."""
    c = mt.with_spike_levels(s.components(), ["series_id"])
    anchor = mt.spike_metrics(c.withColumn("predicted", F.col("last_year")), ["series_id"]).select("top10_rmse").scalar()
    return bl.constrained_search(c, ["last_year", "weekday", "level"], ["series_id"], 20, 0.30, 0.20, anchor).where("w1 <= 0.9 + 1e-9")


@query(
    "fixed_weight_blend",
    "date:d revenue:4 cogs:4",
    sql("components", "SELECT date, GREATEST(0, 0.95::DOUBLE * last_year + 0.05::DOUBLE * weekday) AS revenue, GREATEST(0, 0.95::DOUBLE * last_year + 0.05::DOUBLE * weekday) * 0.89::DOUBLE AS cogs FROM components"),
)
def fixed_weight_blend(s):
    return bl.blend(plong(s), weight_rows(s, {"last_year": 0.95, "weekday": 0.05}))


@query(
    "renormalized_blend",
    "date:d revenue:4 cogs:4",
    sql("components", "SELECT date, GREATEST(0, 0.5::DOUBLE / 0.8::DOUBLE * last_year + 0.3::DOUBLE / 0.8::DOUBLE * level) AS revenue, GREATEST(0, 0.5::DOUBLE / 0.8::DOUBLE * last_year * 0.8::DOUBLE + 0.3::DOUBLE / 0.8::DOUBLE * level * 0.9::DOUBLE) AS cogs FROM components"),
)
def renormalized_blend(s):
    """One listed component has no forecast: its weight goes to the others; COGS is blended."""
    long = plong(s).where("model in ('last_year', 'level')")
    factor = F.when(F.col("model") == "last_year", 0.8).otherwise(0.9)
    w = bl.renormalize(weight_rows(s, {"last_year": 0.5, "level": 0.3, "missing_model": 0.2}), long)
    return bl.blend(long.withColumn("cogs", F.col("predicted") * factor), w, ratio=None)


# -- gates and scaling -------------------------------------------------------------------
GATES = [{"mode": m, "threshold": t, "uplift": u} for m in ("hard", "soft") for t in (0.40, 0.50, 0.60, 0.70) for u in (0.03, 0.05, 0.07, 0.10, 0.12, 0.15)]
cte("slevels", "scored levels2", "SELECT * FROM scored, levels2")
cte(
    "gates",
    "slevels",
    f"""SELECT mode, threshold, uplift, AVG(g) AS avg_gate, {M_SQL}, {SPIKE_SQL} FROM (SELECT *, base_pred * (1 + uplift * g) AS predicted FROM (
          SELECT *, CASE WHEN spike_prob >= threshold THEN CASE WHEN mode = 'hard' THEN 1.0::DOUBLE ELSE spike_prob END ELSE 0.0::DOUBLE END AS g FROM slevels, {values(GATES)})) GROUP BY ALL""",
)
cte("base_m", "slevels", f"SELECT {M_SQL}, {SPIKE_SQL} FROM (SELECT *, base_pred AS predicted FROM slevels)")
GATE_OUT = "mode:s threshold:2 uplift:2 avg_gate:6 mae:2 rmse:2 r2:6 top10_rmse:2 top10_under:i non_spike_rmse:2 accepted:i"


@kept
def gate_results(s):
    d = mt.with_spike_levels(scored(s), ["series_id"])
    g = bl.with_grid(d, GATES).withColumn("g", bl.gate(F.col("spike_prob"), F.col("mode"), F.col("threshold")))
    g = g.withColumn("predicted", F.col("base_pred") * (1 + F.col("uplift") * F.col("g")))
    m = g.groupBy("mode", "threshold", "uplift").agg(F.avg("g").alias("avg_gate"), *mt.basic(), *mt.spike_columns())
    base = base_metrics(d)
    return bl.accept(m, base, {"rmse": 1.0, "top10_rmse": 1.0})


def base_metrics(d):
    """Metrics of the base forecast as one scalar struct."""
    m = mt.spike_metrics(d.withColumn("predicted", F.col("base_pred")), ["series_id"]).select(F.struct("mae", "rmse", "r2", "top10_rmse", "non_spike_rmse")).scalar()
    return {n: m[n] for n in ("mae", "rmse", "r2", "top10_rmse", "non_spike_rmse")}


@query("probability_gate_search", GATE_OUT, sql("gates base_m", "SELECT g.*, CAST(g.rmse <= b.rmse AND g.top10_rmse <= b.top10_rmse AS INT) AS accepted FROM gates g, base_m b"))
def probability_gate_search(s):
    return gate_results(s)


@query(
    "gate_neighbours",
    "mode:s threshold:2 uplift:2 uplift_below:2 rmse_below:2 uplift_above:2 rmse_above:2",
    sql("gates", "SELECT mode, threshold, uplift, LAG(uplift) OVER w AS uplift_below, LAG(rmse) OVER w AS rmse_below, LEAD(uplift) OVER w AS uplift_above, LEAD(rmse) OVER w AS rmse_above FROM gates WINDOW w AS (PARTITION BY mode, threshold ORDER BY uplift)"),
)
def gate_neighbours(s):
    return win.neighbors(gate_results(s), ["mode", "threshold"], "uplift", "rmse")


def space_sql(space):
    """The configurations of :func:`blend.grid_of` as a relation, by cross joins of the lists."""
    parts, first, names = [], 0, bl.parameter_names(space)
    for strategy, lists in space.items():
        tables = ", ".join(f"(SELECT UNNEST({list(v)}::DOUBLE[]) AS {n}, UNNEST(RANGE({len(v)})) AS i_{n})" for n, v in lists.items())
        place = "0"
        for n, v in lists.items():
            place = f"({place}) * {len(v)} + i_{n}"
        parts.append(f"SELECT {first} + {place} AS config_id, '{strategy}' AS strategy, {', '.join(n if n in lists else f'0::DOUBLE AS {n}' for n in names)} FROM {tables}")
        count = 1
        for v in lists.values():
            count *= len(v)
        first += count
    return "(" + " UNION ALL ".join(parts) + ") grid"


CONFIGS, CONFIGS_SQL = bl.SCALE_SPACE, space_sql(bl.SCALE_SPACE)
# Stand-ins for the stored probabilities: ranks of two look-backs, as they are and halved on days with neither
# a promotion nor a high-risk month.
PROB_SOURCES = ["prob_top10", "prob_top15", "eff_prob_top10", "eff_prob_top15"]
cte(
    "sctx",
    "slevels",
    """SELECT *, prob_top10 * weight AS eff_prob_top10, prob_top15 * weight AS eff_prob_top15 FROM (
         SELECT *, spike_prob AS prob_top10, (RANK() OVER (ORDER BY weekday) + (COUNT(*) OVER (PARTITION BY weekday) - 1) / 2.0::DOUBLE) / COUNT(*) OVER () AS prob_top15,
           CASE WHEN any_promo = 1 OR is_high_risk_month = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight, LEAST(1.5, avg_discount_value * active_promo_count / 100) AS normalized_promo_intensity FROM slevels)""",
)
cte("ssrc", "sctx", " UNION ALL ".join(f"SELECT *, '{n}' AS prob_source, {n} AS effective_prob FROM sctx" for n in PROB_SOURCES))
SCALE_SQL = """GREATEST(1.0::DOUBLE, CASE strategy WHEN 'soft_linear' THEN 1 + alpha * effective_prob WHEN 'soft_quadratic' THEN 1 + alpha * effective_prob * effective_prob
  WHEN 'threshold' THEN CASE WHEN effective_prob >= 0.7 THEN 1 + high_uplift WHEN effective_prob >= 0.5 THEN 1 + mid_uplift WHEN effective_prob >= 0.35 THEN 1 + low_uplift ELSE 1.0::DOUBLE END
  WHEN 'context' THEN 1 + alpha * effective_prob + beta * any_promo + gamma * normalized_promo_intensity + delta * is_high_risk_month
  ELSE 1 + uplift * CASE WHEN effective_prob >= threshold AND (any_promo = 1 OR is_high_risk_month = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)"""
cte(
    "scales",
    "ssrc",
    f"""SELECT prob_source, config_id, strategy, AVG(sc) AS mean_scale, MIN(sc) AS min_scale, MAX(sc) AS max_scale, {M_SQL}, {SPIKE_SQL}
        FROM (SELECT *, base_pred * sc AS predicted FROM (SELECT *, {SCALE_SQL} AS sc FROM ssrc, {CONFIGS_SQL})) GROUP BY ALL""",
)
cte(
    "scales_ok",
    "scales base_m",
    """SELECT s.*, CAST(ROUND(s.rmse, 6) < ROUND(b.rmse, 6) AS INT) AS improves_rmse, CAST(ROUND(s.top10_rmse, 6) < ROUND(b.top10_rmse, 6) AS INT) AS improves_top10,
         CAST(s.non_spike_rmse <= b.non_spike_rmse * 1.01 AND s.rmse <= b.rmse * 1.01 AS INT) AS accepted FROM scales s, base_m b""",
)
SCALE_OUT = "prob_source:s config_id:i strategy:s mean_scale:6 min_scale:6 max_scale:6 mae:2 rmse:2 r2:6 top10_rmse:2 top10_under:i non_spike_rmse:2 improves_rmse:i improves_top10:i accepted:i"


@kept
def scaling_inputs(s):
    """Scored days with every probability source and the promotion intensity in units of 100."""
    d = mt.with_spike_levels(scored(s), ["series_id"])
    d = d.select("*", F.col("spike_prob").alias("prob_top10"), win.rank_pct("weekday").alias("prob_top15"), F.least(F.lit(1.5), F.col("avg_discount_value") * F.col("active_promo_count") / 100).alias("normalized_promo_intensity"))
    weight = F.when((F.col("any_promo") == 1) | (F.col("is_high_risk_month") == 1), 1.0).otherwise(0.5)
    return d.select("*", *[(F.col(n) * weight).alias(f"eff_{n}") for n in PROB_SOURCES[:2]])


@kept
def scale_results(s):
    d = scaling_inputs(s)
    g = bl.with_grid(bl.with_sources(d, PROB_SOURCES), bl.grid_of(CONFIGS)).withColumn("sc", bl.scale_expr())
    g = g.withColumn("predicted", F.col("base_pred") * F.col("sc"))
    m = g.groupBy("prob_source", "config_id", "strategy").agg(F.avg("sc").alias("mean_scale"), F.min("sc").alias("min_scale"), F.max("sc").alias("max_scale"), *mt.basic(), *mt.spike_columns())
    base = base_metrics(d)
    m = m.select("*", *[(F.round(n, 6) < F.round(base[n], 6)).cast("int").alias(f"improves_{o}") for n, o in (("rmse", "rmse"), ("top10_rmse", "top10"))])
    return bl.accept(m, base, {"non_spike_rmse": 1.01, "rmse": 1.01})


@query("scaling_grid_search", SCALE_OUT, sql("scales_ok", "SELECT * FROM scales_ok"))
def scaling_grid_search(s):
    return scale_results(s)


LAST = "prob_source, config_id"  # ties
PICKS = {
    "best": f"ROUND(rmse, 6), ROUND(top10_rmse, 6), top10_under, ROUND(mae, 6), {LAST}",
    "conservative": f"ROUND(ABS(mean_scale - 1), 9), ROUND(rmse, 6), ROUND(top10_rmse, 6), ROUND(mae, 6), {LAST}",
    "aggressive": f"ROUND(top10_rmse, 6), top10_under, ROUND(rmse, 6), ROUND(mae, 6), {LAST}",
}


def pick_order(choice):
    """Ranking keys of a choice; metrics are compared to six places, so that ties are ties in every engine."""
    rmse, top10, mae, ties = F.round("rmse", 6), F.round("top10_rmse", 6), F.round("mae", 6), [F.col("prob_source"), F.col("config_id")]
    keys = {
        "best": [rmse, top10, F.col("top10_under"), mae],
        "conservative": [F.round(F.abs(F.col("mean_scale") - 1), 9), rmse, top10, mae],
        "aggressive": [top10, F.col("top10_under"), rmse, mae],
    }
    return [*keys[choice], *ties]


def picked(s, choice):
    return bl.pick(scale_results(s).withColumn("_one", F.lit(1)), ["_one"], pick_order(choice))


@query(
    "scaling_config_picks",
    "choice:s " + SCALE_OUT,
    sql("scales_ok", " UNION ALL ".join(f"(SELECT '{n}' AS choice, * FROM scales_ok ORDER BY accepted DESC, {o} LIMIT 1)" for n, o in PICKS.items())),
)
def scaling_config_picks(s):
    return reduce(lambda a, b: a.unionByName(b), [picked(s, n).withColumn("choice", F.lit(n)) for n in PICKS])


@query(
    "scaling_neighbours",
    "choice:s prob_source:s config_id:i strategy:s mean_scale:6 rmse:2 top10_rmse:2 mae:2",
    sql(
        "scales_ok",
        "SELECT choice, p.* EXCLUDE (i) FROM placed p, (SELECT MIN(i) AS i FROM placed, best b WHERE ABS(placed.mean_scale - b.mean_scale) <= 1e-8 + 1e-5 * ABS(b.mean_scale) AND ABS(placed.rmse - b.rmse) <= 1e-8 + 1e-5 * ABS(b.rmse)) m, "
        "(SELECT COUNT(*) AS n FROM placed) c, (VALUES ('lower', -1), ('best', 0), ('higher', 1)) v(choice, step) WHERE p.i = GREATEST(1, LEAST(c.n, m.i + step))",
        best=f"SELECT * FROM scales_ok ORDER BY accepted DESC, {PICKS['best']} LIMIT 1",
        family="SELECT s.* FROM scales_ok s JOIN best b ON s.strategy = b.strategy AND s.prob_source = b.prob_source",
        placed="SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(mean_scale, 9), ROUND(rmse, 6), ROUND(top10_rmse, 6), config_id) AS i FROM family",
    ),
)
def scaling_neighbours(s):
    """The winner and the next milder and stronger configurations of its strategy and source."""
    order = [F.round("mean_scale", 9), F.round("rmse", 6), F.round("top10_rmse", 6), F.col("config_id")]
    return bl.family_neighbours(scale_results(s), picked(s, "best"), ["strategy", "prob_source"], order, ["mean_scale", "rmse"])


@query(
    "scaled_forecast",
    "date:d prob_source:s config_id:i scale:6 revenue:3 cogs:3",
    sql(
        "scales_ok ssrc",
        f"SELECT date, prob_source, config_id, {SCALE_SQL} AS scale, GREATEST(0, base_pred * {SCALE_SQL}) AS revenue, GREATEST(0, base_pred * 0.89::DOUBLE * {SCALE_SQL}) AS cogs FROM ssrc, {CONFIGS_SQL} WHERE (prob_source, config_id) = (SELECT (prob_source, config_id) FROM scales_ok ORDER BY accepted DESC, {PICKS['best']} LIMIT 1)",
    ),
)
def scaled_forecast(s):
    """The chosen configuration applied to the forecast; revenue and COGS scale together."""
    best = picked(s, "best").select(F.struct("prob_source", "config_id")).scalar()
    d = scaling_inputs(s).withColumn("_best", best)
    one = bl.with_sources(d, PROB_SOURCES).where(F.col("prob_source") == F.col("_best.prob_source"))
    chosen = F.filter(bl.grid_of(CONFIGS), lambda c: c["config_id"] == F.col("_best.config_id"))
    g = bl.with_grid(one, chosen).withColumn("scale", bl.scale_expr())
    return g.select("date", "prob_source", "config_id", "scale", fx.clip(F.col("base_pred") * F.col("scale"), lo=0).alias("revenue"), fx.clip(F.col("base_pred") * 0.89 * F.col("scale"), lo=0).alias("cogs"))


META_CLIPS = [{"clip_name": n, "clip_lo": a, "clip_hi": b} for n, a, b in (("tight", 0.97, 1.12), ("medium", 0.95, 1.15), ("wide", 0.93, 1.18), ("conservative", 0.98, 1.10))]


@query(
    "meta_scale_clips",
    "clip_name:s mean_scale:6 rows:i " + BASIC_OUT,
    sql("scored", f"SELECT clip_name, AVG(sc) AS mean_scale, {M_SQL} FROM (SELECT *, base_pred * sc AS predicted FROM (SELECT *, GREATEST(clip_lo, LEAST(clip_hi, GREATEST(0.75, LEAST(1.35, actual / NULLIF(base_pred, 0))))) AS sc FROM scored, {values(META_CLIPS)})) GROUP BY 1"),
)
def meta_scale_clips(s):
    """Upper bound of the meta scale: the clipped target itself under each clip range."""
    g = bl.with_grid(scored(s).withColumn("target", bl.scale_target()), META_CLIPS)
    g = g.withColumn("sc", F.greatest("clip_lo", F.least("clip_hi", "target"))).withColumn("predicted", F.col("base_pred") * F.col("sc"))
    return g.groupBy("clip_name").agg(F.avg("sc").alias("mean_scale"), F.count(F.lit(1)).alias("rows"), *mt.basic())


STOCK_GRID = [{"alpha": a, "beta": b, "clip_lo": lo, "clip_hi": hi} for a in (0.01, 0.02, 0.03, 0.05, 0.08) for b in (0.0, 0.01, 0.02, 0.03) for lo, hi in ((0.95, 1.08), (0.93, 1.12), (0.90, 1.15))]
STOCK_SQL = "GREATEST(clip_lo, LEAST(clip_hi, 1 - alpha * low_stock * stock_pressure * 20 + beta * CASE WHEN high_stock > 0 AND any_promo > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))"


@query(
    "stock_scale_search",
    "alpha:2 beta:2 clip_lo:2 clip_hi:2 mean_scale:6 mae:2 rmse:2 r2:6 low_stock_rmse:2 non_promo_rmse:2 accepted:i",
    sql(
        "stock_ctx",
        f"""SELECT g.*, CAST(g.rmse <= b.rmse * 1.01 AND COALESCE(g.non_promo_rmse <= b.non_promo_rmse * 1.03, TRUE) AND COALESCE(g.low_stock_rmse <= b.low_stock_rmse * 1.05, TRUE) AS INT) AS accepted
           FROM (SELECT alpha, beta, clip_lo, clip_hi, AVG(sc) AS mean_scale, {M_SQL}, {{sl}} FROM (SELECT *, base_pred * sc AS predicted FROM (SELECT *, {STOCK_SQL} AS sc FROM stock_ctx, {values(STOCK_GRID)})) GROUP BY alpha, beta, clip_lo, clip_hi) g,
             (SELECT {M_SQL}, {{sl}} FROM (SELECT *, base_pred AS predicted FROM stock_ctx)) b""".replace(
            "{sl}", "SQRT(AVG((actual - predicted) * (actual - predicted)) FILTER (low_stock = 1)) AS low_stock_rmse, SQRT(AVG((actual - predicted) * (actual - predicted)) FILTER (any_promo = 0)) AS non_promo_rmse"
        ),
    ),
)
def stock_scale_search(s):
    d = stock_scored(s).withColumn("stock_pressure", F.col("stock_pressure") * 20)
    masks = {"low_stock": F.col("low_stock") == 1, "non_promo": F.col("any_promo") == 0}
    g = bl.with_grid(d, STOCK_GRID).withColumn("sc", bl.stock_scale()).withColumn("predicted", F.col("base_pred") * F.col("sc"))
    keys = ["alpha", "beta", "clip_lo", "clip_hi"]
    m = mt.slice_metrics(g, keys, masks).join(g.groupBy(*keys).agg(F.avg("sc").alias("mean_scale")), keys)
    b = mt.slice_metrics(d.withColumn("predicted", F.col("base_pred")), ["series_id"], masks).select(F.struct("rmse", "low_stock_rmse", "non_promo_rmse")).scalar()
    return bl.accept(m, {n: b[n] for n in ("rmse", "low_stock_rmse", "non_promo_rmse")}, {"rmse": 1.01, "non_promo_rmse": 1.03, "low_stock_rmse": 1.05})


MICRO = [
    {"candidate": n, "clip_lo": lo, "clip_hi": hi, "protection": p, "risk_boost": r, "promo_boost": a, "intensity_boost": i}
    for n, lo, hi, p, r, a, i in (
        ("base", 0.0, 0.0, "none", 0.0, 0.0, 0.0), ("clip", 0.97, 1.12, "none", 0.0, 0.0, 0.0), ("light", 0.98, 1.10, "light", 0.0, 0.0, 0.0), ("medium", 0.98, 1.10, "medium", 0.005, 0.0, 0.0),
        ("strong", 0.98, 1.10, "strong", 0.01, 0.005, 0.0), ("promo", 0.98, 1.10, "none", 0.0, 0.005, 0.01),
    )
]
MICRO_SQL = """(CASE WHEN clip_lo > 0 THEN GREATEST(clip_lo, LEAST(clip_hi, raw_scale)) ELSE base_scale END
  * CASE WHEN spike_prob < 0.15 THEN CASE protection WHEN 'light' THEN 0.990::DOUBLE WHEN 'medium' THEN 0.985::DOUBLE WHEN 'strong' THEN 0.975::DOUBLE ELSE 1 END
         WHEN spike_prob < 0.25 THEN CASE protection WHEN 'light' THEN 0.995::DOUBLE WHEN 'medium' THEN 0.990::DOUBLE WHEN 'strong' THEN 0.985::DOUBLE ELSE 1 END ELSE 1 END
  * CASE WHEN is_high_risk_month = 1 AND (spike_prob >= 0.30 OR any_promo > 0) THEN 1 + risk_boost ELSE 1 END * CASE WHEN any_promo > 0 THEN 1 + promo_boost ELSE 1 END * CASE WHEN high_intensity = 1 THEN 1 + intensity_boost ELSE 1 END)"""


@query(
    "micro_calibration",
    "candidate:s mean_scale:6 min_scale:6 max_scale:6 mae:2 rmse:2 r2:6 top10_rmse:2 non_spike_rmse:2",
    sql(
        "slevels",
        f"SELECT candidate, AVG(sc) AS mean_scale, MIN(sc) AS min_scale, MAX(sc) AS max_scale, {M_SQL}, {SPIKE_SQL} FROM (SELECT *, base_pred * sc / base_scale AS predicted FROM (SELECT *, {MICRO_SQL} AS sc FROM d, {values(MICRO)})) GROUP BY 1",
        d="""SELECT *, 0.9 + 0.3 * spike_prob AS raw_scale, GREATEST(0.98, LEAST(1.10, 0.9 + 0.3 * spike_prob)) AS base_scale, CAST(avg_discount_value * active_promo_count >=
               (SELECT QUANTILE_CONT(avg_discount_value * active_promo_count, 0.75) FROM scored WHERE any_promo > 0) AS INT) AS high_intensity FROM slevels""",
    ),
)
def micro_calibration(s):
    d = mt.with_spike_levels(scored(s), ["series_id"])
    i = F.col("avg_discount_value") * F.col("active_promo_count")
    p75 = d.where("any_promo > 0").agg(F.percentile(i, F.lit(0.75))).scalar()
    raw = 0.9 + 0.3 * F.col("spike_prob")
    d = d.select("*", raw.alias("raw_scale"), F.greatest(F.lit(0.98), F.least(F.lit(1.10), raw)).alias("base_scale"), (i >= p75).cast("int").alias("high_intensity"))
    g = bl.with_grid(d, MICRO).withColumn("sc", bl.micro_scale()).withColumn("predicted", F.col("base_pred") * bl.micro_factor())
    return g.groupBy("candidate").agg(F.avg("sc").alias("mean_scale"), F.min("sc").alias("min_scale"), F.max("sc").alias("max_scale"), *mt.basic(), *mt.spike_columns())


RATIO_GRID = [{"variant": n, "o_lo": a, "o_hi": b, "v_lo": c, "v_hi": d} for n, a, b, c, d in (("orders_05", 0.95, 1.05, 1.0, 1.0), ("orders_10", 0.90, 1.10, 1.0, 1.0), ("value_07", 1.0, 1.0, 0.93, 1.07), ("both_soft", 0.95, 1.05, 0.95, 1.05), ("both_strong", 0.90, 1.10, 0.93, 1.07))]


@query(
    "driver_ratio_correction",
    "variant:s rows:i " + BASIC_OUT,
    sql(
        "components drivers orders_ref funnel",
        f"""SELECT variant, {M_SQL} FROM (SELECT variant, c.actual, GREATEST(0, recent * GREATEST(o_lo, LEAST(o_hi, COALESCE(CASE WHEN ABS(om) > 1e-9 THEN predicted_orders / om END, 1)))) * GREATEST(v_lo, LEAST(v_hi, COALESCE(CASE WHEN ABS(vm) > 1e-9 THEN predicted_aov / vm END, 1))) AS predicted
           FROM components c JOIN drivers d USING (date) JOIN (SELECT date, orders_same_day_mean AS om FROM orders_ref) o USING (date) JOIN (
             SELECT t.date, {_wavg([(0.5, 'a.aov'), (0.3, 'b.aov'), (0.2, 'c.aov')])} AS vm FROM funnel t {_back(1, 'a', 'funnel', guard=False)} {_back(2, 'b', 'funnel', guard=False)} {_back(3, 'c', 'funnel', guard=False)}) v USING (date), {values(RATIO_GRID)}) GROUP BY variant""",
    ),
)
def driver_ratio_correction(s):
    f = funnel(s).select("series_id", "date", F.col("orders_count").cast("double").alias("orders_count"), "aov")
    o = ref.series_reference(f, f, "orders_count", "o").select("date", "o_same_day_mean")
    v = ref.series_reference(f, f, "aov", "v").select("date", "v_same_day_mean")
    d = s.components().join(drivers(s).select("date", "predicted_orders", "predicted_aov"), "date").join(o, "date").join(v, "date")
    d = d.select("*", ref.div_null("predicted_orders", "o_same_day_mean").alias("ro"), ref.div_null("predicted_aov", "v_same_day_mean").alias("rv"))
    g = bl.with_grid(d, RATIO_GRID)
    first = bl.ratio_correct(F.col("recent"), F.col("ro"), F.col("o_lo"), F.col("o_hi"))
    return mt.regression_metrics(g.withColumn("predicted", bl.ratio_correct(first, F.col("rv"), F.col("v_lo"), F.col("v_hi"))), ["variant"])


# -- risk -------------------------------------------------------------------------------
cte("anchored", "components", "SELECT series_id, date, last_year, recent, weekday, level AS anchor, (SELECT QUANTILE_CONT(level, 0.5) FROM components) AS anchor_p50, (SELECT QUANTILE_CONT(level, 0.9) FROM components) AS anchor_p90 FROM components")


def anchored(s):
    return bl.with_anchor_levels(s.components().withColumn("anchor", F.col("level")), "anchor", ["series_id"])


cte(
    "diagnostics",
    "anchored",
    """SELECT *, exclusion_reasons = '' AS passes FROM (SELECT *, RTRIM(CASE WHEN ABS(mean_ratio - 1) > 0.08 THEN 'mean_shift_gt_8pct;' ELSE '' END || CASE WHEN max_ratio NOT BETWEEN 0.75 AND 1.25 THEN 'max_ratio_outside_0.75_1.25;' ELSE '' END
         || CASE WHEN top10_ratio NOT BETWEEN 0.75 AND 1.25 THEN 'top10_spike_ratio_extreme;' ELSE '' END, ';') AS exclusion_reasons
       FROM (SELECT model, AVG(x) AS mean_revenue, STDDEV_SAMP(x) AS std_revenue, MAX(x) AS max_revenue, MIN(x) AS min_revenue, AVG(x) / AVG(anchor) AS mean_ratio, MAX(x) / MAX(anchor) AS max_ratio,
         AVG(x) FILTER (anchor >= anchor_p90) / AVG(anchor) FILTER (anchor >= anchor_p90) AS top10_ratio, AVG(x) FILTER (anchor <= anchor_p50) / AVG(anchor) FILTER (anchor <= anchor_p50) AS bottom50_ratio, CORR(x, anchor) AS corr_to_anchor,
         COUNT(*) FILTER (ABS(x / anchor - 1) > 0.05) AS days_gt_5pct, COUNT(*) FILTER (ABS(x / anchor - 1) > 0.10) AS days_gt_10pct
         FROM (""" + " UNION ALL ".join(f"SELECT *, '{m}' AS model, {m} AS x FROM anchored" for m in MODELS[:3]) + ") GROUP BY model))",
)


@query(
    "candidate_diagnostics",
    "model:s mean_revenue:3 std_revenue:2 max_revenue:2 min_revenue:2 mean_ratio:6 max_ratio:6 top10_ratio:6 bottom50_ratio:6 corr_to_anchor:6 days_gt_5pct:i days_gt_10pct:i exclusion_reasons:s passes:b",
    sql("diagnostics", "SELECT * FROM diagnostics"),
)
def candidate_diagnostics(s):
    return candidate_diagnostics_of(s)


@kept
def candidate_diagnostics_of(s):
    d = anchored(s)
    long = mt.predictions_long(d.select("series_id", "date", "anchor", "anchor_p50", "anchor_p90", *MODELS[:3]), MODELS[:3])
    return bl.candidate_diagnostics(long, ["model"])


CATALOG = bl.blend_catalog("anchor", ["recent", "weekday"], [0.990, 0.995, 1.000, 1.005, 1.010])
cte("catalog", "anchored", f"SELECT *, GREATEST(0, (w_anchor * anchor + w_recent * recent + w_weekday * weekday) * scale) AS predicted FROM anchored, {values(CATALOG)}")
cte("changes", "catalog", "SELECT *, CASE WHEN ABS(anchor) > 1e-9 THEN (predicted - anchor) / anchor ELSE 0 END AS c FROM catalog")


def catalog(s):
    g = bl.with_grid(anchored(s), CATALOG)
    mix = bl.total([F.col(f"w_{m}") * F.col(m) for m in ("anchor", "recent", "weekday")])
    return g.withColumn("predicted", fx.clip(mix * F.col("scale"), lo=0))


@query(
    "blend_risk_table",
    "blend_id:s scale:3 mean_shift:8 std_shift:8 max_shift:8 days_gt_5pct:i days_gt_10pct:i top10_change:8 bottom50_change:8 risk_score:5",
    sql(
        "changes",
        """SELECT *, 900 * GREATEST(0, mean_shift - 0.02) + 250 * GREATEST(0, std_shift - 0.025) + 140 * GREATEST(0, max_shift - 0.08) + 0.35 * days_gt_5pct + 1.10 * days_gt_10pct + 320 * GREATEST(0, -top10_change - 0.01)
             + 220 * GREATEST(0, bottom50_change - 0.01) + 100 * GREATEST(0, b_abs - 0.03) + 90 * GREATEST(0, t_abs - 0.05) + 120 * GREATEST(0, 0.85 - anchor_weight) AS risk_score
           FROM (SELECT blend_id, scale, MAX(anchor_weight) AS anchor_weight, ABS(AVG(predicted) / AVG(anchor) - 1) AS mean_shift, STDDEV_POP(c) AS std_shift, MAX(ABS(c)) AS max_shift, COUNT(*) FILTER (ABS(c) > 0.05) AS days_gt_5pct,
             COUNT(*) FILTER (ABS(c) > 0.10) AS days_gt_10pct, AVG(c) FILTER (anchor >= anchor_p90) AS top10_change, AVG(c) FILTER (anchor <= anchor_p50) AS bottom50_change, AVG(ABS(c)) FILTER (anchor >= anchor_p90) AS t_abs,
             AVG(ABS(c)) FILTER (anchor <= anchor_p50) AS b_abs FROM changes GROUP BY blend_id, scale)""",
    ),
)
def blend_risk_table(s):
    return bl.risk_table(catalog(s), ["blend_id", "scale"])


CANDIDATES = MODELS[:3]
# Weights of the named blends; one that names a forecast that is absent is left out.
NAMED = {
    "tiny_A": {"anchor": 0.90, "recent": 0.05, "weekday": 0.05},
    "tiny_B": {"anchor": 0.90, "last_year": 0.05, "stock_cautious": 0.05},
    "tiny_C": {"anchor": 0.85, "last_year": 0.10, "weekday": 0.05},
    "tiny_E": {"anchor": 0.80, "last_year": 0.10, "recent": 0.05, "weekday": 0.05},
}
SCALES = [0.990, 0.995, 1.000, 1.005, 1.010]
NAMED_SQL = ", ".join(f"('{n}', '{'three_way' if len(w) == 3 else 'four_way'}', " + ", ".join(str(w.get(m, 0.0)) for m in ("anchor", *CANDIDATES)) + ")" for n, w in NAMED.items() if set(w) <= {"anchor", *CANDIDATES})
cte(
    "tested_catalog",
    "anchored diagnostics",
    """SELECT *, GREATEST(0, (w_anchor * anchor + w_last_year * last_year + w_recent * recent + w_weekday * weekday) * scale) AS predicted FROM anchored, (
         SELECT 'two_way__' || model || '__' || CAST(a AS VARCHAR) || '_' || CAST(100 - a AS VARCHAR) AS blend_id, 'two_way' AS mode, a / 100.0::DOUBLE AS w_anchor, """
    + ", ".join(f"CASE WHEN model = '{m}' THEN (100 - a) / 100.0::DOUBLE ELSE 0::DOUBLE END AS w_{m}" for m in CANDIDATES)
    + f""" FROM diagnostics, (VALUES (95), (90), (85)) v(a) WHERE passes
         UNION ALL SELECT name, mode, a::DOUBLE, b::DOUBLE, c::DOUBLE, d::DOUBLE FROM (VALUES {NAMED_SQL}) n(name, mode, a, b, c, d)) blends, (SELECT UNNEST({SCALES}::DOUBLE[]) AS scale)""",
)
cte("tested_changes", "tested_catalog", "SELECT *, CASE WHEN ABS(anchor) > 1e-9 THEN (predicted - anchor) / anchor ELSE 0 END AS c, w_anchor AS anchor_weight FROM tested_catalog")


@query(
    "tested_blend_catalogue",
    "blend_id:s mode:s scale:3 anchor_weight:3 mean_shift:8 std_shift:8 max_shift:8 days_gt_5pct:i days_gt_10pct:i risk_score:5 position:i",
    sql(
        "tested_changes",
        """SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(risk_score, 6), blend_id, scale) AS position FROM (
           SELECT *, 900 * GREATEST(0, mean_shift - 0.02) + 250 * GREATEST(0, std_shift - 0.025) + 140 * GREATEST(0, max_shift - 0.08) + 0.35 * days_gt_5pct + 1.10 * days_gt_10pct + 320 * GREATEST(0, -top10_change - 0.01)
             + 220 * GREATEST(0, bottom50_change - 0.01) + 100 * GREATEST(0, b_abs - 0.03) + 90 * GREATEST(0, t_abs - 0.05) + 120 * GREATEST(0, 0.85 - anchor_weight) AS risk_score
           FROM (SELECT blend_id, mode, scale, anchor_weight, ABS(AVG(predicted) / AVG(anchor) - 1) AS mean_shift, STDDEV_POP(c) AS std_shift, MAX(ABS(c)) AS max_shift, COUNT(*) FILTER (ABS(c) > 0.05) AS days_gt_5pct,
             COUNT(*) FILTER (ABS(c) > 0.10) AS days_gt_10pct, AVG(c) FILTER (anchor >= anchor_p90) AS top10_change, AVG(c) FILTER (anchor <= anchor_p50) AS bottom50_change, AVG(ABS(c)) FILTER (anchor >= anchor_p90) AS t_abs,
             AVG(ABS(c)) FILTER (anchor <= anchor_p50) AS b_abs FROM tested_changes GROUP BY ALL))""",
    ),
)
def tested_blend_catalogue(s):
    """Two-way blends of the candidates that pass their diagnostics, and the named blends, ranked by risk."""
    from pyspark.sql import Window

    known = candidate_diagnostics_of(s).agg(F.struct(F.sort_array(F.collect_set(F.when(F.col("passes"), F.col("model")))).alias("safe"), F.collect_set("model").alias("present"))).scalar()
    d = anchored(s).withColumn("_known", known)
    g = bl.with_grid(d, bl.tested_catalog(F.col("_known.safe"), F.col("_known.present"), "anchor", NAMED, SCALES))
    mix = bl.total([F.coalesce(F.col("weights")[m], F.lit(0.0)) * F.col(m) for m in ("anchor", *CANDIDATES)])
    r = bl.risk_table(g.withColumn("predicted", fx.clip(mix * F.col("scale"), lo=0)), ["blend_id", "mode", "scale"])
    return r.withColumn("position", F.row_number().over(Window.orderBy(F.round("risk_score", 6), "blend_id", "scale")))


@query(
    "blend_shift_metrics",
    "blend_id:s scale:3 mean_shift_pct:6 std_shift_pct:6 max_abs_dev_pct:6 pct_days_gt_2:6 pct_days_gt_5:6 top10_change_pct:6 bottom50_change_pct:6 top10_bias_penalty:8 safe_zone:b",
    sql(
        "changes",
        """SELECT *, ABS(top10_change_pct / 100 - 0.002) + CASE WHEN top10_change_pct < 0 THEN 0.02 ELSE 0 END AS top10_bias_penalty, ABS(mean_shift_pct) <= 2 AND max_abs_dev_pct <= 8 AND pct_days_gt_5 <= 10 AS safe_zone
           FROM (SELECT blend_id, scale, AVG(c) * 100 AS mean_shift_pct, STDDEV_POP(c) * 100 AS std_shift_pct, MAX(ABS(c)) * 100 AS max_abs_dev_pct, COUNT(*) FILTER (ABS(c) > 0.02) * 100.0::DOUBLE / COUNT(*) AS pct_days_gt_2,
             COUNT(*) FILTER (ABS(c) > 0.05) * 100.0::DOUBLE / COUNT(*) AS pct_days_gt_5, AVG(c) FILTER (anchor >= anchor_p90) * 100 AS top10_change_pct, AVG(c) FILTER (anchor <= anchor_p50) * 100 AS bottom50_change_pct
             FROM changes GROUP BY blend_id, scale)""",
    ),
)
def blend_shift_metrics(s):
    return bl.shift_metrics(catalog(s), ["blend_id", "scale"])


@query(
    "meta_context",
    "date:d base_pred:2 last_year:2 weekday:2 level:2 spike_prob:8 z_365_365:6 lag365_above_p90:i lag365_above_p95:i any_promo:i campaign_index:i",
    sql(
        "scored v2",
        """SELECT s.date, s.base_pred, s.last_year, s.weekday, s.level, s.spike_prob, COALESCE(v.z_365_365, 0) AS z_365_365, COALESCE(v.lag365_above_p90, 0) AS lag365_above_p90, COALESCE(v.lag365_above_p95, 0) AS lag365_above_p95,
             s.any_promo, v.campaign_index FROM scored s LEFT JOIN v2 v USING (date)""",
    ),
)
def meta_context(s):
    """Component forecasts, probability, spike signals and promotions on one row per date."""
    v = spike_table(s).select("date", "z_365_365", "lag365_above_p90", "lag365_above_p95", "campaign_index")
    return scored(s).join(v, "date", "left").na.fill(0, ["z_365_365", "lag365_above_p90", "lag365_above_p95"])


