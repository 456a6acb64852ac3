"""Feature blocks and training tables as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisleflow.functions.scalars import complete_cases, drop_unsafe, half_up, half_up_sql
from aisleflow.operators import aggregates as agg
from aisleflow.operators import features as ft
from aisleflow.operators import joins as jn
from aisleflow.operators import promos as pr
from aisleflow.operators import references as ref
from aisleflow.operators import stock as st
from aisleflow.operators import windows as win
from aisleflow.plans.calendar_promos import CAL_OUT, CALF_OUT, CAMPAIGNS, PHASE_OUT, active_days, calendar, known_calendar, phase_calendar
from aisleflow.plans.daily_facts import SNAP_COLS, SNAP_OUT, funnel
from aisleflow.plans.registry import kept, query
from aisleflow.plans.series_windows import dense_traffic, lagged, strict, traffic_table
from aisleflow.plans.sqlbase import cte, sql

CUTD = "DATE '1999-12-31'"


# -- static context and history --------------------------------------------------
@query(
    "static_context",
    "date:d " + CALF_OUT + " " + CAL_OUT + " " + PHASE_OUT + " " + SNAP_OUT,
    sql("calendar pphase snaps", "SELECT c.*, p.* EXCLUDE (date), " + ", ".join(f"COALESCE(a.{x}, 0) AS {x}" for x in SNAP_COLS) + " FROM calendar c JOIN pphase p USING (date) ASOF LEFT JOIN snaps a ON c.date >= a.date"),
)
def static_context(s):
    stock = jn.asof_backward(s.spine(), s.snapshots(), SNAP_COLS).drop("asof_date")
    return calendar(s).join(phase_calendar(s), "date").join(stock, "date").na.fill(0)


HIST_OUT = " ".join(f"revenue_lag_{k}:4" for k in ft.LAGS) + " " + " ".join(f"revenue_roll_mean_{w}:3" for w in ft.MEANS) + " " + " ".join(f"revenue_roll_std_{w}:2" for w in ft.STDS)


def hist_sql(table):
    return (
        "SELECT *, " + ", ".join(f"{lagged('revenue', k)} AS revenue_lag_{k}" for k in ft.LAGS) + ", " + ", ".join(f"{strict('revenue', w)} AS revenue_roll_mean_{w}" for w in ft.MEANS)
        + ", " + ", ".join(f"{strict('revenue', w, 'STDDEV_SAMP')} AS revenue_roll_std_{w}" for w in ft.STDS) + f" FROM {table}"
    )


cte("hist", "revenue", hist_sql("revenue"))
cte("past_q", "revenue", "SELECT date, " + ", ".join(f"QUANTILE_CONT(revenue, 0.{q}) OVER w AS past_p{q}" for q in (80, 90, 95)) + " FROM revenue WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
cte("btab", "hist calendar pknown past_q", "SELECT h.*, c.* EXCLUDE (date), p.* EXCLUDE (date), q.* EXCLUDE (date) FROM hist h JOIN calendar c USING (date) JOIN pknown p USING (date) JOIN past_q q USING (date)")


@kept
def base_table(s):
    """Revenue history with calendar and known promotions, one row per day."""
    return ft.revenue_history(s.revenue()).join(calendar(s), "date").join(known_calendar(s), "date")


@query("revenue_history_block", "series_id:s date:d " + HIST_OUT, sql("panel", hist_sql("(SELECT series_id, date, revenue FROM panel)")))
def revenue_history_block(s):
    return ft.revenue_history(s.panel().select("series_id", "date", "revenue"))


def eps(n, d):
    return f"({n}) / (ABS({d}) + 1e-6::DOUBLE)"


def gt(a, b):
    return f"CAST(({a}) > ({b}) AS INT)"


RATIOS = {"lag7_to_roll30_ratio": (7, 30), "lag14_to_roll30_ratio": (14, 30), "lag30_to_roll90_ratio": (30, 90), "lag365_to_roll365_ratio": (365, 365), "lag365_to_roll30_ratio": (365, 30)}
SPIKES = {"lag7_spike_flag": (7, 30), "lag30_spike_flag": (30, 90), "lag365_spike_flag": (365, 365)}
V1_X = [("revenue_lag_365", "month"), ("revenue_lag_365", "day_of_week"), ("revenue_lag_365", "day_of_year"), ("revenue_lag_7", "day_of_week"), ("revenue_lag_365", "is_high_error_month"), ("revenue_roll_mean_7", "is_high_error_month")]


def times(pairs):
    return ", ".join(" * ".join(p) + " AS " + "_x_".join(p) for p in pairs)


cte(
    "v1",
    "btab",
    "SELECT *, " + gt("ROUND(rel_volatility_30, 10)", "ROUND(MEDIAN(rel_volatility_30) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10)") + " AS recent_volatility_high, " + times(V1_X)
    + " FROM (SELECT *, " + ", ".join(f"{eps(f'revenue_roll_std_{w}', f'revenue_roll_mean_{w}')} AS rel_volatility_{w}" for w in ft.STDS) + ", "
    + ", ".join(f"{eps(f'revenue_lag_{k}', f'revenue_roll_mean_{w}')} AS {n}" for n, (k, w) in RATIOS.items()) + ", "
    + ", ".join(f"{gt(f'revenue_lag_{k}', f'revenue_roll_mean_{w} * 1.25::DOUBLE')} AS {n}" for n, (k, w) in SPIKES.items()) + ", CAST(month IN (2, 3, 5, 8) AS INT) AS is_high_error_month FROM btab)",
)
V1_OUT = " ".join(f"rel_volatility_{w}:8" for w in ft.STDS) + " " + " ".join(f"{n}:6" for n in RATIOS) + " " + " ".join(f"{n}:i" for n in SPIKES) + " recent_volatility_high:i is_high_error_month:i " + " ".join("_x_".join(p) + ":2" for p in V1_X)


@query("spike_features", "date:d " + V1_OUT, sql("v1", "SELECT * FROM v1"))
def spike_features(s):
    return ft.spike_v1(base_table(s))


ABOVE = [(7, 80), (7, 90), (7, 95), (30, 80), (30, 90), (365, 80), (365, 90), (365, 95)]
ZS = [(7, 30), (14, 30), (30, 90), (365, 365)]
V2_X = [("z_365_365", "month"), ("z_365_365", "day_of_year"), ("lag365_above_p90", "month"), ("lag365_above_p90", "day_of_week"), ("any_promo", "lag365_above_p90"), ("avg_discount_value", "z_365_365"), ("active_promo_count", "z_365_365")]
cte(
    "v2",
    "v1",
    "SELECT *, " + times(V2_X) + " FROM (SELECT *, " + ", ".join(f"(revenue_lag_{k} - revenue_roll_mean_{w}) / (revenue_roll_std_{w} + 1e-6::DOUBLE) AS z_{k}_{w}" for k, w in ZS) + ", "
    + ", ".join(f"{gt(f'revenue_lag_{k}', f'past_p{q}')} AS lag{k}_above_p{q}" for k, q in ABOVE)
    + ", revenue_lag_7 - revenue_lag_30 AS momentum_7_30, revenue_lag_14 - revenue_lag_60 AS momentum_14_60, revenue_lag_30 - revenue_lag_90 AS momentum_30_90, revenue_lag_7 / (revenue_lag_30 + 1e-6::DOUBLE) AS momentum_ratio_7_30 FROM v1)",
)
V2_OUT = " ".join(f"z_{k}_{w}:6" for k, w in ZS) + " " + " ".join(f"lag{k}_above_p{q}:i" for k, q in ABOVE) + " momentum_7_30:4 momentum_14_60:4 momentum_30_90:4 momentum_ratio_7_30:1 " + " ".join("_x_".join(p) + ":4" for p in V2_X)


@kept
def spike_table(s):
    return ft.spike_v2(ft.spike_v1(base_table(s)))


@query("spike_strength_features", "date:d " + V2_OUT, sql("v2", "SELECT * FROM v2"))
def spike_strength_features(s):
    return ft.spike_v2(base_table(s))


DEEP_X = [
    ("revenue_lag_365", "avg_discount_value"), ("revenue_lag_365", "any_promo"), ("growth_7_30", "any_promo"), ("growth_1_7", "avg_discount_value"), ("revenue_roll_std_30", "any_promo"),
    ("day_of_year", "any_promo"), ("phase_sin", "avg_discount_value"), ("lag365_reaches_p90", "any_promo"), ("lag365_strength", "avg_discount_value"),
]
DEEP_OUT = (
    "revenue_lag_1:4 revenue_lag_3:4 revenue_roll_std_7:2 growth_1_7:1 growth_7_30:6 growth_30_90:6 short_trend:4 volatility_ratio_7_30:6 lag365_reaches_p90:i lag365_reaches_p95:i lag365_strength:6 "
    "discount_intensity:6 promo_pressure:6 promo_urgency:6 phase_sin:6 phase_cos:6 " + " ".join("_x_".join(p) + (":1" if p[0] == "growth_1_7" else ":2") for p in DEEP_X)
)
REACH = "CAST(revenue_lag_365 >= past_p90 AS INT) AS lag365_reaches_p90, CAST(revenue_lag_365 >= past_p95 AS INT) AS lag365_reaches_p95, " + eps("revenue_lag_365", "revenue_roll_mean_365") + " AS lag365_strength, SIN(2 * PI() * day_of_year / 365) AS phase_sin, COS(2 * PI() * day_of_year / 365) AS phase_cos"


@query(
    "deep_feature_block",
    "date:d " + DEEP_OUT,
    sql(
        "btab",
        "SELECT *, " + times(DEEP_X) + " FROM (SELECT *, " + eps("revenue_lag_1", "revenue_lag_7") + " AS growth_1_7, " + eps("revenue_lag_7", "revenue_roll_mean_30") + " AS growth_7_30, "
        + eps("revenue_lag_30", "revenue_roll_mean_90") + " AS growth_30_90, revenue_lag_3 - revenue_lag_7 AS short_trend, " + eps("revenue_roll_std_7", "revenue_roll_std_30") + " AS volatility_ratio_7_30, " + REACH
        + ", avg_discount_value * active_promo_count AS discount_intensity, promo_progress_ratio * avg_discount_value AS promo_pressure, CASE WHEN any_promo > 0 THEN 1 / (promo_days_remaining + 1) ELSE 0 END AS promo_urgency"
        + " FROM (SELECT *, " + f"{lagged('revenue', 1)} AS revenue_lag_1, {lagged('revenue', 3)} AS revenue_lag_3, {strict('revenue', 7, 'STDDEV_SAMP')} AS revenue_roll_std_7 FROM btab))",
    ),
)
def deep_feature_block(s):
    return ft.deep_features(base_table(s))


SAFE_X = [("trend_30_90", "any_promo"), ("lag365_strength", "avg_discount_value"), ("phase_sin", "avg_discount_value"), ("revenue_roll_std_30", "any_promo")]
SAFE_OUT = (
    "trend_7_30:6 trend_30_90:6 trend_90_365:6 volatility_ratio_30_90:6 lag365_strength:6 lag365_reaches_p90:i lag365_reaches_p95:i same_campaign_last_year:4 avg_campaign_last_year:3 campaign_strength_index:6 "
    "is_early_phase:i is_peak_phase:i is_late_phase:i " + " ".join(f"memory_{x}:4" for x in CAMPAIGNS) + " " + " ".join("_x_".join(p) + ":2" for p in SAFE_X)
)


@query(
    "safe_feature_block",
    "date:d " + SAFE_OUT,
    sql(
        "btab",
        "SELECT *, " + eps("same_campaign_last_year", "NULLIF(active_promo_count, 0)") + " AS avg_campaign_last_year, " + eps("same_campaign_last_year", "revenue_roll_mean_365") + " AS campaign_strength_index, " + times(SAFE_X)
        + " FROM (SELECT *, " + ", ".join(f"{eps(f'revenue_roll_mean_{a}', f'revenue_roll_mean_{b}')} AS trend_{a}_{b}" for a, b in ((7, 30), (30, 90), (90, 365))) + ", "
        + eps("revenue_roll_std_30", "revenue_roll_std_90") + " AS volatility_ratio_30_90, " + REACH + ", revenue_lag_365 * GREATEST(" + ", ".join(CAMPAIGNS) + ") AS same_campaign_last_year, "
        + ", ".join(f"revenue_lag_365 * {x} AS memory_{x}" for x in CAMPAIGNS)
        + ", CAST(any_promo > 0 AND promo_progress_ratio < 0.3::DOUBLE AS INT) AS is_early_phase, CAST(any_promo > 0 AND promo_progress_ratio BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE AS INT) AS is_peak_phase, "
        "CAST(any_promo > 0 AND promo_progress_ratio > 0.7::DOUBLE AS INT) AS is_late_phase FROM btab)",
    ),
)
def safe_feature_block(s):
    return ft.safe_features(base_table(s), CAMPAIGNS)


@query(
    "promo_context_features",
    "date:d promo_intensity:6 promo_early:i promo_mid:i promo_late:i promo_month:i promo_day_of_year:i promo_x_lag365:4 promo_x_spike:6 promo_x_volatility:8",
    sql(
        "v1",
        """SELECT date, avg_discount_value * active_promo_count AS promo_intensity, CAST(any_promo > 0 AND promo_progress_ratio < 0.3::DOUBLE AS INT) AS promo_early,
             CAST(any_promo > 0 AND promo_progress_ratio BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE AS INT) AS promo_mid, CAST(any_promo > 0 AND promo_progress_ratio > 0.7::DOUBLE AS INT) AS promo_late,
             month * any_promo AS promo_month, day_of_year * any_promo AS promo_day_of_year, any_promo * revenue_lag_365 AS promo_x_lag365, any_promo * lag7_to_roll30_ratio AS promo_x_spike,
             any_promo * rel_volatility_30 AS promo_x_volatility FROM v1""",
    ),
)
def promo_context_features(s):
    return pr.promo_context(ft.spike_v1(base_table(s)))


PX = [("revenue_lag_365", "avg_discount_value"), ("revenue_lag_365", "any_promo"), ("revenue_roll_mean_30", "any_promo")] + [("day_of_year", x) for x in CAMPAIGNS]


@query("promo_interactions", "date:d " + " ".join("_x_".join(p) + ":2" for p in PX), sql("btab", "SELECT *, " + times(PX) + " FROM btab"))
def promo_interactions(s):
    return ft.promo_interactions(base_table(s), CAMPAIGNS)


CX = [("any_promo", "revenue_lag_365"), ("avg_discount_value", "revenue_lag_365"), ("any_promo", "lag7_to_roll30_ratio"), ("campaign_index", "day_of_year")]


@query(
    "classifier_table",
    "date:d top10:i z_365_365:6 lag365_above_p90:i any_promo_x_lag365_above_p90:i " + " ".join("_x_".join(p) + ":4" for p in CX),
    sql("v2", "SELECT *, CAST(revenue >= (SELECT QUANTILE_CONT(revenue, 0.9) FROM revenue WHERE date <= DATE '1999-12-31') AS INT) AS top10, " + times(CX) + " FROM v2"),
)
def classifier_table(s):
    p90 = s.revenue().where("date <= date'1999-12-31'").agg(F.percentile("revenue", F.lit(0.9))).scalar()
    return ft.classifier_table(spike_table(s)).withColumn("top10", (F.col("revenue") >= p90).cast("int"))


# -- drivers ----------------------------------------------------------------------
def metric_sql(col, p, lags, widths, table):
    return (
        "SELECT *, " + eps(f"{p}_lag_7", f"{p}_roll_mean_30") + f" AS {p}_lag7_to_roll30, " + eps("_std", f"{p}_roll_mean_30") + f" AS {p}_volatility_30, {p}_lag_7 - {p}_lag_30 AS {p}_momentum FROM (SELECT *, "
        + ", ".join(f"{lagged(col, k)} AS {p}_lag_{k}" for k in lags) + ", " + ", ".join(f"{strict(col, w)} AS {p}_roll_mean_{w}" for w in widths) + f", {strict(col, 30, 'STDDEV_SAMP')} AS _std FROM {table})"
    )


ML, MW = [7, 14, 30, 365], [7, 30]


@query(
    "orders_history",
    "date:d " + " ".join(f"orders_lag_{k}:2" for k in ML) + " " + " ".join(f"orders_roll_mean_{w}:6" for w in MW) + " orders_lag7_to_roll30:6 orders_volatility_30:6 orders_momentum:2",
    sql("daily", metric_sql("orders_count", "orders", ML, MW, "daily")),
)
def orders_history(s):
    return ft.metric_history(s.order_series().select("series_id", "date", "orders_count"), "orders_count", "orders", ML, MW)


@query(
    "conversion_history",
    "date:d conversion_rate:6 " + " ".join(f"conversion_lag_{k}:6" for k in ML) + " " + " ".join(f"conversion_roll_mean_{w}:6" for w in MW) + " conversion_volatility_30:6",
    sql("funnel", metric_sql("conversion_rate", "conversion", ML, MW, "funnel")),
)
def conversion_history(s):
    return ft.metric_history(funnel(s).select("series_id", "date", "conversion_rate"), "conversion_rate", "conversion", ML, MW)


@query(
    "sessions_history",
    "date:d web_sessions_lag_1:2 web_sessions_lag_7:2 web_sessions_roll_mean_7:6 web_sessions_roll_mean_30:6 web_sessions_to_roll_ratio:6 web_sessions_growth:1",
    sql(
        "funnel",
        "SELECT *, " + eps("web_sessions_lag_1", "web_sessions_roll_mean_30") + " AS web_sessions_to_roll_ratio, " + eps("web_sessions_lag_1", "web_sessions_lag_7") + " - 1 AS web_sessions_growth FROM (SELECT date, "
        + f"{lagged('web_sessions', 1)} AS web_sessions_lag_1, {lagged('web_sessions', 7)} AS web_sessions_lag_7, {strict('web_sessions', 7)} AS web_sessions_roll_mean_7, {strict('web_sessions', 30)} AS web_sessions_roll_mean_30 FROM funnel)",
    ),
)
def sessions_history(s):
    return ft.traffic_history(funnel(s).select("series_id", "date", "web_sessions"))


AL, AW = [7, 14, 30, 90, 365], [7, 30, 90, 365]


@query(
    "order_value_training_table",
    "date:d orders_count:i aov:4 orders_lag_365:2 orders_roll_mean_365:6 aov_lag_365:4 aov_roll_mean_365:3 aov_roll_median_30:3 orders_1y:2 orders_2y:2 orders_3y:2 orders_same_day_mean:6 month:i day_of_week:i any_promo:i",
    sql(
        "funnel orders_ref calendar pknown",
        f"""SELECT f.date, f.orders_count, f.aov, {lagged('f.orders_count', 365).replace('series_id', 'f.series_id').replace('BY date', 'BY f.date')} AS orders_lag_365, m1 AS orders_roll_mean_365, l1 AS aov_lag_365, m2 AS aov_roll_mean_365, d1 AS aov_roll_median_30,
             r.orders_1y, r.orders_2y, r.orders_3y, r.orders_same_day_mean, c.month, c.day_of_week, p.any_promo
           FROM funnel f JOIN (SELECT date, {strict('orders_count', 365)} AS m1, {lagged('aov', 365)} AS l1, {strict('aov', 365)} AS m2, {strict('aov', 30, 'MEDIAN')} AS d1 FROM funnel) w USING (date)
           JOIN orders_ref r USING (date) JOIN calendar c USING (date) JOIN pknown p USING (date)""",
    ),
)
def order_value_training_table(s):
    """Orders and order value with look-backs, yearly references, calendar and promotions."""
    f = funnel(s).select("series_id", "date", "orders_count", "aov")
    t = f.select("*", *win.lag_columns(["orders_count", "aov"], AL), *win.roll_mean_columns(["orders_count", "aov"], AW), win.roll_median("aov", 30).alias("aov_roll_median_30"))
    t = t.withColumnRenamed("orders_count_lag_365", "orders_lag_365").withColumnRenamed("orders_count_roll_mean_365", "orders_roll_mean_365")
    t = ref.series_reference(t, f.withColumn("orders_count", F.col("orders_count").cast("double")), "orders_count", "orders")
    return t.join(calendar(s), "date").join(known_calendar(s).select("date", "any_promo"), "date")


@query(
    "union_feature_table",
    "date:d predicted_orders_signal:6 stock_pressure_x_promo:8 stock_pressure_x_lag365:4 lag365_x_campaign_intensity:2 lag365_x_sessions_growth:2 aov_lag365_x_discount:4 orders_lag365_x_sessions_growth:6 stock_pressure_x_campaign_intensity:8",
    sql(
        "hist pknown tfeat stock orders_ref funnel",
        """SELECT date, om * GREATEST(0.6, LEAST(1.6, g)) AS predicted_orders_signal, sp * any_promo AS stock_pressure_x_promo, sp * l AS stock_pressure_x_lag365, l * campaign_intensity AS lag365_x_campaign_intensity,
             l * g AS lag365_x_sessions_growth, al * avg_discount_value AS aov_lag365_x_discount, ol * g AS orders_lag365_x_sessions_growth, sp * campaign_intensity AS stock_pressure_x_campaign_intensity
           FROM (SELECT h.date, p.any_promo, p.campaign_intensity, p.avg_discount_value, COALESCE(r.orders_same_day_mean, 0) AS om, COALESCE(t.sessions_growth_3_14, 1) AS g, COALESCE(k.stock_pressure, 0) AS sp,
                   COALESCE(h.revenue_lag_365, 0) AS l, COALESCE(f.al, 0) AS al, COALESCE(f.ol, 0) AS ol
                 FROM hist h JOIN pknown p USING (date) JOIN tfeat t USING (date) JOIN orders_ref r USING (date)
                 JOIN (SELECT date, """ + f"{lagged('aov', 365)} AS al, {lagged('orders_count', 365)} AS ol" + """ FROM funnel) f USING (date) ASOF LEFT JOIN stock k ON h.date >= k.date)""",
    ),
)
def union_feature_table(s):
    f = funnel(s).select("series_id", "date", F.col("orders_count").cast("double").alias("orders_count"), "aov")
    drivers = ref.series_reference(f, f, "orders_count", "orders").join(
        f.select("date", win.lag("aov", 365).alias("aov_lag_365"), win.lag("orders_count", 365).alias("orders_lag_365")), "date"
    ).select("date", "orders_same_day_mean", "aov_lag_365", "orders_lag_365")
    stock = jn.asof_backward(s.spine(), s.stock_signals(), ["stock_pressure"]).drop("asof_date")
    t = ft.revenue_history(s.revenue()).join(known_calendar(s), "date").join(traffic_table(s).select("date", "sessions_growth_3_14"), "date").join(drivers, "date").join(stock, "date")
    return ft.union_features(t)


cte("pred_orders", "daily", "SELECT series_id, date, " + half_up_sql(strict("orders_count", 7), 4) + " AS predicted_orders FROM daily")


def pred_orders(s):
    """A stand-in orders forecast: last week's mean."""
    return s.order_series().select("series_id", "date", half_up(win.roll_mean("orders_count", 7), 4).alias("predicted_orders"))


@query(
    "predicted_orders_features",
    "date:d predicted_orders:4 predicted_orders_log1p:6 predicted_orders_x_avg_discount_value:6 predicted_orders_x_any_promo:4 predicted_orders_x_day_of_week:4 orders_spike_flag:i orders_momentum_flag:i orders_high_flag:i",
    sql(
        "pred_orders pknown calendar",
        f"""SELECT date, predicted_orders, CASE WHEN predicted_orders IS NOT NULL THEN LN(1 + GREATEST(predicted_orders, 0)) END AS predicted_orders_log1p, predicted_orders * avg_discount_value AS predicted_orders_x_avg_discount_value,
             predicted_orders * any_promo AS predicted_orders_x_any_promo, predicted_orders * day_of_week AS predicted_orders_x_day_of_week, {gt('l7', '1.2::DOUBLE * m30')} AS orders_spike_flag, {gt('l1', 'l7')} AS orders_momentum_flag,
             {gt('l7', "(SELECT QUANTILE_CONT(predicted_orders, 0.8) FROM pred_orders WHERE date < DATE '2000-01-01')")} AS orders_high_flag
           FROM (SELECT *, {lagged('predicted_orders', 1)} AS l1, {lagged('predicted_orders', 7)} AS l7, {strict('predicted_orders', 30)} AS m30 FROM pred_orders) JOIN pknown USING (date) JOIN calendar USING (date)""",
    ),
)
def predicted_orders_features(s):
    p = pred_orders(s)
    high = p.where("date < date'2000-01-01'").agg(F.percentile("predicted_orders", F.lit(0.8))).scalar()
    t = ft.orders_signal(p, high).join(known_calendar(s), "date").join(calendar(s).select("date", "day_of_week"), "date")
    return ft.predicted_orders_features(t.withColumn("predicted_orders", F.col("predicted_orders")))


@query(
    "business_lag_365",
    "date:d orders_count_lag_365:2 unique_customers_lag_365:2 quantity_lag_365:2 item_lines_lag_365:2",
    sql("daily", "SELECT date, " + ", ".join(f"{lagged(x, 365)} AS {x}_lag_365" for x in ("orders_count", "unique_customers", "quantity", "item_lines")) + " FROM daily"),
)
def business_lag_365(s):
    return s.daily().select("date", *win.lag_columns(["orders_count", "unique_customers", "quantity", "item_lines"], [365]))


SAME_DAY = ["cogs", "orders_count", "unique_customers", "item_lines", "quantity", "gross_value", "discount_amount", "promo_lines"]


@query(
    "forecast_safe_table",
    "date:d revenue:4 " + " ".join(f"{x}_lag_{k}:4" for x in ("orders_count", "quantity") for k in (7, 30)) + " orders_count_roll_mean_30:6 quantity_roll_mean_30:6 " + " ".join(f"revenue_lag_{k}:4" for k in (7, 14, 30, 365)) + " avg_discount_value:6 inventory_stock_on_hand:2 years_since_regime:i",
    sql(
        "daily hist calendar pknown snaps",
        """SELECT d.*, h.revenue_lag_7, h.revenue_lag_14, h.revenue_lag_30, h.revenue_lag_365, p.avg_discount_value, COALESCE(a.inventory_stock_on_hand, 0) AS inventory_stock_on_hand, c.years_since_regime
           FROM (SELECT date, revenue, """ + ", ".join(f"{lagged(x, k)} AS {x}_lag_{k}" for x in ("orders_count", "quantity") for k in (7, 30)) + f", {strict('orders_count', 30)} AS orders_count_roll_mean_30, {strict('quantity', 30)} AS quantity_roll_mean_30"
        + """ FROM daily) d JOIN hist h USING (date) JOIN calendar c USING (date) JOIN pknown p USING (date) ASOF LEFT JOIN snaps a ON d.date >= a.date WHERE h.revenue_lag_365 IS NOT NULL AND orders_count_roll_mean_30 IS NOT NULL""",
    ),
)
def forecast_safe_table(s):
    """Lag first, then drop every same-day realised column, then keep complete rows."""
    t = win.add_lag_grid(s.daily(), ["orders_count", "quantity"], [7, 30], [30])
    t = drop_unsafe(t, SAME_DAY).join(ft.revenue_history(s.revenue()).drop("series_id", "revenue"), "date")
    stock = jn.asof_backward(s.spine(), s.snapshots(), ["inventory_stock_on_hand"]).drop("asof_date").na.fill(0)
    t = t.join(calendar(s), "date").join(known_calendar(s).select("date", "avg_discount_value"), "date").join(stock, "date")
    return complete_cases(t, ["revenue_lag_365", "orders_count_roll_mean_30"])


# -- forecasts as inputs --------------------------------------------------------------
cte(
    "scored",
    "components pknown",
    """SELECT c.*, p.any_promo, p.avg_discount_value, p.active_promo_count, p.promo_progress_ratio, p.promo_days_remaining, p.promo_day_number, """ + ", ".join(f"p.{x}" for x in CAMPAIGNS)
    + """, (RANK() OVER (ORDER BY last_year) + (COUNT(*) OVER (PARTITION BY last_year) - 1) / 2.0::DOUBLE) / COUNT(*) OVER () AS spike_prob,
         CAST(MONTH(date) IN (2, 3, 5, 8) AS INT) AS is_high_risk_month, c.recent AS base_pred FROM components c JOIN pknown p USING (date)""",
)


@kept
def scored(s):
    """Naive forecasts with promotions and a rule-based spike probability (rank of last year)."""
    promo = known_calendar(s).select("date", "any_promo", "avg_discount_value", "active_promo_count", "promo_progress_ratio", "promo_days_remaining", "promo_day_number", *CAMPAIGNS)
    d = s.components().join(promo, "date")
    return d.select("*", win.rank_pct("last_year").alias("spike_prob"), F.month("date").isin([2, 3, 5, 8]).cast("int").alias("is_high_risk_month"), F.col("recent").alias("base_pred"))


@query(
    "base_prediction_features",
    "date:d log_base_pred:6 base_pred_rank_pct:8 promo_intensity:6 is_high_risk_month:i spike_minus_level:2 base_over_spike:4 scale_target_raw:6",
    sql(
        "scored",
        """SELECT date, LN(1 + GREATEST(base_pred, 0)) AS log_base_pred, (RANK() OVER (ORDER BY base_pred) + (COUNT(*) OVER (PARTITION BY base_pred) - 1) / 2.0::DOUBLE) / COUNT(*) OVER () AS base_pred_rank_pct,
             avg_discount_value * active_promo_count AS promo_intensity, is_high_risk_month, weekday - level AS spike_minus_level, base_pred / (weekday + 1e-6::DOUBLE) AS base_over_spike, actual / NULLIF(base_pred, 0) AS scale_target_raw FROM scored""",
    ),
)
def base_prediction_features(s):
    d = scored(s).drop("is_high_risk_month").withColumn("spike_pred", F.col("weekday")).withColumn("level_pred", F.col("level"))
    return ft.base_pred_features(d)


cte(
    "stock_ctx",
    "scored stock",
    """SELECT c.*, CASE WHEN dos < lo THEN 1 ELSE 0 END AS low_stock, CASE WHEN dos > hi THEN 1 ELSE 0 END AS high_stock FROM (
         SELECT s.*, COALESCE(a.inv_avg_days_of_supply, 0) AS dos, COALESCE(a.stock_pressure, 0) AS stock_pressure, COALESCE(a.stockout_pressure, 0) AS stockout_pressure, COALESCE(a.restock_signal, 0) AS restock_signal,
           COALESCE(a.stock_build_up, 0) AS stock_build_up FROM scored s ASOF LEFT JOIN stock a ON s.date >= a.date) c,
       (SELECT QUANTILE_CONT(dos, 0.25) AS lo, QUANTILE_CONT(dos, 0.75) AS hi FROM (SELECT a.inv_avg_days_of_supply AS dos FROM scored s ASOF LEFT JOIN stock a ON s.date >= a.date WHERE s.date <= DATE '1999-12-31'))""",
)
STOCK_X = [("low_stock", "base_pred"), ("stock_pressure", "base_pred"), ("stockout_pressure", "base_pred"), ("high_stock", "spike_prob"), ("stock_pressure", "any_promo"), ("low_stock", "any_promo"), ("restock_signal", "any_promo"), ("high_stock", "avg_discount_value"), ("stock_build_up", "campaign_active")]
STOCK_CTX = ["inv_avg_days_of_supply", "stock_pressure", "stockout_pressure", "restock_signal", "stock_build_up"]


@kept
def stock_scored(s):
    """Scored forecasts with stock flags; thresholds come from the training period only."""
    stock = jn.asof_backward(s.spine(), s.stock_signals(), STOCK_CTX).drop("asof_date").na.fill(0)
    d = scored(s).join(stock, "date").withColumn("campaign_active", sum((F.col(x) for x in CAMPAIGNS), F.lit(0)))
    limits = st.stock_thresholds(d.where("date <= date'1999-12-31'"), ["series_id"])
    return st.stock_flags(d.join(limits, "series_id"))


@query(
    "stock_interactions",
    "date:d low_stock:i high_stock:i " + " ".join("_x_".join(p) + ":4" for p in STOCK_X),
    sql("stock_ctx", "SELECT *, " + times(STOCK_X) + " FROM (SELECT *, " + " + ".join(CAMPAIGNS) + " AS campaign_active FROM stock_ctx)"),
)
def stock_interactions(s):
    return stock_scored(s)


@query(
    "scaling_context",
    "date:d campaign_signal:6 normalized_promo_intensity:6 memory_signal:6 effective_prob:6",
    sql(
        "scored v2",
        """SELECT date, campaign_signal, GREATEST(0, LEAST(1.5, norm * (1 + 0.20 * peak + 0.10 * last7 + 0.05 * first7) * (1 + 0.15 * campaign_signal))) AS normalized_promo_intensity, memory_signal,
             GREATEST(0, LEAST(1, spike_prob * (1 + 0.20 * memory_signal))) AS effective_prob
           FROM (SELECT s.date, s.spike_prob, CAST(s.promo_day_number > 0 AND s.promo_day_number <= 7 AS INT) AS first7, CAST(s.promo_days_remaining BETWEEN 0 AND 6 AND s.any_promo > 0 AS INT) AS last7,
             CAST(s.promo_progress_ratio BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE AND s.any_promo > 0 AS INT) AS peak, GREATEST(0, LEAST(1.5, """
        + " + ".join(f"s.{x} * COALESCE((SELECT strength FROM cs WHERE campaign = '{x}'), 0)" for x in CAMPAIGNS)
        + """)) AS campaign_signal, GREATEST(0, LEAST(1, s.avg_discount_value * s.active_promo_count / (SELECT QUANTILE_CONT(avg_discount_value * active_promo_count, 0.95) FROM scored WHERE any_promo > 0))) AS norm,
             GREATEST(COALESCE(v.lag365_above_p90, 0), COALESCE(v.lag365_above_p95, 0), COALESCE(GREATEST(0, LEAST(1, v.lag365_to_roll365_ratio - 1)), 0)) AS memory_signal FROM scored s JOIN v2 v USING (date))""",
        cs="SELECT campaign, mean_value / MAX(mean_value) OVER () AS strength FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS campaign, AVG(actual) AS mean_value FROM scored WHERE {x} > 0" for x in CAMPAIGNS) + ")",
    ),
)
def scaling_context(s):
    d = scored(s).drop("is_high_risk_month")
    v = spike_table(s).select("date", "lag365_above_p90", "lag365_above_p95", F.col("lag365_to_roll365_ratio").alias("lag365_strength"))
    cs = ref.campaign_strength(d, "actual", CAMPAIGNS)
    one = cs.agg(F.map_from_entries(F.collect_list(F.struct("campaign", "strength")))).scalar()
    scale = d.where("any_promo > 0").agg(F.percentile(pr.promo_intensity(), F.lit(0.95))).scalar()
    return ft.scaling_context(d.join(v, "date"), scale, {x: F.coalesce(F.try_element_at(one, F.lit(x)), F.lit(0.0)) for x in CAMPAIGNS})


@query(
    "volatility_thresholds",
    "series_id:s p80:3 p90:3 p95:3 volatility_threshold:8",
    sql(
        "panel",
        f"""SELECT series_id, QUANTILE_CONT(revenue, 0.8) AS p80, QUANTILE_CONT(revenue, 0.9) AS p90, QUANTILE_CONT(revenue, 0.95) AS p95, COALESCE(MEDIAN(v), 0) AS volatility_threshold
           FROM (SELECT series_id, revenue, {eps('sd', 'm')} AS v FROM (SELECT series_id, date, revenue, {strict('revenue', 30, 'STDDEV_SAMP')} AS sd, {strict('revenue', 30)} AS m FROM panel)) GROUP BY 1""",
    ),
)
def volatility_thresholds(s):
    return ft.threshold_bundle(s.panel().select("series_id", "date", "revenue"))


@query(
    "features_over_forecast",
    "date:d revenue:4 " + HIST_OUT,
    sql("revenue components", hist_sql("mixed").replace("SELECT *,", "SELECT * FROM (SELECT *,", 1) + ") WHERE date >= DATE '2001-01-01'",
        mixed="SELECT series_id, date, revenue FROM revenue WHERE date < DATE '2001-01-01' UNION ALL SELECT series_id, date, weekday FROM components WHERE date >= DATE '2001-01-01'"),
)
def features_over_forecast(s):
    """Look-backs for 2001 in which forecasts of earlier 2001 days stand in for actuals."""
    past = s.revenue().where("date < date'2001-01-01'").select("series_id", "date", "revenue")
    fc = s.components().where("date >= date'2001-01-01'").select("series_id", "date", F.col("weekday").alias("revenue"))
    return ft.features_over_forecast(past, fc, ft.revenue_history)


# -- traffic scenarios ----------------------------------------------------------------
METRICS = {"sessions": "sessions_sum", "visitors": "unique_visitors_sum", "pages": "page_views_sum", "bounce": "avg_bounce_rate"}
cte("tlong", "twide", " UNION ALL ".join(f"SELECT '{m}' AS series_id, date, {x}::DOUBLE AS value FROM twide" for m, x in METRICS.items()))
cte(
    "tscen",
    "tlong pcal",
    """SELECT series_id, date, u.scenario, CASE u.scenario WHEN 'seasonal' THEN seasonal WHEN 'conservative' THEN conservative
             ELSE seasonal * CASE WHEN vol AND (MONTH(date) IN (2, 3, 5, 8) OR any_promo > 0 OR busy) THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN vol AND busy THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END END AS value
           FROM (SELECT *, MAX(CASE WHEN series_id = 'sessions' THEN seasonal END) OVER (PARTITION BY date) >= (SELECT QUANTILE_CONT(value, 0.8) FROM tlong WHERE series_id = 'sessions' AND date <= DATE '1999-12-31') AS busy
             FROM (SELECT *, CASE WHEN vol THEN AVG(raw) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) ELSE raw END AS seasonal
               FROM (SELECT t.series_id, t.date, t.any_promo, t.series_id <> 'bounce' AS vol,
                   GREATEST(0, COALESCE((COALESCE(0.5::DOUBLE * a.value, 0) + COALESCE(0.3::DOUBLE * b.value, 0) + COALESCE(0.2::DOUBLE * c.value, 0))
                     / NULLIF(CASE WHEN a.value IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN b.value IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN c.value IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END, 0), md.v, mm.v, 0))
                     * CASE WHEN t.any_promo > 0 AND t.series_id <> 'bounce' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS raw,
                   GREATEST(0, COALESCE(a.value, md.v, mm.v, 0)) AS conservative
                 FROM (SELECT series_id, date, CAST(active_promo_count > 3 AS INT) AS any_promo FROM tlong JOIN pcal USING (date) WHERE date > DATE '1999-12-31') t
                 LEFT JOIN tlong a ON a.series_id = t.series_id AND a.date = CAST(t.date - TO_YEARS((YEAR(t.date) - 1999)::INT) AS DATE)
                 LEFT JOIN tlong b ON b.series_id = t.series_id AND b.date = CAST(t.date - TO_YEARS((YEAR(t.date) - 1998)::INT) AS DATE)
                 LEFT JOIN tlong c ON c.series_id = t.series_id AND c.date = CAST(t.date - TO_YEARS((YEAR(t.date) - 1997)::INT) AS DATE)
                 LEFT JOIN (SELECT series_id, MONTH(date) AS m, ISODOW(date) AS d, AVG(value) AS v FROM tlong WHERE date <= DATE '1999-12-31' GROUP BY ALL) md ON md.series_id = t.series_id AND md.m = MONTH(t.date) AND md.d = ISODOW(t.date)
                 LEFT JOIN (SELECT series_id, MONTH(date) AS m, AVG(value) AS v FROM tlong WHERE date <= DATE '1999-12-31' GROUP BY ALL) mm ON mm.series_id = t.series_id AND mm.m = MONTH(t.date)))),
           (VALUES ('seasonal'), ('conservative'), ('high_demand')) u(scenario)""",
)


def traffic_long(s):
    t = dense_traffic(s)
    cells = F.array(*[F.struct(F.lit(m).alias("series_id"), F.col(x).cast("double").alias("value")) for m, x in METRICS.items()])
    return t.select("date", F.inline(cells))


def scenarios(s):
    t = traffic_long(s)
    past = t.where("date <= date'1999-12-31'")
    promo = pr.promo_calendar(active_days(s), s.spine()).select("date", (F.col("active_promo_count") > 3).cast("int").alias("any_promo"))
    ahead = t.where("date > date'1999-12-31'").select("series_id", "date").join(promo, "date")
    p80 = past.where("series_id = 'sessions'").agg(F.percentile("value", F.lit(0.8))).scalar()
    return ft.traffic_scenarios(past, ahead, [(1999, 0.5), (1998, 0.3), (1997, 0.2)], F.lit(1.1), p80)


@query("traffic_scenarios", "series_id:s date:d scenario:s value:4", sql("tscen", "SELECT * FROM tscen"))
def traffic_scenarios(s):
    return scenarios(s)


@query(
    "scenario_features",
    "scenario:s date:d sessions_lag_1:4 sessions_lag_7:4 sessions_roll_mean_7:4",
    sql(
        "tscen tlong",
        """SELECT * FROM (SELECT scenario, date, LAG(value, 1) OVER w AS sessions_lag_1, LAG(value, 7) OVER w AS sessions_lag_7, AVG(value) OVER (PARTITION BY scenario ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS sessions_roll_mean_7
           FROM (SELECT scenario, date, value FROM tscen WHERE series_id = 'sessions' UNION ALL SELECT u.scenario, date, value FROM tlong, (VALUES ('seasonal'), ('conservative'), ('high_demand')) u(scenario) WHERE series_id = 'sessions' AND date <= DATE '1999-12-31')
           WINDOW w AS (PARTITION BY scenario ORDER BY date)) WHERE date > DATE '1999-12-31'""",
    ),
)
def scenario_features(s):
    """History followed by each scenario; look-backs never cross scenarios."""
    past = traffic_long(s).where("date <= date'1999-12-31' and series_id = 'sessions'")
    ahead = scenarios(s).where("series_id = 'sessions'")
    both = ft.continue_history(past, ahead, ["scenario"])
    rows = both.select("scenario", "date", "is_future", win.lag("value", 1, "scenario").alias("sessions_lag_1"), win.lag("value", 7, "scenario").alias("sessions_lag_7"), win.roll_mean("value", 7, "scenario").alias("sessions_roll_mean_7"))
    return rows.where("is_future = 1")
