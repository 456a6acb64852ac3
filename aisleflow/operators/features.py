"""Feature blocks for daily forecasting.

Every block is one set of column expressions over windows that end the day before, so the
same function serves training rows (history) and scoring rows (history followed by supplied
forecasts). Flags are NULL while an input is unknown, in both uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.functions.scalars import clip, div_eps, flag_gt, seasonal_phase
from aisleflow.operators import windows as win

# Look-backs, windows and levels of the feature blocks.
LAGS = [7, 14, 30, 60, 90, 180, 365]
MEANS = [7, 14, 30, 60, 90, 180, 365]
STDS = [30, 90, 365]
HIGH_ERROR_MONTHS = [2, 3, 5, 8]
SPIKE_FACTOR = 1.25
EPS = 1e-6


def c(name: str) -> Column:
    return F.col(name)


def product(*names: str) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out * F.col(n)
    return out.alias("_x_".join(names))


def revenue_history(df: DataFrame, col: str = "revenue", key: str = "series_id") -> DataFrame:
    """Seventeen look-back columns from one sort per series."""
    return df.select(
        "*", *win.lag_columns([col], LAGS, key), *win.roll_mean_columns([col], MEANS, key), *win.roll_std_columns([col], STDS, key)
    )


def spike_v1(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Relative volatility, look-back ratios, 1.25x spike flags and calendar interactions. ``df``
    carries revenue_history and the calendar columns."""
    lag, mean, std = "revenue_lag_{}", "revenue_roll_mean_{}", "revenue_roll_std_{}"
    ratios = {
        "lag7_to_roll30_ratio": (7, 30), "lag14_to_roll30_ratio": (14, 30), "lag30_to_roll90_ratio": (30, 90),
        "lag365_to_roll365_ratio": (365, 365), "lag365_to_roll30_ratio": (365, 30),
    }
    spikes = {"lag7_spike_flag": (7, 30), "lag30_spike_flag": (30, 90), "lag365_spike_flag": (365, 365)}
    d = df.select(
        "*",
        *[div_eps(std.format(w), mean.format(w)).alias(f"rel_volatility_{w}") for w in STDS],
        *[div_eps(lag.format(k), mean.format(w)).alias(n) for n, (k, w) in ratios.items()],
        *[flag_gt(c(lag.format(k)), c(mean.format(w)) * SPIKE_FACTOR).alias(n) for n, (k, w) in spikes.items()],
        c("month").isin(HIGH_ERROR_MONTHS).cast("int").alias("is_high_error_month"),
    )
    # compared to ten digits: a volatility equal to its median must not count as high by rounding noise
    d = win.past_quantiles(d, "rel_volatility_30", [0.5], "_median", key)
    d = d.withColumn("recent_volatility_high", flag_gt(F.round("rel_volatility_30", 10), F.round(F.get("_median", F.lit(0)), 10))).drop("_median")
    return d.select(
        "*",
        product("revenue_lag_365", "month"), product("revenue_lag_365", "day_of_week"), product("revenue_lag_365", "day_of_year"),
        product("revenue_lag_7", "day_of_week"), product("revenue_lag_365", "is_high_error_month"), product("revenue_roll_mean_7", "is_high_error_month"),
    )


def past_quantiles(df: DataFrame, key: str = "series_id", col: str = "revenue") -> DataFrame:
    return win.past_quantiles(df, col, [0.80, 0.90, 0.95], "_q", key).select(*df.columns, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("past_p80", "past_p90", "past_p95"))])


def spike_v2(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Standardised strengths, exceedance of past quantiles, momentum and promotion interactions."""
    def z(k, w):
        return ((c(f"revenue_lag_{k}") - c(f"revenue_roll_mean_{w}")) / (c(f"revenue_roll_std_{w}") + EPS)).alias(f"z_{k}_{w}")

    above = [(7, 80), (7, 90), (7, 95), (30, 80), (30, 90), (365, 80), (365, 90), (365, 95)]
    d = past_quantiles(df, key).select(
        "*", z(7, 30), z(14, 30), z(30, 90), z(365, 365),
        *[flag_gt(f"revenue_lag_{k}", f"past_p{q}").alias(f"lag{k}_above_p{q}") for k, q in above],
        (c("revenue_lag_7") - c("revenue_lag_30")).alias("momentum_7_30"),
        (c("revenue_lag_14") - c("revenue_lag_60")).alias("momentum_14_60"),
        (c("revenue_lag_30") - c("revenue_lag_90")).alias("momentum_30_90"),
        (c("revenue_lag_7") / (c("revenue_lag_30") + EPS)).alias("momentum_ratio_7_30"),
    )
    return d.select(
        "*",
        product("z_365_365", "month"), product("z_365_365", "day_of_year"), product("lag365_above_p90", "month"), product("lag365_above_p90", "day_of_week"),
        product("any_promo", "lag365_above_p90"), product("avg_discount_value", "z_365_365"), product("active_promo_count", "z_365_365"),
    )


def deep_features(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Short look-backs, growth ratios, promotion pressure and urgency, phase and interactions."""
    sin, cos = seasonal_phase("date")
    d = past_quantiles(df, key).select(
        "*", win.lag("revenue", 1, key).alias("revenue_lag_1"), win.lag("revenue", 3, key).alias("revenue_lag_3"),
        win.roll_std("revenue", 7, key).alias("revenue_roll_std_7"), sin.alias("phase_sin"), cos.alias("phase_cos"),
    )
    d = d.select(
        "*",
        div_eps("revenue_lag_1", "revenue_lag_7").alias("growth_1_7"), div_eps("revenue_lag_7", "revenue_roll_mean_30").alias("growth_7_30"),
        div_eps("revenue_lag_30", "revenue_roll_mean_90").alias("growth_30_90"), (c("revenue_lag_3") - c("revenue_lag_7")).alias("short_trend"),
        div_eps("revenue_roll_std_7", "revenue_roll_std_30").alias("volatility_ratio_7_30"),
        (c("revenue_lag_365") >= c("past_p90")).cast("int").alias("lag365_reaches_p90"),
        (c("revenue_lag_365") >= c("past_p95")).cast("int").alias("lag365_reaches_p95"),
        div_eps("revenue_lag_365", "revenue_roll_mean_365").alias("lag365_strength"),
        (c("avg_discount_value") * c("active_promo_count")).alias("discount_intensity"),
        (c("promo_progress_ratio") * c("avg_discount_value")).alias("promo_pressure"),
        F.when(c("any_promo") > 0, 1.0 / (F.coalesce("promo_days_remaining", F.lit(0.0)) + 1.0)).otherwise(0.0).alias("promo_urgency"),
    )
    pairs = [
        ("revenue_lag_365", "avg_discount_value"), ("revenue_lag_365", "any_promo"), ("growth_7_30", "any_promo"), ("growth_1_7", "avg_discount_value"),
        ("revenue_roll_std_30", "any_promo"), ("day_of_year", "any_promo"), ("phase_sin", "avg_discount_value"), ("lag365_reaches_p90", "any_promo"),
        ("lag365_strength", "avg_discount_value"),
    ]
    return d.select("*", *[product(*p) for p in pairs])


def safe_features(df: DataFrame, campaigns: Sequence[str], key: str = "series_id") -> DataFrame:
    """Trend ratios, campaign memory and promotion phases."""
    on, p = c("any_promo") > 0, c("promo_progress_ratio")
    sin, cos = seasonal_phase("date")
    d = past_quantiles(df, key).select(
        "*",
        *[div_eps(f"revenue_roll_mean_{a}", f"revenue_roll_mean_{b}").alias(f"trend_{a}_{b}") for a, b in ((7, 30), (30, 90), (90, 365))],
        div_eps("revenue_roll_std_30", "revenue_roll_std_90").alias("volatility_ratio_30_90"),
        div_eps("revenue_lag_365", "revenue_roll_mean_365").alias("lag365_strength"),
        (c("revenue_lag_365") >= c("past_p90")).cast("int").alias("lag365_reaches_p90"),
        (c("revenue_lag_365") >= c("past_p95")).cast("int").alias("lag365_reaches_p95"),
        (c("revenue_lag_365") * F.greatest(*campaigns)).alias("same_campaign_last_year"),
        *[(c("revenue_lag_365") * c(x)).alias(f"memory_{x}") for x in campaigns],
        F.coalesce(on & (p < 0.3), F.lit(False)).cast("int").alias("is_early_phase"),
        F.coalesce(on & (p >= 0.3) & (p <= 0.7), F.lit(False)).cast("int").alias("is_peak_phase"),
        F.coalesce(on & (p > 0.7), F.lit(False)).cast("int").alias("is_late_phase"),
        sin.alias("phase_sin"), cos.alias("phase_cos"),
    )
    active = F.when(c("active_promo_count") != 0, c("active_promo_count"))
    d = d.select(
        "*", div_eps(c("same_campaign_last_year"), active).alias("avg_campaign_last_year"),
        div_eps("same_campaign_last_year", "revenue_roll_mean_365").alias("campaign_strength_index"),
    )
    pairs = [("trend_30_90", "any_promo"), ("lag365_strength", "avg_discount_value"), ("phase_sin", "avg_discount_value"), ("revenue_roll_std_30", "any_promo")]
    return d.select("*", *[product(*x) for x in pairs])


def metric_history(df: DataFrame, col: str, prefix: str, lags: Sequence[int], widths: Sequence[int], key: str = "series_id") -> DataFrame:
    """Look-backs of one driver (orders, conversion, order value) with ratio, volatility, momentum."""
    d = df.select(
        "*", *[win.lag(col, k, key).alias(f"{prefix}_lag_{k}") for k in lags], *[win.roll_mean(col, w, key).alias(f"{prefix}_roll_mean_{w}") for w in widths],
        win.roll_std(col, 30, key).alias("_std"),
    )
    return d.select(
        *[x for x in d.columns if x != "_std"], div_eps(f"{prefix}_lag_7", f"{prefix}_roll_mean_30").alias(f"{prefix}_lag7_to_roll30"),
        div_eps("_std", f"{prefix}_roll_mean_30").alias(f"{prefix}_volatility_30"), (c(f"{prefix}_lag_7") - c(f"{prefix}_lag_30")).alias(f"{prefix}_momentum"),
    )


def traffic_history(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Sessions look-backs and engagement for the orders model; needs sessions and duration."""
    d = df.select(
        "*", win.lag("web_sessions", 1, key).alias("web_sessions_lag_1"), win.lag("web_sessions", 7, key).alias("web_sessions_lag_7"),
        win.roll_mean("web_sessions", 7, key).alias("web_sessions_roll_mean_7"), win.roll_mean("web_sessions", 30, key).alias("web_sessions_roll_mean_30"),
    )
    return d.select(
        "*", div_eps("web_sessions_lag_1", "web_sessions_roll_mean_30").alias("web_sessions_to_roll_ratio"),
        (div_eps("web_sessions_lag_1", "web_sessions_lag_7") - 1).alias("web_sessions_growth"),
    )


def promo_interactions(df: DataFrame, campaigns: Sequence[str]) -> DataFrame:
    return df.select(
        "*", product("revenue_lag_365", "avg_discount_value"), product("revenue_lag_365", "any_promo"), product("revenue_roll_mean_30", "any_promo"),
        *[product("day_of_year", x) for x in campaigns],
    )


def union_features(df: DataFrame) -> DataFrame:
    """Cross-domain interactions; a missing driver counts as 0, missing growth as 1."""
    def z(name, default=0.0):
        return F.coalesce(c(name).cast("double"), F.lit(default))

    growth = z("sessions_growth_3_14", 1.0)
    return df.select(
        "*",
        (z("orders_same_day_mean") * clip(growth, 0.6, 1.6)).alias("predicted_orders_signal"),
        (z("stock_pressure") * z("any_promo")).alias("stock_pressure_x_promo"),
        (z("stock_pressure") * z("revenue_lag_365")).alias("stock_pressure_x_lag365"),
        (z("revenue_lag_365") * z("campaign_intensity")).alias("lag365_x_campaign_intensity"),
        (z("revenue_lag_365") * growth).alias("lag365_x_sessions_growth"),
        (z("aov_lag_365") * z("avg_discount_value")).alias("aov_lag365_x_discount"),
        (z("orders_lag_365") * growth).alias("orders_lag365_x_sessions_growth"),
        (z("stock_pressure") * z("campaign_intensity")).alias("stock_pressure_x_campaign_intensity"),
    )


def predicted_orders_features(df: DataFrame, col: str = "predicted_orders") -> DataFrame:
    return df.select(
        "*", F.log1p(clip(col, lo=0)).alias(f"{col}_log1p"), product(col, "avg_discount_value"), product(col, "any_promo"), product(col, "day_of_week")
    )


def orders_signal(df: DataFrame, high: Column, col: str = "predicted_orders", key: str = "series_id") -> DataFrame:
    """Spike, momentum and level flags of predicted orders."""
    lag1, lag7 = win.lag(col, 1, key), win.lag(col, 7, key)
    return df.select(
        "*", flag_gt(lag7, win.roll_mean(col, 30, key) * 1.2).alias("orders_spike_flag"), flag_gt(lag1, lag7).alias("orders_momentum_flag"),
        flag_gt(lag7, high).alias("orders_high_flag"),
    )


def base_pred_features(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Describe a base forecast: log, percent rank, intensity, component differences, scale target."""
    d = df.withColumn("base_pred_rank_pct", win.rank_pct("base_pred", key))
    return d.select(
        "*", F.log1p(F.greatest("base_pred", F.lit(0.0))).alias("log_base_pred"), (c("avg_discount_value") * c("active_promo_count")).alias("promo_intensity"),
        F.month("date").isin(HIGH_ERROR_MONTHS).cast("int").alias("is_high_risk_month"),
        (c("spike_pred") - c("level_pred")).alias("spike_minus_level"), (c("base_pred") / (c("spike_pred") + EPS)).alias("base_over_spike"),
        F.try_divide(c("actual"), c("base_pred")).alias("scale_target_raw"),
    )


# Weights of promotion phase, campaign and memory in the scaling context.
PHASE_WEIGHTS = {"peak": 0.20, "last7": 0.10, "first7": 0.05}
CAMPAIGN_WEIGHT, MEMORY_WEIGHT = 0.15, 0.20


def scaling_context(df: DataFrame, intensity_scale: Column, strengths: dict[str, Column]) -> DataFrame:
    """Normalised promotion intensity with phase and campaign, memory signal, effective probability."""
    on = clip("any_promo", 0, 1)
    p, left, day = c("promo_progress_ratio"), c("promo_days_remaining"), c("promo_day_number")
    d = df.select(
        "*",
        F.month("date").isin(HIGH_ERROR_MONTHS).cast("int").alias("is_high_risk_month"),
        ((day > 0) & (day <= 7)).cast("int").alias("first7"), ((left >= 0) & (left <= 6) & (on > 0)).cast("int").alias("last7"),
        ((p >= 0.3) & (p <= 0.7) & (on > 0)).cast("int").alias("peak"),
        clip(sum((clip(c(x), 0, 1) * s for x, s in strengths.items()), F.lit(0.0)), 0, 1.5).alias("campaign_signal"),
        clip(c("avg_discount_value") * c("active_promo_count") / F.greatest(intensity_scale, F.lit(EPS)), 0, 1).alias("_norm"),
        F.greatest(F.coalesce("lag365_above_p90", F.lit(0)), F.coalesce("lag365_above_p95", F.lit(0)), F.coalesce(clip(c("lag365_strength") - 1, 0, 1), F.lit(0.0))).alias("memory_signal"),
    )
    phase = sum((F.lit(w) * c(n) for n, w in PHASE_WEIGHTS.items()), F.lit(1.0))
    norm = clip(c("_norm") * phase * (1 + CAMPAIGN_WEIGHT * c("campaign_signal")), 0, 1.5)
    return d.select(
        *[x for x in d.columns if x != "_norm"], norm.alias("normalized_promo_intensity"),
        clip(clip("spike_prob", 0, 1) * (1 + MEMORY_WEIGHT * c("memory_signal")), 0, 1).alias("effective_prob"),
    )


def classifier_table(df: DataFrame) -> DataFrame:
    return df.select(
        "*", product("any_promo", "revenue_lag_365"), product("avg_discount_value", "revenue_lag_365"), product("any_promo", "lag7_to_roll30_ratio"), product("campaign_index", "day_of_year")
    )


def continue_history(history: DataFrame, future: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """History followed by supplied future rows, marked by is_future. With ``by`` the history is
    repeated for every scenario of ``future`` through an equi join on the series."""
    h = history.withColumn("is_future", F.lit(0))
    if by:
        h = h.join(future.select("series_id", *by).distinct(), "series_id")
    return h.unionByName(future.withColumn("is_future", F.lit(1)))


def features_over_forecast(history: DataFrame, forecast: DataFrame, block) -> DataFrame:
    """Feature rows for forecast dates, with earlier forecasts standing in for actuals."""
    return block(continue_history(history, forecast)).where("is_future = 1").drop("is_future")


def volatility_threshold(df: DataFrame, key: str = "series_id", col: str = "revenue") -> DataFrame:
    """Median relative 30-day volatility per series."""
    v = df.select(key, div_eps(win.roll_std(col, 30, key), win.roll_mean(col, 30, key)).alias("v"))
    return v.groupBy(key).agg(F.coalesce(F.median("v"), F.lit(0.0)).alias("volatility_threshold"))


def threshold_bundle(df: DataFrame, col: str = "revenue", key: str = "series_id") -> DataFrame:
    q = F.percentile(F.col(col), F.array(F.lit(0.8), F.lit(0.9), F.lit(0.95)))
    t = df.groupBy(key).agg(q.alias("_q")).select(key, *[F.col("_q")[i].alias(n) for i, n in enumerate(("p80", "p90", "p95"))])
    return t.join(volatility_threshold(df, key, col), key)


def traffic_scenarios(history: DataFrame, targets: DataFrame, anchors: Sequence[tuple[int, float]], uplift: Column, high: Column) -> DataFrame:
    """Three scenarios per metric in long form. ``history`` and ``targets`` are (series_id = metric,
    date[, value]); ``targets`` also carries any_promo."""
    h = history.select("series_id", "date", "value")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.add_months("date", (F.lit(y) - F.year("date")) * 12).alias("_ref")) for i, (y, w) in enumerate(anchors)])
    asked = targets.select("series_id", "date", F.inline(pairs))
    hit = asked.join(h.withColumnRenamed("date", "_ref"), ["series_id", "_ref"])
    exact = hit.groupBy("series_id", "date").agg((F.sum(c("w") * c("value")) / F.sum("w")).alias("_exact"), F.max(F.when(c("i") == 0, c("value"))).alias("_last"))
    m, dow = F.month("date").alias("_m"), F.weekday("date").alias("_dow")
    by_dow = h.groupBy("series_id", m, dow).agg(F.avg("value").alias("_md"))
    by_month = h.groupBy("series_id", m).agg(F.avg("value").alias("_mm"))
    t = targets.select("series_id", "date", "any_promo", m, dow).join(exact, ["series_id", "date"], "left").join(by_dow, ["series_id", "_m", "_dow"], "left").join(by_month, ["series_id", "_m"], "left")
    back = F.coalesce("_md", "_mm", F.lit(0.0))
    volume = c("series_id") != "bounce"
    lifted = F.greatest(F.lit(0.0), F.coalesce("_exact", back)) * F.when((c("any_promo") > 0) & volume, uplift).otherwise(1.0)
    t = t.select("series_id", "date", "any_promo", lifted.alias("_raw"), F.greatest(F.lit(0.0), F.coalesce("_last", back)).alias("_conservative"))
    t = t.withColumn("_seasonal", F.when(volume, win.smooth("_raw", 7)).otherwise(c("_raw")))
    sessions = F.max(F.when(c("series_id") == "sessions", c("_seasonal"))).over(Window.partitionBy("date"))
    busy = sessions >= high
    mask = F.month("date").isin(HIGH_ERROR_MONTHS) | (c("any_promo") > 0) | busy
    factor = F.when(volume & mask, 1.05).otherwise(1.0) * F.when(volume & busy, 1.08).otherwise(1.0)
    out = [F.struct(F.lit(n).alias("scenario"), e.alias("value")) for n, e in (("seasonal", c("_seasonal")), ("conservative", c("_conservative")), ("high_demand", c("_seasonal") * factor))]
    return t.withColumn("_o", F.array(*out)).select("series_id", "date", F.inline("_o"))
