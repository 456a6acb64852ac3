"""Seasonal references and traffic features: what was known about the same season before.

Lookups per row become equi joins on calendar keys (date shifted by whole years, year and
month, day of week); several look-backs of the same kind share one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.functions.scalars import clip, div_fill, div_null, row_mean, weighted_avg
from aisleflow.operators import windows as win
from aisleflow.operators.quality import safe_corr
from aisleflow.operators.joins import same_day_recent_mean, same_month_recent_mean

# Weights of one, two and three years back, and of the seasonal baseline.
YEAR_WEIGHTS = [(1, 0.5), (2, 0.3), (3, 0.2)]
BASELINE_WEIGHTS = [0.50, 0.20, 0.15, 0.10, 0.05]
SPIKE_LEVELS = {"125": 1.25, "150": 1.50}


def year_references(df: DataFrame, history: DataFrame, value: str, prefix: str, key: str = "series_id", guarded: bool = False, backs: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Value on the same date 1..3 years back. One join: each history day is sent forward to the
    dates it serves (28 Feb also serves 29 Feb), then gathered per target date."""
    h = history.select(key, F.col("date").alias("_ref"), F.col(value).alias("_v"))
    spread = F.array(*[F.struct(F.lit(k).alias("k"), F.add_months("date", -12 * k).alias("_ref")) for k in backs])
    need = [key, "date"] + (["reference_end"] if guarded else [])
    asked = df.select(*need).distinct().select(*need, F.inline(spread))
    hit = asked.join(h, [key, "_ref"], "left")
    if guarded:
        hit = hit.withColumn("_v", F.when(F.col("_ref") <= F.col("reference_end"), F.col("_v")))
    names = {k: f"{prefix}_{k}y" for k in backs}
    wide = hit.groupBy(*need).agg(*[F.max(F.when(F.col("k") == k, F.col("_v"))).alias(n) for k, n in names.items()])
    return df.join(wide, need, "left")


def year_month_reference(df: DataFrame, history: DataFrame, value: str, out: str, key: str = "series_id", extra: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of the same month (and e.g. weekday) of the three preceding years."""
    h = history.groupBy(key, F.year("date").alias("_y"), F.month("date").alias("_m"), *extra).agg(F.avg(value).alias("_v"))
    pairs = F.array(*[F.struct((F.year("date") - k).alias("_y"), F.lit(w).alias("_w")) for k, w in YEAR_WEIGHTS])
    asked = df.select(key, "date", *extra).distinct().select(key, "date", *extra, F.month("date").alias("_m"), F.inline(pairs))
    hit = asked.join(h.where("_v is not null"), [key, "_y", "_m", *extra], "inner")
    mean = hit.groupBy(key, "date").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(out))
    return df.join(mean, [key, "date"], "left")


def series_reference(df: DataFrame, history: DataFrame, value: str, prefix: str, key: str = "series_id") -> DataFrame:
    """Yearly look-backs, their weighted mean, the weighted same-month mean and a ratio."""
    out = year_references(df, history, value, prefix, key)
    out = out.withColumn(f"{prefix}_same_day_mean", weighted_avg([(w, f"{prefix}_{k}y") for k, w in YEAR_WEIGHTS]))
    out = year_month_reference(out, history, value, f"{prefix}_same_month_mean", key)
    return out.withColumn(f"{prefix}_1y_to_mean", div_null(f"{prefix}_1y", f"{prefix}_same_day_mean"))


def dow_month_reference(df: DataFrame, history: DataFrame, value: str, out: str, key: str = "series_id") -> DataFrame:
    """Weighted mean of same month and weekday over three years, else the all-years mean."""
    t = df.withColumn("_dow", F.weekday("date"))
    h = history.withColumn("_dow", F.weekday("date"))
    t = year_month_reference(t, h, value, "_weighted", key, ["_dow"])
    back = h.groupBy(key, F.month("date").alias("_m"), "_dow").agg(F.avg(value).alias("_back"))
    t = t.withColumn("_m", F.month("date")).join(back, [key, "_m", "_dow"], "left")
    return t.withColumn(out, F.coalesce("_weighted", "_back")).drop("_weighted", "_back", "_m", "_dow")


def seasonal_lookup(targets: DataFrame, history: DataFrame, value: str, out: str, years: int = 1, key: str = "series_id") -> DataFrame:
    """Exact date ``years`` back, else the (month, weekday) mean, else the month mean, else 0."""
    t = year_references(targets, history, value, "_exact", key, backs=[years])
    h = history.withColumn("_m", F.month("date")).withColumn("_dow", F.weekday("date"))
    by_dow = h.groupBy(key, "_m", "_dow").agg(F.avg(value).alias("_md"))
    by_month = h.groupBy(key, "_m").agg(F.avg(value).alias("_mm"))
    t = t.withColumn("_m", F.month("date")).withColumn("_dow", F.weekday("date"))
    t = t.join(by_dow, [key, "_m", "_dow"], "left").join(by_month, [key, "_m"], "left")
    picked = F.coalesce(f"_exact_{years}y", "_md", "_mm", F.lit(0.0))
    return t.withColumn(out, picked).drop(f"_exact_{years}y", "_md", "_mm", "_m", "_dow")


def business_lag_lookup(targets: DataFrame, history: DataFrame, value: str, out: str, anchor_year: int, key: str = "series_id") -> DataFrame:
    """365 days back, else the same date of ``anchor_year``, else the mean of the last three values on
    that day of year, else the mean of the last 365 values."""
    h = history.where(F.col(value).isNotNull()).select(key, "date", F.col(value).alias("_v"))
    t = targets.withColumn("_d", F.date_sub("date", 365)).join(h.select(key, F.col("date").alias("_d"), F.col("_v").alias("_lag")), [key, "_d"], "left").drop("_d")
    t = t.withColumn("_d", F.add_months("date", (F.lit(anchor_year) - F.year("date")) * 12))
    t = t.join(h.select(key, F.col("date").alias("_d"), F.col("_v").alias("_anchor")), [key, "_d"], "left").drop("_d")
    newest = Window.partitionBy(key, "_doy").orderBy(F.desc("date"))
    doy = h.withColumn("_doy", F.dayofyear("date")).withColumn("_rn", F.row_number().over(newest)).where("_rn <= 3")
    doy = doy.groupBy(key, "_doy").agg(F.avg("_v").alias("_doy_mean"))
    recent = win.tail(h, 365, key).groupBy(key).agg(F.avg("_v").alias("_recent"))
    t = t.withColumn("_doy", F.dayofyear("date")).join(doy, [key, "_doy"], "left").join(recent, key, "left")
    return t.withColumn(out, F.coalesce("_lag", "_anchor", "_doy_mean", "_recent", F.lit(0.0))).drop("_lag", "_anchor", "_doy_mean", "_recent", "_doy")


def same_campaign_reference(df: DataFrame, history: DataFrame, flags: DataFrame, value: str, out: str, columns: Sequence[str], key: str = "series_id") -> DataFrame:
    """Last year's value when one of the campaigns active now was also active then. ``df`` needs
    reference_end."""
    now = flags.select("date", F.array(*columns).alias("_now"))
    then = flags.select(F.col("date").alias("_ref"), F.array(*columns).alias("_then"))
    t = df.withColumn("_ref", F.add_months("date", -12)).join(now, "date", "left").join(then, "_ref", "left")
    t = t.join(history.select(key, F.col("date").alias("_ref"), F.col(value).alias("_v")), [key, "_ref"], "left")
    shared = F.exists(F.zip_with("_now", "_then", lambda a, b: F.least(a, b)), lambda x: x > 0)
    known = (F.col("_ref") <= F.col("reference_end")) & shared
    return t.withColumn(out, F.when(known, F.col("_v"))).drop("_ref", "_now", "_then", "_v")


def seasonal_reference(targets: DataFrame, history: DataFrame, value: str, flags: DataFrame, columns: Sequence[str], key: str = "series_id") -> DataFrame:
    """The long-horizon block: yearly look-backs, pooled month and day-of-year means, same campaign
    and the weighted baseline. Only data up to each row's reference_end is read."""
    t = year_references(targets, history, value, "lag", key, guarded=True)
    t = t.withColumn("weighted_recent", weighted_avg([(w, f"lag_{k}y") for k, w in YEAR_WEIGHTS]))
    t = same_month_recent_mean(t, history, value, "same_month_mean", key)
    t = same_day_recent_mean(t, history, value, "same_day_mean", key)
    t = same_campaign_reference(t, history, flags, value, "same_campaign", columns, key)
    parts = ["weighted_recent", "same_day_mean", "same_month_mean", "lag_1y", "same_campaign"]
    return t.select(
        "*",
        weighted_avg(list(zip(BASELINE_WEIGHTS, parts))).alias("baseline"),
        div_null("lag_1y", "lag_2y").alias("lag1_to_lag2"),
        div_null("lag_1y", "same_day_mean").alias("lag1_to_same_day"),
    )


def traffic_features(wide: DataFrame, sources: Sequence[str], key: str = "series_id") -> DataFrame:
    """Lags, rolling means, growth and spikes of traffic; a spike is NULL while growth is unknown."""
    def lag(c, k):
        return win.lag(c, k, key)

    base = wide.select(
        key, "date",
        *[lag("sessions_sum", k).alias(f"sessions_lag_{k}") for k in (1, 2, 3, 7, 14)],
        *[lag(f"{c}_sum", k).alias(f"{c}_lag_{k}") for c in ("unique_visitors", "page_views") for k in (1, 2, 3, 7)],
        lag("avg_bounce_rate", 1).alias("bounce_rate_lag_1"), lag("avg_session_duration_sec", 1).alias("duration_lag_1"),
        lag("source_diversity_count", 1).alias("source_diversity_lag_1"),
        *[win.roll_mean("sessions_sum", w, key).alias(f"sessions_roll_mean_{w}") for w in (3, 7, 14, 30)],
        *[win.roll_std("sessions_sum", w, key).alias(f"sessions_roll_std_{w}") for w in (7, 30)],
        win.roll_mean("page_views_sum", 7, key).alias("page_views_roll_mean_7"),
        win.roll_mean("unique_visitors_sum", 7, key).alias("unique_visitors_roll_mean_7"),
        *[lag(f"{v}_sessions", k).alias(f"{v}_sessions_lag_{k}") for v in sources for k in (1, 7)],
        *[win.roll_mean(f"{v}_sessions", 7, key).alias(f"{v}_sessions_roll_mean_7") for v in sources],
    )
    growth = F.try_divide(F.col("sessions_lag_1"), F.col("sessions_roll_mean_7"))
    g = base.select(
        "*", growth.alias("sessions_growth_1_7"),
        F.try_divide(row_mean([f"sessions_lag_{k}" for k in (1, 2, 3)]), F.col("sessions_roll_mean_14")).alias("sessions_growth_3_14"),
        (F.col("sessions_lag_1") - F.col("sessions_lag_3")).alias("traffic_acceleration"),
        F.try_divide(F.col("page_views_lag_1"), F.col("sessions_lag_1")).alias("pageview_per_session_lag_1"),
        F.try_divide(F.col("unique_visitors_lag_1"), F.col("sessions_lag_1")).alias("visitor_to_session_lag_1"),
        F.try_divide(F.col("page_views_lag_1") * F.col("duration_lag_1"), F.col("bounce_rate_lag_1")).alias("engagement_index"),
    )
    return g.select("*", *[(F.col("sessions_growth_1_7") > lvl).cast("int").alias(f"traffic_spike_{n}") for n, lvl in SPIKE_LEVELS.items()])


def lead_lag_corr(df: DataFrame, horizons: Sequence[int], key: str = "series_id") -> DataFrame:
    """Correlation of today's traffic growth and spikes with revenue and revenue spikes h days on."""
    p90 = df.groupBy(key).agg(F.percentile("revenue", F.lit(0.9)).alias("_p90"))
    d = df.join(p90, key).withColumn("_spike", (F.col("revenue") >= F.col("_p90")).cast("double"))
    w = Window.partitionBy(key).orderBy("date")
    moved = d.select(
        "sessions_growth_1_7", F.col("traffic_spike_125").cast("double").alias("s125"), F.col("traffic_spike_150").cast("double").alias("s150"),
        F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.lead("revenue", h).over(w).alias("y"), F.lead("_spike", h).over(w).alias("ys")) for h in horizons]).alias("_h"),
    )
    long = moved.select("sessions_growth_1_7", "s125", "s150", F.inline("_h"))

    def corr(a, b):
        return safe_corr(F.col(a), F.col(b))

    return long.groupBy("horizon_days").agg(
        corr("sessions_growth_1_7", "y").alias("corr_growth_revenue"), corr("s125", "ys").alias("corr_spike125_spike"), corr("s150", "ys").alias("corr_spike150_spike")
    )


def promo_uplift(daily: DataFrame, value: str, key: str = "series_id", default: float = 1.05) -> DataFrame:
    """Median ratio of promotion days to the mean of the same date on promotion-free days of the three
    preceding years, clipped to [1, 1.25]; one row per series."""
    md = [F.month("date").alias("_m"), F.dayofmonth("date").alias("_dd")]
    free = daily.where("any_promo = 0").select(key, F.year("date").alias("_y"), *md, F.col(value).alias("_v"))
    years = F.array(*[F.year("date") - k for k in (1, 2, 3)])
    on = daily.where("any_promo > 0").select(key, "date", F.col(value).alias("_now"), *md, F.explode(years).alias("_y"))
    base = on.join(free, [key, "_y", "_m", "_dd"]).groupBy(key, "date", "_now").agg(F.avg("_v").alias("_base"))
    ratio = base.where("_base > 1e-9").groupBy(key).agg(F.median(F.col("_now") / F.col("_base")).alias("_r"))
    keys = daily.select(key).distinct()
    return keys.join(ratio, key, "left").select(key, F.coalesce(clip("_r", 1.0, 1.25), F.lit(default)).alias("uplift"))


def robust_baseline(history: DataFrame, targets: DataFrame, value: str, campaigns: Sequence[str], key: str = "series_id") -> DataFrame:
    """Median of the first active campaign, else of (month, promotion flag), else of the last year."""
    h = history.withColumn("_m", F.month("date"))
    month = h.groupBy(key, "_m", (F.col("any_promo") > 0).alias("_p")).agg(F.median(value).alias("_month"))
    per_campaign = h.groupBy(key).agg(*[F.percentile(F.when(F.col(c) > 0, F.col(value)), F.lit(0.5)).alias(f"_c_{c}") for c in campaigns])
    recent = win.tail(h, 365, key).groupBy(key).agg(F.median(value).alias("_recent"))
    t = targets.withColumn("_m", F.month("date")).withColumn("_p", F.col("any_promo") > 0)
    t = t.join(month, [key, "_m", "_p"], "left").join(per_campaign, key, "left").join(recent, key, "left")
    by_campaign = [F.when(F.col(c) > 0, F.col(f"_c_{c}")) for c in campaigns]
    out = clip(F.coalesce(*by_campaign, "_month", "_recent"), lo=0)
    return t.select(*targets.columns, out.alias("baseline"))


def web_reference(targets: DataFrame, web: DataFrame, key: str = "series_id") -> DataFrame:
    """Sessions and page views on the same date 1..3 years back and the mean of sessions."""
    t = year_references(targets, web, "sessions_sum", "web_sessions", key, guarded=True)
    t = year_references(t, web, "page_views_sum", "web_page_views", key, guarded=True)
    return t.withColumn("web_sessions_recent_mean", row_mean([f"web_sessions_{k}y" for k in (1, 2, 3)]))


def cogs_ratio_recent(daily: DataFrame, n: int = 365, key: str = "series_id", start: Column | None = None) -> DataFrame:
    """COGS / revenue over the last ``n`` days (or since ``start``), else all history, in [0, 2]."""
    window = win.tail(daily, n, key) if start is None else daily.where(F.col("date") >= start)
    r = window.groupBy(key).agg(F.try_divide(F.sum("cogs"), F.sum("revenue")).alias("_recent"))
    a = daily.groupBy(key).agg(F.try_divide(F.sum("cogs"), F.sum("revenue")).alias("_all"))
    picked = F.when(F.col("_recent") > 0, F.col("_recent")).otherwise(F.col("_all"))
    return a.join(r, key, "left").select(key, clip(picked, 0.0, 2.0).alias("cogs_ratio"))


def cogs_ratio_by_series(panel: DataFrame, until: Column, key: str = "series_id") -> DataFrame:
    """COGS / revenue per series up to a date; the ratio over all series where one has no revenue."""
    past = panel.where(F.col("date") <= until)
    per = past.groupBy(key).agg(F.sum("revenue").alias("_r"), F.sum("cogs").alias("_c"))
    everything = per.agg(F.try_divide(F.sum("_c"), F.sum("_r"))).scalar()
    return per.select(key, F.coalesce(div_null("_c", "_r"), everything).alias("cogs_ratio"))


def campaign_strength(daily: DataFrame, value: str, campaigns: Sequence[str]) -> DataFrame:
    """Mean value per campaign divided by the largest of those means."""
    one = daily.agg(*[F.avg(F.when(F.col(c) > 0, F.col(value))).alias(c) for c in campaigns])
    long = one.unpivot([], list(campaigns), "campaign", "mean_value").where("mean_value is not null")
    return long.withColumn("strength", div_fill(F.col("mean_value"), F.max("mean_value").over(Window.partitionBy(F.lit(0)))))


