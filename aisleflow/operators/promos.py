"""Promotion calendars: intervals become days, days become one feature row per date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.functions.scalars import campaign_base, present, truthy

# The six campaign names (lower case).
CAMPAIGN_NAMES = ["spring sale", "mid-year sale", "fall launch", "year-end sale", "urban blowout", "rural special"]


def campaign_columns(names: Sequence[str] = CAMPAIGN_NAMES) -> list[str]:
    return ["campaign_" + n.replace("-", "_").replace(" ", "_") for n in names]


def prepare_promotions(promos: DataFrame) -> DataFrame:
    """Flags, duration and base name; promotions without valid dates are dropped."""
    kind = F.lower("promo_type")
    return promos.where("start_date is not null and end_date is not null and end_date >= start_date").select(
        "*",
        (F.datediff("end_date", "start_date") + 1).alias("duration_days"),
        F.year("start_date").alias("source_year"),
        campaign_base("promo_name").alias("promo_name_base"),
        truthy("stackable_flag").alias("stackable"),
        present("applicable_category").alias("category_specific"),
        F.coalesce(kind == "percentage", F.lit(False)).cast("int").alias("percentage_promo"),
        F.coalesce(kind == "fixed", F.lit(False)).cast("int").alias("fixed_promo"),
    )


def promo_intervals(promos: DataFrame, names: Sequence[str] = CAMPAIGN_NAMES) -> DataFrame:
    """Promotions summed per distinct (start, end). Everything a calendar needs depends only on the
    interval, so only distinct intervals are expanded into days, however many promotions there are.
    Wants prepare_promotions; campaign_index is carried when present."""
    disc, least_order, base = F.coalesce("discount_value", F.lit(0.0)), F.coalesce("min_order_value", F.lit(0.0)), F.lower("promo_name_base")
    extra = [F.max("campaign_index").alias("campaign_index")] if "campaign_index" in promos.columns else []
    return promos.groupBy("start_date", "end_date", "duration_days").agg(
        F.countDistinct("promo_id").alias("promos"), F.count(F.lit(1)).alias("n"), F.sum(disc).alias("sum_discount"), F.max(disc).alias("max_discount"),
        F.sum("stackable").alias("stackable"), F.max("category_specific").alias("category_specific"), F.sum("percentage_promo").alias("percentage_promo"),
        F.sum("fixed_promo").alias("fixed_promo"), F.sum(least_order).alias("sum_min_order"),
        *[F.max((base == n).cast("int")).alias(c) for n, c in zip(names, campaign_columns(names))], *extra,
    )


def promo_day_columns(days: DataFrame) -> DataFrame:
    """Position of each active day inside its promotion."""
    number = F.datediff("date", "start_date") + 1
    left = F.datediff("end_date", "date")
    return days.select(
        "*",
        number.alias("day_number"),
        left.alias("days_remaining"),
        (number / F.col("duration_days")).alias("progress"),
    )


def on_spine(daily: DataFrame, spine: DataFrame) -> DataFrame:
    return spine.select("date").join(daily, "date", "left").na.fill(0)


def _mean(col: str) -> Column:
    """Mean over promotions of a column that is constant within an interval."""
    return F.sum(F.col("n") * F.col(col)) / F.sum("n")


def _calendar_aggs() -> list[Column]:
    return [
        F.sum("promos").alias("active_promo_count"),
        (F.sum("sum_discount") / F.sum("n")).alias("avg_discount_value"),
        F.max("max_discount").alias("max_discount_value"),
        F.sum("stackable").alias("stackable_promo_count"),
        F.max((F.col("stackable") > 0).cast("int")).alias("has_stackable_promo"),
        F.max("category_specific").alias("has_category_specific_promo"),
        F.sum("percentage_promo").alias("percentage_promo_count"),
        F.sum("fixed_promo").alias("fixed_promo_count"),
        (F.sum("sum_min_order") / F.sum("n")).alias("avg_min_order_value"),
    ]


def _edge_flags() -> list[Column]:
    return [
        F.max((F.col("day_number") <= 3).cast("int")).alias("is_first_3_days"),
        F.max((F.col("days_remaining") <= 2).cast("int")).alias("is_last_3_days"),
        F.max((F.col("day_number") <= 7).cast("int")).alias("is_first_7_days"),
        F.max((F.col("days_remaining") <= 6).cast("int")).alias("is_last_7_days"),
    ]


def _any_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("any_promo", (F.col("active_promo_count") > 0).cast("int"))


def promo_calendar(days: DataFrame, spine: DataFrame) -> DataFrame:
    """Counts, discounts and kinds of the promotions active on each date; 0 without promotions.
    ``days`` are the expanded promo_intervals."""
    return _any_flag(on_spine(days.groupBy("date").agg(*_calendar_aggs()), spine))


def promo_phase(days: DataFrame, spine: DataFrame) -> DataFrame:
    """promo_calendar plus duration, position, first / last day flags, length classes, intensities."""
    d = promo_day_columns(days)
    spread = []
    for c in ("duration_days", "day_number", "days_remaining", "progress"):
        spread += [_mean(c).alias(f"avg_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    length = F.col("duration_days")
    classes = {"short": length <= 7, "medium": length.between(8, 30), "long": length > 30}
    counts = [F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(f"{k}_promo_count") for k, cond in classes.items()]
    daily = _any_flag(on_spine(d.groupBy("date").agg(*_calendar_aggs(), *spread, *_edge_flags(), *counts), spine))
    base = F.col("avg_discount_value") * F.col("active_promo_count")
    return daily.select(
        "*",
        (base * F.col("avg_duration_days")).alias("discount_duration_intensity"),
        (base * F.col("avg_progress")).alias("discount_progress_intensity"),
        (F.col("avg_discount_value") * F.col("is_last_3_days")).alias("end_urgency_intensity"),
    )


def campaign_flags(days: DataFrame, spine: DataFrame, names: Sequence[str] = CAMPAIGN_NAMES) -> DataFrame:
    """One 0/1 column per campaign: is any promotion of that campaign active."""
    return on_spine(days.groupBy("date").agg(*[F.max(c).alias(c) for c in campaign_columns(names)]), spine)


def promo_known(days: DataFrame, spine: DataFrame) -> DataFrame:
    """Compact calendar with mean phase, campaign flags and three interactions. ``days`` needs
    campaign_index."""
    d = promo_day_columns(days)
    daily = d.groupBy("date").agg(
        *_calendar_aggs()[:4],
        _mean("duration_days").alias("promo_duration"),
        _mean("day_number").alias("promo_day_number"),
        _mean("progress").alias("promo_progress_ratio"),
        _mean("days_remaining").alias("promo_days_remaining"),
        *_edge_flags()[2:],
        F.max("campaign_index").alias("campaign_index"),
        *[F.max(c).alias(c) for c in campaign_columns()],
    )
    out = _any_flag(on_spine(daily, spine))
    disc = F.col("avg_discount_value")
    return out.select(
        "*",
        (disc * F.col("active_promo_count")).alias("campaign_intensity"),
        (disc * F.col("promo_progress_ratio")).alias("discount_x_progress"),
        (disc * F.col("promo_days_remaining")).alias("discount_x_days_remaining"),
    )


def numbered(df: DataFrame, by: Sequence[str], coarse: Sequence[str], fine: Sequence[str], out: str) -> DataFrame:
    """row_number over (by, coarse, fine) without bringing a whole ``by`` group to one task: counts
    per coarse key give the offsets, rows are only ordered inside their coarse key."""
    sizes = df.groupBy(*by, *coarse).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(*coarse)) - F.col("_n")
    offsets = sizes.select(*by, *coarse, before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*by, *coarse).orderBy(*fine))
    joined = df.withColumn("_i", inner).join(offsets, [*by, *coarse])
    return joined.withColumn(out, (F.col("_before") + F.col("_i")).cast("int")).drop("_before", "_i")


def campaign_index(promos: DataFrame) -> DataFrame:
    """Position of a promotion within its start year."""
    return numbered(promos, ["source_year"], ["start_date", "end_date"], ["promo_id"], "campaign_index")


def campaigns_started(promos: DataFrame, spine: DataFrame) -> DataFrame:
    """Number of promotions that have started by each date."""
    starts = promos.where("start_date is not null").groupBy(F.col("start_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    both = spine.select("date").withColumn("_s", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    per_day = both.groupBy("date").agg(F.max("_s").alias("_s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    run = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select("date", "_s", F.sum("n").over(run).alias("campaigns_started")).where("_s = 1").drop("_s")


def pattern_year(promos: DataFrame, target_year: Column) -> DataFrame:
    """One row: the newest complete year before ``target_year``, and of its parity, whose promotions serve
    as its pattern. A year is complete with at least the usual (most frequent, then smallest) number
    of promotions among the years of its parity; without a complete one, the newest."""
    same = promos.where((F.col("source_year") < target_year) & (F.pmod(F.col("source_year") - target_year, F.lit(2)) == 0))
    per_year = same.groupBy("source_year").agg(F.count(F.lit(1)).alias("n"))
    usual = per_year.groupBy("n").agg(F.count(F.lit(1)).alias("c")).agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("usual"))
    complete = F.max(F.when(F.col("n") >= usual.scalar(), F.col("source_year")))
    return per_year.agg(F.coalesce(complete, F.max("source_year")).alias("source_year"))


def project_promotions(promos: DataFrame, source_year: Column, target_year: Column) -> DataFrame:
    """A coming season's promotions: those of ``source_year`` moved by whole years and renamed."""
    src = promos.where(F.col("source_year") == source_year)
    months = ((target_year - F.col("source_year")) * 12).cast("int")
    n = numbered(src, ["source_year"], ["start_date", "end_date", "promo_name"], ["promo_id"], "campaign_index")
    idx, year = F.col("campaign_index").cast("string"), target_year.cast("string")
    padded = F.when(F.length(idx) < 2, F.lpad(idx, 2, "0")).otherwise(idx)
    start, end = F.add_months("start_date", months), F.add_months("end_date", months)
    return n.select(
        F.concat(F.lit("SYN_PROMO_"), year, F.lit("_"), padded).alias("promo_id"),
        F.concat(F.col("promo_name_base"), F.lit(" "), year).alias("promo_name"),
        "promo_name_base", "promo_type", "discount_value", start.alias("start_date"), end.alias("end_date"),
        "applicable_category", "promo_channel", "stackable_flag", "min_order_value", "stackable", "category_specific",
        "percentage_promo", "fixed_promo", F.col("source_year").alias("source_pattern_year"),
        target_year.alias("target_year"), "campaign_index", (F.datediff(end, start) + 1).alias("duration_days"),
    )


def future_promo_features(days: DataFrame, spine: DataFrame) -> DataFrame:
    """promo_calendar and phase means of projected promotions, prefixed ``future_``."""
    d = promo_day_columns(days)
    daily = d.groupBy("date").agg(
        *_calendar_aggs()[:8],
        _mean("duration_days").alias("avg_duration_days"), F.max("duration_days").alias("max_duration_days"),
        _mean("day_number").alias("avg_day_number"), _mean("days_remaining").alias("avg_days_remaining"),
        _mean("progress").alias("avg_progress_ratio"), *_edge_flags(), F.max("campaign_index").alias("campaign_index"),
    )
    out = _any_flag(on_spine(daily, spine))
    return out.select("date", *[F.col(c).alias(f"future_{c}") for c in out.columns if c != "date"])


def promo_intensity() -> Column:
    return F.col("avg_discount_value") * F.col("active_promo_count")


def intensity_threshold(calendar: DataFrame, before: Column) -> DataFrame:
    """One row: 75th percentile of intensity over promotion days of the training period."""
    days = calendar.where((F.col("date") < before) & (F.col("any_promo") > 0))
    return days.agg(F.coalesce(F.percentile(promo_intensity(), F.lit(0.75)), F.lit(0.0)).alias("p75"))


def promo_regime(calendar: DataFrame, threshold: Column) -> DataFrame:
    i = promo_intensity()
    regime = F.when(F.col("any_promo") == 0, "none").when(i >= threshold, "high").otherwise("normal")
    return calendar.select("*", i.alias("promo_intensity"), regime.alias("regime"))


def promo_context(df: DataFrame) -> DataFrame:
    """Phase flags (only while a promotion runs) and promotion interactions."""
    on = F.col("any_promo")
    p = F.col("promo_progress_ratio")

    def phase(cond):
        return ((on > 0) & cond).cast("int")

    return df.select(
        "*",
        promo_intensity().alias("promo_intensity"),
        phase(p < 0.3).alias("promo_early"), phase((p >= 0.3) & (p <= 0.7)).alias("promo_mid"), phase(p > 0.7).alias("promo_late"),
        (F.col("month") * on).alias("promo_month"), (F.col("day_of_year") * on).alias("promo_day_of_year"),
        (on * F.col("revenue_lag_365")).alias("promo_x_lag365"), (on * F.col("lag7_to_roll30_ratio")).alias("promo_x_spike"),
        (on * F.col("rel_volatility_30")).alias("promo_x_volatility"),
    )


def promo_summary(promos: DataFrame) -> DataFrame:
    return promos.groupBy("target_year").agg(
        F.count(F.lit(1)).alias("promo_count"), F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end")
    )
