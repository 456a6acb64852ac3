"""Stock context per day from periodic snapshots, and stock interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.operators.joins import asof_backward

# Share of the carried snapshot and of the month mean in the hybrid scenario.
HYBRID = (0.7, 0.3)


def asof_month_fallback(spine: DataFrame, snaps: DataFrame, cols: Sequence[str], cutoff: Column) -> DataFrame:
    """Latest snapshot up to the cutoff; before the first one the mean of the same month; then 0."""
    known = snaps.where(F.col("date") <= cutoff)
    carried = asof_backward(spine, known, cols).drop("asof_date")
    months = known.groupBy(F.month("date").alias("_m")).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    joined = carried.withColumn("_m", F.month("date")).join(months, "_m", "left")
    return joined.select("date", *[F.coalesce(c, f"_m_{c}", F.lit(0.0)).alias(c) for c in cols])


def _expanding_month_mean(spine: DataFrame, snaps: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of the same month over snapshots dated at or before each day, else of all of them."""
    by_month = Window.partitionBy("_m").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = snaps.withColumn("_m", F.month("date"))
    run = s.select("date", "_m", *[F.avg(c).over(by_month).alias(f"_m_{c}") for c in cols], *[F.avg(c).over(everything).alias(f"_a_{c}") for c in cols])
    days = spine.select("date", F.month("date").alias("_m"))
    month = asof_backward(days, run, [f"_m_{c}" for c in cols], ["_m"]).drop("asof_date")
    both = asof_backward(month, run, [f"_a_{c}" for c in cols]).drop("asof_date")
    return both.select("date", *[F.coalesce(f"_m_{c}", f"_a_{c}", F.lit(0.0)).alias(c) for c in cols])


def stock_context(spine: DataFrame, snaps: DataFrame, cols: Sequence[str], cutoff: Column | None = None) -> DataFrame:
    """Three scenarios in long form: carry, monthavg and their hybrid. Without a cutoff snapshots
    update as they become known; with one, only earlier snapshots are used."""
    spine = spine.select("date")
    known = snaps.select("date", *cols) if cutoff is None else snaps.where(F.col("date") <= cutoff).select("date", *cols)
    carry = asof_backward(spine, known, cols).drop("asof_date").na.fill(0.0, list(cols))
    if cutoff is None:
        month = _expanding_month_mean(spine, known, cols)
    else:
        months = known.groupBy(F.month("date").alias("_m")).agg(*[F.avg(c).alias(c) for c in cols])
        month = spine.withColumn("_m", F.month("date")).join(months, "_m", "left").select("date", *cols).na.fill(0.0, list(cols))
    both = carry.join(month.select("date", *[F.col(c).alias(f"_m_{c}") for c in cols]), "date")
    a, b = HYBRID
    scenarios = [
        F.struct(F.lit("carry").alias("scenario"), *[F.col(c).alias(c) for c in cols]),
        F.struct(F.lit("monthavg").alias("scenario"), *[F.col(f"_m_{c}").alias(c) for c in cols]),
        F.struct(F.lit("hybrid").alias("scenario"), *[(F.lit(a) * F.col(c) + F.lit(b) * F.col(f"_m_{c}")).alias(c) for c in cols]),
    ]
    return both.select("date", F.inline(F.array(*scenarios)))


def stock_thresholds(ctx: DataFrame, by: Sequence[str], col: str = "inv_avg_days_of_supply") -> DataFrame:
    """25th and 75th percentile of days of supply per group."""
    q = F.percentile(F.col(col), F.array(F.lit(0.25), F.lit(0.75)))
    return ctx.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("low_threshold"), F.col("_q")[1].alias("high_threshold"))


def stock_flags(df: DataFrame) -> DataFrame:
    """Low / high stock flags and their interactions with the base forecast, promotion and spike
    probability. ``df`` carries low_threshold and high_threshold."""
    dos = F.col("inv_avg_days_of_supply")
    low = (dos < F.col("low_threshold")).cast("int")
    high = (dos > F.col("high_threshold")).cast("int")
    d = df.withColumn("low_stock", low).withColumn("high_stock", high)

    def times(a, b):
        return (F.col(a) * F.col(b)).alias(f"{a}_x_{b}")

    pairs = [
        ("low_stock", "base_pred"), ("stock_pressure", "base_pred"), ("stockout_pressure", "base_pred"), ("high_stock", "spike_prob"),
        ("stock_pressure", "any_promo"), ("low_stock", "any_promo"), ("restock_signal", "any_promo"), ("high_stock", "avg_discount_value"),
        ("stock_build_up", "campaign_active"),
    ]
    return d.select("*", *[times(a, b) for a, b in pairs])
