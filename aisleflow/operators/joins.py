"""Join operators: validity intervals, as-of, calendar shifts, densify, overlays.

No cross joins: range conditions are turned into equi joins on days, years or months,
and one-row facts enter as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE_DAY = "interval 1 day"


def expand_intervals(df: DataFrame, start: str, end: str, lo: Column, hi: Column, day: str = "date") -> DataFrame:
    """One row per day of each inclusive interval, clamped to [lo, hi]; empty ones vanish."""
    bounded = df.withColumn("_a", F.greatest(F.col(start), lo)).withColumn("_b", F.least(F.col(end), hi))
    kept = bounded.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col("_a") <= F.col("_b")))
    return kept.withColumn(day, F.explode(F.sequence("_a", "_b", F.expr(ONE_DAY)))).drop("_a", "_b")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    on: str = "date",
    cutoff: Column | None = None,
) -> DataFrame:
    """For each left row the latest right row dated at or before it (and at or before ``cutoff``).

    Both sides are stacked and the last right row is carried forward per key, so it costs
    one shuffle and one sort on (key, date) and never compares pairs. ``by`` may be empty
    only for daily frames of one series.
    """
    known = right if cutoff is None else right.where(F.col(on) <= cutoff)
    tagged_right = known.select(
        *by, F.col(on), F.lit(0).alias("_side"), F.struct(F.col(on).alias("_asof"), *cols).alias("_hit")
    )
    tagged_left = left.withColumn("_side", F.lit(1))
    stacked = tagged_left.unionByName(tagged_right, allowMissingColumns=True)
    w = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(on, "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hit = F.last("_hit", ignorenulls=True).over(w)
    out = stacked.withColumn("_last", hit).where("_side = 1")
    return out.select(*left.columns, F.col("_last._asof").alias("asof_date"), *[F.col(f"_last.{c}").alias(c) for c in cols])


def same_date_reference(df: DataFrame, value: str, years: int, out: str, key: str = "series_id", reference_end: Column | None = None) -> DataFrame:
    """Value on the same calendar date ``years`` earlier (29 Feb reads 28 Feb)."""
    ref = df.select(key, F.col("date").alias("_ref"), F.col(value).alias(out))
    joined = df.withColumn("_ref", F.add_months("date", -12 * years)).join(ref, [key, "_ref"], "left")
    if reference_end is not None:
        joined = joined.withColumn(out, F.when(F.col("_ref") <= reference_end, F.col(out)))
    return joined.drop("_ref")


def recent_years(df: DataFrame, back: int = 3) -> DataFrame:
    """Fan a row out to its ``back`` preceding years (column ref_year)."""
    years = F.array(*[F.year("date") - k for k in range(1, back + 1)])
    return df.withColumn("ref_year", F.explode(years))


def same_month_recent_mean(targets: DataFrame, history: DataFrame, value: str, out: str, key: str = "series_id", back: int = 3) -> DataFrame:
    """Pooled mean over the same month of the preceding years, up to each row's reference_end.

    History is summarised per (series, year, month) with a running sum by day, so a target
    matches at most ``back`` rows; partially known months are handled by the day key.
    """
    daily = history.select(key, F.col("date").alias("_d"), F.col(value).alias("_v"))
    t = recent_years(targets.select(key, "date", "reference_end").distinct(), back)
    first = F.make_date("ref_year", F.month("date"), F.lit(1))
    upto = F.least(F.last_day(first), F.col("reference_end"))
    t = t.withColumn("_m", first).withColumn("_d", upto).where("_d >= _m").drop("_m")
    run = Window.partitionBy(key, F.trunc("_d", "month")).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    cum = daily.select(key, "_d", F.sum("_v").over(run).alias("_s"), F.count("_v").over(run).alias("_n"))
    hit = t.join(cum, [key, "_d"], "inner")
    mean = hit.groupBy(key, "date", "reference_end").agg((F.sum("_s") / F.sum("_n")).alias(out))
    return targets.join(mean, [key, "date", "reference_end"], "left")


def same_day_recent_mean(targets: DataFrame, history: DataFrame, value: str, out: str, key: str = "series_id", back: int = 3, tolerance: int = 3) -> DataFrame:
    """Mean within ``tolerance`` days of the same day of year (circular, modulus 366), preceding years."""
    daily = history.select(key, F.year("date").alias("ref_year"), F.dayofyear("date").alias("_doy"), F.col("date").alias("_d"), F.col(value).alias("_v"))
    t = recent_years(targets.select(key, "date", "reference_end").distinct(), back)
    shifts = F.array(*[F.lit(s) for s in range(-tolerance, tolerance + 1)])
    around = F.transform(shifts, lambda s: F.pmod(F.dayofyear("date") + s, F.lit(366)))
    # day 366 and residue 0 name the same place on the circle
    t = t.withColumn("_doy", F.explode(around))
    hit = t.join(daily.withColumn("_doy", F.pmod("_doy", F.lit(366))), [key, "ref_year", "_doy"], "inner").where("_d <= reference_end")
    mean = hit.groupBy(key, "date", "reference_end").agg(F.avg("_v").alias(out))
    return targets.join(mean, [key, "date", "reference_end"], "left")


def overlay(base: DataFrame, patch: DataFrame, on: Sequence[str]) -> DataFrame:
    """Values of ``patch`` win where present; columns missing from ``base`` are added."""
    shared = [c for c in patch.columns if c in base.columns and c not in on]
    extra = [c for c in patch.columns if c not in base.columns]
    renamed = patch.select(*on, *[F.col(c).alias(f"_p_{c}") for c in shared], *extra)
    joined = base.join(renamed, list(on), "left")
    cols = [F.coalesce(f"_p_{c}", c).alias(c) if c in shared else F.col(c) for c in base.columns]
    return joined.select(*cols, *extra)


def add_missing_columns(base: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    extra = [c for c in other.columns if c not in base.columns]
    return base.join(other.select(*on, *extra), list(on), "left")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass ``df`` through, or raise when a key occurs twice."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"key {list(keys)} is not unique")
    return df
