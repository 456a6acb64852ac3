"""Calendar columns that are known for any past or future date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The regime break and the months treated as high risk.
REGIME_START = "2019-01-01"
REGIME_YEAR = 2019
HIGH_RISK_MONTHS = [2, 3, 5, 8]


def date_spine(spark: SparkSession, lo: str, hi: str) -> DataFrame:
    days = F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("date"))


def spine_of(df: DataFrame, col: str = "date") -> DataFrame:
    """Every day between the first and last date of ``df``."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    return ends.where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))


def calendar_features(df: DataFrame, min_date: Column, col: str = "date", regime_start: str = REGIME_START) -> DataFrame:
    """Sixteen deterministic columns per date. Monday is day 0; weeks are ISO weeks."""
    d = F.col(col)
    regime_year = int(regime_start[:4])
    dow = F.weekday(d)
    quarter_start = F.trunc(d, "quarter")
    base = df.select(
        "*",
        dow.alias("day_of_week"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        (dow >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"),
        (d == F.last_day(d)).cast("int").alias("is_month_end"),
        (d == quarter_start).cast("int").alias("is_quarter_start"),
        (d == F.last_day(F.add_months(quarter_start, 2))).cast("int").alias("is_quarter_end"),
        F.datediff(d, min_date).alias("time_index"),
        (d >= F.lit(regime_start).cast("date")).cast("int").alias("regime_flag"),
        (F.year(d) - F.year(min_date)).alias("years_since_start"),
        F.greatest(F.lit(0), F.year(d) - regime_year).alias("years_since_regime"),
    )
    return base.withColumn("regime_time_index", F.col("time_index") * F.col("regime_flag"))


# Names of the calendar columns.
CALENDAR_COLUMNS = [
    "day_of_week", "day_of_year", "week_of_year", "month", "quarter", "year", "is_weekend", "is_month_start",
    "is_month_end", "is_quarter_start", "is_quarter_end", "time_index", "regime_flag", "years_since_start",
    "years_since_regime", "regime_time_index",
]


def is_odd_year(day) -> Column:
    return F.year(day) % 2


def is_high_risk(day) -> Column:
    return F.month(day).isin(HIGH_RISK_MONTHS).cast("int")


def reference_end(day: str = "date", cutoff: Column | None = None) -> Column:
    """Last day whose data may be used: the day before in training, a fixed cutoff later."""
    before = F.date_sub(F.col(day), 1)
    return before if cutoff is None else F.coalesce(cutoff, before)
