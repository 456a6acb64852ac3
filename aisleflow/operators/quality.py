"""Data-quality reports. Every report is a DataFrame; one aggregation pass where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleflow.operators.quantiles import quantile_columns

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def missing_report(df: DataFrame) -> DataFrame:
    """Columns that have NULLs, with count and percentage."""
    rows = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    ).unpivot(["_rows"], list(df.columns), "column_name", "missing_count")
    pct = F.round(F.col("missing_count") / F.col("_rows") * 100, 2)
    return rows.where("missing_count > 0").select("column_name", "missing_count", pct.alias("missing_pct"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def missing_dates(df: DataFrame, spine: DataFrame, col: str = "date") -> DataFrame:
    """Expected dates that do not occur."""
    return spine.join(df.select(F.col(col).alias("date")).distinct(), "date", "left_anti")


def audit_structure(df: DataFrame, col: str = "date") -> DataFrame:
    """Rows, date range, duplicate dates, gaps and column kinds in one row."""
    per_day = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    n_num = len(numeric_columns(df))
    span = F.datediff(F.max(col), F.min(col)) + 1
    return per_day.agg(
        F.sum("_n").alias("rows"),
        F.min(col).alias("first_date"),
        F.max(col).alias("last_date"),
        F.sum(F.when(F.col(col).isNotNull(), F.col("_n") - 1)).alias("duplicate_dates"),
        (span - F.count(col)).alias("missing_dates"),
        F.lit(n_num).alias("numeric_columns"),
        F.lit(len(df.columns) - n_num).alias("other_columns"),
    )


def iqr_outliers(df: DataFrame, col: str) -> DataFrame:
    """Bounds at 1.5 IQR and the rows outside them, plus negative and zero counts."""
    q = quantile_columns(df, col, {"q1": 0.25, "q3": 0.75})
    both = q.select(F.struct("q1", "q3")).scalar()
    q1, q3 = both["q1"], both["q3"]
    with_bounds = df.select(F.col(col).alias("_v"), (q1 - 1.5 * (q3 - q1)).alias("_lo"), (q3 + 1.5 * (q3 - q1)).alias("_hi"))
    return with_bounds.agg(
        F.max("_lo").alias("lower_bound"),
        F.max("_hi").alias("upper_bound"),
        F.count_if((F.col("_v") < F.col("_lo")) | (F.col("_v") > F.col("_hi"))).alias("outliers"),
        F.count_if(F.col("_v") < 0).alias("negatives"),
        F.count_if(F.col("_v") == 0).alias("zeros"),
    )


# The percentiles of a target description.
DESCRIBE = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def describe(df: DataFrame, col: str) -> DataFrame:
    q = quantile_columns(df, col, DESCRIBE)
    basic = df.agg(
        F.count(col).alias("rows"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    all_q = q.select(F.struct(*DESCRIBE)).scalar()
    return basic.withColumn("_q", all_q).select(*basic.columns, "_q.*")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both sides are present; NULL when one does not vary."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.try_divide(F.covar_pop(x, y), spread))


def corr_with(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation with the target, pairwise NULLs skipped, long form."""
    pairs = [safe_corr(F.col(c), F.col(target)).alias(c) for c in cols]
    return df.agg(*pairs).unpivot([], list(cols), "feature", "corr")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            pairs.append((a, b))
            aggs.append(safe_corr(F.col(a), F.col(b)).alias(f"_{len(aggs)}"))
    one = df.agg(*aggs)
    cells = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*cells)))


def leakage_candidates(df: DataFrame, target: str, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    c = corr_with(df, target, cols).where("corr is not null and not isnan(corr)")
    return c.withColumn("suspect", (F.abs("corr") >= threshold).cast("int"))


def yearly_summary(df: DataFrame, value: str, col: str = "date") -> DataFrame:
    """Per-year statistics of a daily frame."""
    return df.groupBy(F.year(col).alias("year")).agg(
        F.count(value).alias("rows"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.stddev_samp(value).alias("std"), F.sum(value).alias("total"),
    )


def period_compare(df: DataFrame, value: str, split_year: int, col: str = "date") -> DataFrame:
    """Mean, median and total before and from ``split_year``, with ratios."""
    late = F.year(col) >= split_year
    a, b = F.when(~late, F.col(value)), F.when(late, F.col(value))
    one = df.agg(
        F.avg(a).alias("mean_before"), F.avg(b).alias("mean_after"), F.median(a).alias("median_before"),
        F.median(b).alias("median_after"), F.sum(a).alias("total_before"), F.sum(b).alias("total_after"),
    )
    ratios = [F.try_divide(F.col(f"{k}_after"), F.col(f"{k}_before")).alias(f"{k}_ratio") for k in ("mean", "median", "total")]
    return one.select("*", *ratios)


def regime_shift(df: DataFrame, value: str, split_year: int, tolerance: float = 0.15) -> DataFrame:
    c = period_compare(df, value, split_year)
    moved = (F.abs(F.col("mean_ratio") - 1) >= tolerance) | (F.abs(F.col("median_ratio") - 1) >= tolerance)
    return c.withColumn("regime_shift", moved)


def audit_split(df: DataFrame, value: str, cutoff: str, end: str, col: str = "date") -> DataFrame:
    part = F.when(F.col(col) < F.lit(cutoff).cast("date"), "train").when(F.col(col) <= F.lit(end).cast("date"), "validation")
    return df.withColumn("part", part).where("part is not null").groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.min(col).alias("first_date"), F.max(col).alias("last_date"),
        F.avg(value).alias("mean"), F.median(value).alias("median"),
    )


def check_forecast(forecast: DataFrame, spine: DataFrame, cols: Sequence[str] = ("date", "revenue", "cogs")) -> DataFrame:
    """One row of contract results; ``passed`` is the conjunction."""
    values = [c for c in cols if c != "date"]
    nulls = [F.col(c).isNull() for c in values if c in forecast.columns]
    negs = [F.coalesce(F.col(c) < 0, F.lit(False)) for c in values if c in forecast.columns]
    both = forecast.select("date", *[c for c in values if c in forecast.columns]).withColumn("_f", F.lit(1)).unionByName(
        spine.select("date").withColumn("_s", F.lit(1)), allowMissingColumns=True
    )
    is_f = F.col("_f").isNotNull()
    bad_null = F.greatest(*[n.cast("int") for n in nulls], F.lit(0)) * is_f.cast("int")
    bad_neg = F.greatest(*[n.cast("int") for n in negs], F.lit(0)) * is_f.cast("int")
    per_day = both.groupBy("date").agg(
        F.count("_f").alias("f"), F.count("_s").alias("s"), F.sum(bad_null).alias("n"), F.sum(bad_neg).alias("g")
    )
    counts = per_day.agg(
        F.lit(list(forecast.columns) == list(cols)).alias("columns_ok"),
        F.sum("f").alias("forecast_rows"),
        F.sum("s").alias("spine_rows"),
        F.count_if((F.col("f") == 0)).alias("missing_dates"),
        F.count_if((F.col("s") == 0)).alias("extra_dates"),
        F.sum(F.greatest(F.col("f") - 1, F.lit(0))).alias("duplicate_dates"),
        F.sum("n").alias("null_rows"),
        F.sum("g").alias("negative_rows"),
    )
    ok = F.col("columns_ok") & (F.col("missing_dates") + F.col("extra_dates") + F.col("duplicate_dates") + F.col("null_rows") + F.col("negative_rows") == 0)
    return counts.withColumn("passed", ok)
