"""Window operators over daily series.

Frames are partitioned by a series key and ordered by date. A daily series is bounded by
the calendar, so a partition holds a few thousand rows however large the facts are.
Look-back frames end at the previous row; the row being described is never read.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_window(key: str = "series_id", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def lag(col: str, k: int, key: str = "series_id", order: str = "date") -> Column:
    return F.lag(col, k).over(series_window(key, order))


def _past(col, width, agg, key, order) -> Column:
    frame = series_window(key, order).rowsBetween(-width, -1)
    return F.when(F.count(col).over(frame) == width, agg(col).over(frame))


def roll_mean(col: str, width: int, key: str = "series_id", order: str = "date") -> Column:
    """Mean of the previous ``width`` rows, NULL until all of them are present."""
    return _past(col, width, F.avg, key, order)


def roll_std(col: str, width: int, key: str = "series_id", order: str = "date") -> Column:
    return _past(col, width, F.stddev_samp, key, order)


def roll_median(col: str, width: int, key: str = "series_id", order: str = "date") -> Column:
    return _past(col, width, lambda c: F.percentile(c, F.lit(0.5)), key, order)


def smooth(col: str, width: int, key: str = "series_id", order: str = "date") -> Column:
    """Mean of the current row and up to ``width - 1`` rows before it."""
    return F.avg(col).over(series_window(key, order).rowsBetween(1 - width, 0))


def expanding_quantile(col: str, p: float, key: str = "series_id", order: str = "date") -> Column:
    """Exact quantile of all strictly earlier rows."""
    frame = series_window(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.percentile(F.col(col), F.lit(p)).over(frame)


def expanding_quantiles(col: str, probs: Sequence[float], key: str = "series_id", order: str = "date") -> Column:
    """Array of exact quantiles of all strictly earlier rows, from one running histogram."""
    frame = series_window(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.percentile(F.col(col), F.array(*[F.lit(p) for p in probs])).over(frame)


def past_quantiles(df: DataFrame, col: str, probs: Sequence[float], out: str, key: str = "series_id", order: str = "date") -> DataFrame:
    """``df`` with the array ``out`` of exact quantiles of all strictly earlier rows of its series.

    One pass per series: each value is inserted into the sorted values before it, so ten times the
    rows take about ten times as long, where a window's percentile is evaluated anew for every row.
    One row per (key, order) is expected; nulls and NaN of ``col`` are skipped.
    """
    probs = [float(p) for p in probs]
    kinds = dict(df.select(F.col(key).alias("_k"), F.col(order).alias("_o")).dtypes)

    def run(rows):
        seen, found = [], []
        for v in rows.sort_values("_o", kind="stable")["_v"]:
            row = None
            if seen:
                row = []
                for p in probs:
                    at = (len(seen) - 1) * p
                    lo = int(at)
                    row.append(seen[lo] if lo == at else (lo + 1 - at) * seen[lo] + (at - lo) * seen[lo + 1])
            found.append(row)
            if v is not None and v == v:
                insort(seen, float(v))
        done = rows.sort_values("_o", kind="stable")[["_k", "_o"]]
        done["_q"] = found
        return done

    narrow = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(col).cast("double").alias("_v"))
    q = narrow.groupBy("_k").applyInPandas(run, f"_k {kinds['_k']}, _o {kinds['_o']}, _q array<double>")
    q = q.withColumnRenamed("_q", out)
    return df.join(q, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_o")), "left").drop("_k", "_o")



def lag_columns(cols: Sequence[str], lags: Sequence[int], key: str = "series_id") -> list[Column]:
    return [lag(c, k, key).alias(f"{c}_lag_{k}") for c in cols for k in lags]


def roll_mean_columns(cols: Sequence[str], widths: Sequence[int], key: str = "series_id") -> list[Column]:
    return [roll_mean(c, w, key).alias(f"{c}_roll_mean_{w}") for c in cols for w in widths]


def roll_std_columns(cols: Sequence[str], widths: Sequence[int], key: str = "series_id") -> list[Column]:
    return [roll_std(c, w, key).alias(f"{c}_roll_std_{w}") for c in cols for w in widths]


def add_lag_grid(df: DataFrame, cols: Sequence[str], lags: Sequence[int], widths: Sequence[int], key: str = "series_id") -> DataFrame:
    """All lags and rolling means in one projection, so one sort serves them all."""
    return df.select("*", *lag_columns(cols, lags, key), *roll_mean_columns(cols, widths, key))


def forward_fill(df: DataFrame, cols: Sequence[str], key: str = "series_id", order: str = "date", prefix: str = "snapshot") -> DataFrame:
    """Carry the last observed row forward; keep observed / available flags; then 0."""
    frame = series_window(key, order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull()
    filled = [F.last(c, ignorenulls=True).over(frame).alias(c) for c in cols]
    rest = [c for c in df.columns if c not in cols]
    out = df.select(*rest, seen.cast("int").alias(f"{prefix}_observed"), *filled)
    available = F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull().cast("int")
    return out.withColumn(f"{prefix}_available", available).na.fill(0, list(cols))


def gap_days(col: str, key: str, order: str | None = None) -> Column:
    order = order or col
    return F.datediff(F.col(col), F.lag(col).over(Window.partitionBy(key).orderBy(order)))


def rank_pct(col: str, key: str = "series_id") -> Column:
    """Percent rank with ties averaged: (mean rank of the tie group) / rows."""
    ordered = Window.partitionBy(key).orderBy(col)
    ties = F.count(F.lit(1)).over(Window.partitionBy(key, col))
    total = F.count(col).over(Window.partitionBy(key))
    return F.when(F.col(col).isNotNull(), (F.rank().over(ordered) + F.when(F.col(col).isNull(), 0).otherwise((ties - 1) / 2) - _nulls_before(col, key)) / total)


def _nulls_before(col: str, key: str) -> Column:
    return F.sum(F.col(col).isNull().cast("int")).over(Window.partitionBy(key))


def tail(df: DataFrame, n: int, key: str = "series_id", order: str = "date") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group under a multi-key order (give a unique last key)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def neighbors(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Adjacent configurations on a sorted grid."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select(
        "*",
        F.lag(order).over(w).alias(f"{order}_below"),
        F.lag(value).over(w).alias(f"{value}_below"),
        F.lead(order).over(w).alias(f"{order}_above"),
        F.lead(value).over(w).alias(f"{value}_above"),
    )


def history_array(col: str, n: int, key: str = "series_id", order: str = "date") -> Column:
    """The previous ``n`` values, oldest first."""
    return F.collect_list(col).over(series_window(key, order).rowsBetween(-n, -1))
