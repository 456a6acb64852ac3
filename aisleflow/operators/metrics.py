"""Forecast evaluation over long frames (keys, actual, predicted).

Every metric is a conditional aggregate, so any number of models, scopes or grid points is
evaluated in one pass with map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleflow.functions.scalars import div_zero


def _err() -> Column:
    return F.col("actual") - F.col("predicted")


def rmse(mask: Column | None = None) -> Column:
    sq = _err() * _err()
    return F.sqrt(F.avg(sq if mask is None else F.when(mask, sq)))


def mae() -> Column:
    return F.avg(F.abs(_err()))


def r2() -> Column:
    """1 - SSE / SST; NULL when the actuals do not vary."""
    y = F.when(F.col("predicted").isNotNull(), F.col("actual"))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst > 0, 1 - F.sum(_err() * _err()) / sst)


def basic() -> list[Column]:
    return [mae().alias("mae"), rmse().alias("rmse"), r2().alias("r2")]


def regression_metrics(df: DataFrame, by: Sequence[str] = (), r2_if_flat: float | None = None) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(_err()).alias("rows"), *basic())
    return out if r2_if_flat is None else out.na.fill(r2_if_flat, ["r2"])


def with_spike_levels(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the 90th and 95th percentile of the actuals per group (one day counted once)."""
    days = df.select(*by, "date", "actual").distinct()
    q = F.percentile("actual", F.array(F.lit(0.9), F.lit(0.95)))
    levels = days.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("p90"), F.col("_q")[1].alias("p95"))
    return df.join(levels, list(by))


def spike_columns() -> list[Column]:
    top10, top5 = F.col("actual") >= F.col("p90"), F.col("actual") >= F.col("p95")
    return [
        rmse(top10).alias("top10_rmse"), F.avg(F.when(top10, _err())).alias("top10_mean_error"), F.count_if(top10 & (_err() > 0)).alias("top10_under"),
        F.count_if(top10).alias("top10_days"), rmse(top5).alias("top5_rmse"), F.count_if(top5 & (_err() > 0)).alias("top5_under"),
        rmse(~top10).alias("non_spike_rmse"),
    ]


def spike_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Errors on the top 10 % / 5 % days and on the rest. ``df`` carries p90 and p95."""
    return df.groupBy(*by).agg(*basic(), *spike_columns())


def slice_metrics(df: DataFrame, by: Sequence[str], masks: Mapping[str, Column]) -> DataFrame:
    aggs = [x for n, m in masks.items() for x in (rmse(m).alias(f"{n}_rmse"), F.count_if(m).alias(f"{n}_days"))]
    return df.groupBy(*by).agg(*basic(), *aggs)


def metrics_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error table per group with bias and direction counts; the NULL group is kept."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), *basic(), F.avg("actual").alias("mean_actual"), F.avg("predicted").alias("mean_predicted"),
        F.avg(_err()).alias("bias"), F.count_if(_err() > 0).alias("under"), F.count_if(_err() < 0).alias("over"),
    )


def error_columns(df: DataFrame) -> DataFrame:
    """Error, absolute and relative error (NULL for actual 0) and a direction label."""
    e = _err()
    direction = F.when(F.abs(e) < 1e-9, "exact").when(e > 0, "underprediction").otherwise("overprediction")
    return df.select("*", e.alias("error"), F.abs(e).alias("abs_error"), F.try_divide(e, F.col("actual")).alias("pct_error"), direction.alias("direction"))


def error_decomposition(df: DataFrame) -> DataFrame:
    """Split a revenue error into the part due to order counts and the part due to order value."""
    orders_part = (F.col("predicted_orders") - F.col("orders")) * F.col("aov")
    value_part = F.col("predicted_orders") * (F.col("predicted_aov") - F.col("aov"))
    return df.select("*", orders_part.alias("orders_part"), value_part.alias("value_part"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Rank AUC with averaged ties from the score histogram: positives above each score plus half of
    the ties. Rows collapse to distinct scores first; only per-bucket totals are compared globally."""
    from pyspark.sql import Window

    from aisleflow.operators.quantiles import bucketed

    rows = df.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).alias("_y")).where("_s is not null and _y is not null")
    counts = rows.groupBy(*by, "_s").agg(F.count_if(F.col("_y") == 1).alias("_p"), F.count_if(F.col("_y") == 0).alias("_n"))
    hist = bucketed(counts, rows, "_s")
    # the filter reads both counts, so this side shares the histogram's shuffle
    buckets = hist.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"), F.sum("_p").alias("_bp")).where("_bn + _bp > 0")
    before = F.sum("_bn").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_bn")
    offsets = buckets.select(*by, "_b", before.alias("_below"))
    inside = Window.partitionBy(*by, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    placed = hist.withColumn("_upto", F.sum("_n").over(inside)).join(offsets, [*by, "_b"])
    wins = F.col("_p") * (F.col("_below") + F.col("_upto") - F.col("_n") + F.col("_n") / 2)
    return placed.groupBy(*by).agg(F.try_divide(F.sum(wins), (F.sum("_p") * F.sum("_n")).cast("double")).alias("auc"))


def binary_metrics(df: DataFrame, score: str, label: str, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    hit = F.col(score) >= threshold
    y = F.col(label)
    counts = df.groupBy(*by).agg(
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn")
    )
    precision, recall = div_zero("tp", F.col("tp") + F.col("fp")), div_zero("tp", F.col("tp") + F.col("fn"))
    c = counts.join(auc(df, score, label, by), list(by), "left").select("*", precision.alias("precision"), recall.alias("recall"))
    return c.withColumn("f1", div_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def in_scopes(df: DataFrame, scopes: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Fan rows out to the backtest scopes (name, train_end, valid_start, valid_end) that validate
    them. The scope list is a literal, so this is a bounded expansion, not a join."""
    items = [F.struct(F.lit(n).alias("scope"), *[F.lit(d).cast("date").alias(c) for d, c in ((a, "reference_end"), (b, "valid_start"), (e, "valid_end"))]) for n, a, b, e in scopes]
    kept = F.filter(F.array(*items), lambda x: F.col("date").between(x["valid_start"], x["valid_end"]))
    return df.withColumn("_s", kept).select(*df.columns, F.inline("_s")).drop("valid_start", "valid_end")


def selection_score(metrics: DataFrame, main: str, folds: Sequence[str]) -> DataFrame:
    """0.6 x RMSE of the main scope + 0.4 x mean RMSE of the long folds, best first."""
    g = metrics.groupBy("model").agg(
        F.max(F.when(F.col("scope") == main, F.col("rmse"))).alias("main_rmse"), F.avg(F.when(F.col("scope").isin(list(folds)), F.col("rmse"))).alias("long_rmse")
    )
    return g.withColumn("score", 0.6 * F.col("main_rmse") + 0.4 * F.coalesce("long_rmse", "main_rmse"))


def challenger(a: DataFrame, b: DataFrame, by: Sequence[str], gain: float = 0.005) -> DataFrame:
    """Does ``b`` beat ``a``: MAE at least ``gain`` better, RMSE and R2 not worse."""
    bb = b.select(*by, *[F.col(c).alias(f"{c}_b") for c in ("mae", "rmse", "r2")])
    j = a.join(bb, list(by))
    diffs = [(F.col(f"{c}_b") - F.col(c)).alias(f"{c}_change") for c in ("mae", "rmse", "r2")]
    ok = ((F.col("mae") - F.col("mae_b")) / F.col("mae") >= gain) & (F.col("rmse_b") <= F.col("rmse")) & (F.col("r2_b") >= F.col("r2"))
    return j.select(*by, *diffs, ok.alias("replace"))


def predictions_wide(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per (series, date) with a column per model."""
    aggs = [F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models]
    return long.groupBy("series_id", "date", "actual").agg(*aggs)


def predictions_long(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    ids = [c for c in wide.columns if c not in models]
    return wide.unpivot(ids, list(models), "model", "predicted")


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Columns a model may use; anything not numeric is refused, not silently dropped."""
    from aisleflow.operators.quality import numeric_columns

    rest = [c for c in df.columns if c not in exclude]
    bad = sorted(set(rest) - set(numeric_columns(df)))
    if bad:
        raise ValueError(f"non-numeric feature columns: {bad}")
    return rest


def time_split(df: DataFrame, cutoff: str, end: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("date")
    return df.where(d < F.lit(cutoff).cast("date")), df.where((d >= F.lit(cutoff).cast("date")) & (d <= F.lit(end).cast("date")))
