"""Recursive forecasts: every day reads the predictions before it.

A series' known values and its future days become two arrays and the days are folded with a
Catalyst ``aggregate``. Work is one task slot per series (and scope or scenario), in parallel;
there is no job per day and no Python in the loop. An array is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleflow.functions.scalars import clip


def lag_of(hist: Column, k: int) -> Column:
    """Value ``k`` days before the next day; NULL when the history is shorter."""
    return F.try_element_at(hist, F.lit(-k))


def mean_of(hist: Column, width: int) -> Column:
    recent = F.slice(hist, -width, width)
    total = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(hist) >= width, total / width)


def std_of(hist: Column, width: int) -> Column:
    m = mean_of(hist, width)
    sq = F.aggregate(F.transform(F.slice(hist, -width, width), lambda x: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(hist) >= width, F.sqrt(sq / (width - 1)))


def fold_forecast(
    history: DataFrame,
    future: DataFrame,
    value: str,
    keys: Sequence[str],
    step: Callable[[Column, Column], Column],
    extra: DataFrame | None = None,
    keep: int = 366,
) -> DataFrame:
    """``step(hist, row)`` gives the value of one future row from the last ``keep`` values (oldest
    first) and the row's struct; columns of ``extra`` (one row per key, e.g. coefficients) are
    visible as F.col. Returns keys, date, predicted."""
    keys = list(keys)
    past = history.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", F.col(value).cast("double").alias("v")))).alias("_h"))
    past = past.select(*keys, F.transform(F.slice("_h", F.greatest(F.lit(1), F.size("_h") - keep + 1), F.lit(keep)), lambda s: s["v"]).alias("_h"))
    rest = [c for c in future.columns if c not in keys and c != "date"]
    ahead = future.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", *rest))).alias("_f"))
    both = ahead.join(past, keys)
    if extra is not None:
        both = both.join(extra, keys)
    start = F.struct(F.col("_h").alias("h"), F.array().cast("array<struct<date:date,p:double>>").alias("out"))

    def merge(acc, row):
        p = clip(step(acc["h"], row), lo=0)
        grown = F.concat(acc["h"], F.array(p))
        return F.struct(
            F.slice(grown, F.greatest(F.lit(1), F.size(grown) - keep + 1), F.lit(keep)).alias("h"),
            F.concat(acc["out"], F.array(F.struct(row["date"].alias("date"), p.alias("p")))).alias("out"),
        )

    folded = both.select(*keys, F.aggregate("_f", start, merge, lambda acc: acc["out"]).alias("_o"))
    return folded.select(*keys, F.inline("_o")).withColumnRenamed("p", "predicted")


def recursive_linear(history: DataFrame, future: DataFrame, value: str, keys: Sequence[str], models: DataFrame, inputs: Sequence[tuple[str, int]]) -> DataFrame:
    """Recursive forecast of a fitted linear model whose inputs are ("lag", k) or ("mean", width). An
    input the history is too short for takes the model's ``fill`` value (e.g. a training median), or 0."""
    if "fill" not in models.columns:
        models = models.withColumn("fill", F.array_repeat(F.lit(0.0), len(inputs)))

    def step(hist, row):
        out = F.get("coef", F.lit(0))
        for i, (kind, n) in enumerate(inputs, 1):
            x = lag_of(hist, n) if kind == "lag" else mean_of(hist, n)
            out = out + F.get("coef", F.lit(i)) * F.coalesce(x, F.get("fill", F.lit(i - 1)))
        return out

    return fold_forecast(history, future, value, keys, step, models.select(*keys, "coef", "fill"))


def adaptive_weight(lag7_ratio: Column, volatility: Column, lag365_ratio: Column, threshold: Column, base: float) -> Column:
    """Weight of the spike forecast: base +0.2 / +0.1 / +0.1 on spike signals, within [0.15, 0.85]."""
    def add(cond, w):
        return F.when(F.coalesce(cond, F.lit(False)), w).otherwise(0.0)

    w = F.lit(base) + add(lag7_ratio > 1.2, 0.2) + add(volatility > threshold, 0.1) + add(lag365_ratio > 1.3, 0.1)
    return F.greatest(F.lit(0.15), F.least(F.lit(0.85), w))


def adaptive_blend(history: DataFrame, forecasts: DataFrame, value: str, keys: Sequence[str], thresholds: DataFrame, base: float) -> DataFrame:
    """Blend of two forecasts (columns calm, spiky) whose daily weight reads the blended past."""
    def step(hist, row):
        m30 = mean_of(hist, 30)
        safe = F.when(F.abs(m30) > 1e-6, m30)
        w = adaptive_weight(lag_of(hist, 7) / safe, std_of(hist, 30) / safe, lag_of(hist, 365) / safe, F.col("volatility_threshold"), base)
        return w * row["spiky"] + (1.0 - w) * row["calm"]

    return fold_forecast(history, forecasts, value, keys, step, thresholds)
