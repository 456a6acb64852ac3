"""Robust and quantile regression by reweighted moments, logistic regression by Newton steps.

Each step is one aggregation: rows are weighted by the residuals of the models before, and weighted
moments give the next ones, for any number of groups at once. Nothing but k x k systems leaves Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleflow.operators.models import fit_from_moments, fit_ridge, linear, moments, score

STEPS = 6
EPSILON = 1.35  # residuals beyond so many scales count by their size, not its square


def _dense(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.na.drop(subset=[label, *features])


def fit_huber(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str], epsilon: float = EPSILON, steps: int = STEPS) -> DataFrame:
    """One row per group: n, coef = [intercept, slopes...] and scale.

    Minimises scale + Huber loss of residual / scale over coefficients and scale together: rows beyond
    ``epsilon`` scales get the weight epsilon * scale / |residual|, and the squared scale is the inliers' sum of
    squares over n - epsilon^2 * outliers. Rows with a missing value do not count; a group that is fitted
    without error keeps scale 0 and its coefficients.
    """
    rows, by, k = _dense(df, features, label), list(by), len(features)
    r = F.col(label) - F.col("_p")
    square, far = F.sum(F.when(F.abs(r) <= F.col("_limit"), r * r)), F.count_if(F.abs(r) > F.col("_limit"))
    scale = F.sqrt(F.coalesce(F.col("_in"), F.lit(0.0)) / F.greatest(F.col("_n") - epsilon**2 * F.col("_out"), F.lit(1.0)))
    model = fit_ridge(rows, features, label, 0.0, by, min_rows=1).withColumn("scale", F.lit(None).cast("double"))
    for _ in range(steps):
        known = model.select(*by, F.col("coef").alias("_coef"), F.col("scale").alias("_scale"))
        at = rows.join(known, by).withColumn("_p", linear(features, "_coef")).withColumn("_limit", F.coalesce(epsilon * F.col("_scale"), F.lit(float("inf"))))
        at = at.withColumn("_w", F.when(F.abs(r) <= F.col("_limit"), 1.0).otherwise(F.greatest(F.col("_limit"), F.lit(1e-12)) / F.abs(r)))
        sums = moments(at, features, label, by, "_w", extra=[square.alias("_in"), far.alias("_out"), F.count(F.lit(1)).alias("_n")])
        model = fit_from_moments(sums.withColumn("scale", scale), k, 0.0, [*by, "scale", "_n"], 0).select(*by, F.col("_n").alias("n"), "coef", "scale")
    return model


def fit_pinball(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str], alphas: Sequence[float], steps: int = STEPS, floor: float = 0.1) -> DataFrame:
    """One row per group and alpha: coef = [intercept, slopes...] of the alpha quantile.

    Least squares with weights alpha / |residual| above and (1 - alpha) / |residual| below the line, residuals
    not under ``floor`` times the mean |residual| of plain least squares, approach the pinball loss (smaller
    floors come closer and need more steps); the intercept is then the exact quantile of what the slopes
    leave, so the share of training rows below the line is alpha up to one row.
    """
    rows = _dense(df, features, label).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    keys = [*by, "alpha"]
    model = fit_ridge(rows, features, label, 0.0, keys, min_rows=1)
    r = F.col(label) - F.col("_p")
    side = F.when(r >= 0, F.col("alpha")).otherwise(1 - F.col("alpha"))
    rows = rows.join(score(rows, model, features, keys, "_p").groupBy(*keys).agg((floor * F.avg(F.abs(r))).alias("_least")), keys)
    for _ in range(steps):
        size = F.greatest(F.abs(r), F.col("_least"), F.lit(1e-9))
        at = score(rows, model, features, keys, "_p").withColumn("_w", side / size)
        model = fit_ridge(at, features, label, 0.0, keys, "_w", min_rows=0)
    left = score(rows, model, features, keys, "_p").groupBy(*keys).agg(F.percentile(r, F.array(*map(F.lit, alphas))).alias("_q"))
    own = F.get("_q", F.array_position(F.array(*map(F.lit, alphas)), F.col("alpha")).cast("int") - 1)
    moved = F.transform("coef", lambda c, i: F.when(i == 0, c + own).otherwise(c))
    return model.join(left, keys).select(*keys, moved.alias("coef"))


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, weight: Column | None = None, penalty: float = 0.01, steps: int = STEPS) -> tuple[list[float], dict[str, tuple[float, float]]]:
    """(intercept and slopes on standardised features, mean and deviation of each feature) of a logistic
    model: Newton steps on the weighted mean log loss plus half the penalty times the squared slopes. A
    step is one aggregation of gradient and Hessian sums. Rows with a missing value do not count; a
    feature without spread has slope 0; no rows give zeros."""
    w = F.lit(1.0) if weight is None else weight
    rows = _dense(df, features, label).select(w.alias("_w"), F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    first = rows.agg(F.sum("_w").alias("w"), *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)]).first()
    places = {f: (first[f"m_{i}"] or 0.0, first[f"s_{i}"] if (first[f"s_{i}"] or 0.0) > 1e-9 else 1.0) for i, f in enumerate(features)}
    k, b = len(features) + 1, np.zeros(len(features) + 1)
    if not first["w"]:
        return b.tolist(), places
    z = [F.lit(1.0), *[(F.col(f) - m) / s for f, (m, s) in places.items()]]
    for _ in range(steps):
        odds = sum((float(c) * x for c, x in zip(b[1:], z[1:], strict=True)), F.lit(float(b[0])))
        p = 1 / (1 + F.exp(-odds))
        at = rows.select("_w", (p - F.col("_y")).alias("_e"), (p * (1 - p)).alias("_v"), *[x.alias(f"_z{i}") for i, x in enumerate(z)])
        sums = at.agg(
            *[F.sum(F.col("_w") * F.col("_e") * F.col(f"_z{i}")).alias(f"g{i}") for i in range(k)],
            *[F.sum(F.col("_w") * F.col("_v") * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)],
        ).first()
        held = penalty * np.array([0.0] + [1.0] * (k - 1))
        g = np.array([sums[f"g{i}"] for i in range(k)]) / first["w"] + held * b
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / first["w"] + np.diag(held)
        b = b - np.linalg.solve(h, g)
    return b.tolist(), places


def logistic(model: tuple[list[float], dict[str, tuple[float, float]]]) -> Column:
    """The probability of a model of ``fit_logistic``; null where a feature is missing."""
    b, places = model
    odds = sum((c * ((F.col(f) - m) / s) for c, (f, (m, s)) in zip(b[1:], places.items(), strict=True)), F.lit(b[0]))
    return 1 / (1 + F.exp(-odds))
