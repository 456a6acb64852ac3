"""Forecast models that train as Spark jobs.

Linear models are fitted from moments (counts, sums, cross products), which Spark adds up per
group: any number of series, regimes, windows or folds is one aggregation, and only k x k
systems reach the small numpy solver. Trees of any depth come from pyspark.ml; boosting from moments is
in ``boosting``, robust, quantile and logistic models are in ``robust``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleflow.functions.scalars import clip

Z = 1e-9
ROUNDS = 360  # of boosted trees, at most


# -- ridge from moments -------------------------------------------------------------
def moment_names(k: int) -> list[str]:
    return ["n", "sy", *[f"sx_{i}" for i in range(k)], *[f"sxy_{i}" for i in range(k)], *[f"sxx_{i}_{j}" for i in range(k) for j in range(i, k)]]


def moments(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str], weight: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Sufficient statistics per group over rows where the label and all features are present, and
    further aggregates of the same pass."""
    rows = df.na.drop(subset=[*features, label])
    w = F.lit(1.0) if weight is None else F.col(weight)
    k = len(features)
    x = [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    aggs = [F.sum(w).alias("n"), F.sum(w * y).alias("sy")]
    aggs += [F.sum(w * x[i]).alias(f"sx_{i}") for i in range(k)] + [F.sum(w * x[i] * y).alias(f"sxy_{i}") for i in range(k)]
    aggs += [F.sum(w * x[i] * x[j]).alias(f"sxx_{i}_{j}") for i in range(k) for j in range(i, k)]
    return rows.groupBy(*by).agg(*aggs, *extra)


def solve_ridge(k: int, alpha: float):
    """pandas UDF: moments -> [intercept, coefficients] of ridge on standardised features."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(packed: pd.Series) -> pd.Series:
        out = []
        for m in packed:
            v = np.asarray(m, dtype=float)
            n, sy, sx, sxy = v[0], v[1], v[2 : 2 + k], v[2 + k : 2 + 2 * k]
            sxx = np.zeros((k, k))
            sxx[np.triu_indices(k)] = v[2 + 2 * k :]
            sxx = sxx + sxx.T - np.diag(np.diag(sxx))
            mean, my = sx / n, sy / n
            cov = sxx / n - np.outer(mean, mean)
            cxy = sxy / n - mean * my
            flat = np.diag(cov) <= 1e-12 * np.diag(sxx) / n  # constant up to rounding: slope 0
            cov[flat, :], cov[:, flat], cxy[flat] = 0.0, 0.0, 0.0
            sd = np.where(flat, 1.0, np.sqrt(np.maximum(np.diag(cov), 0.0)))
            a = n * cov / np.outer(sd, sd) + alpha * np.eye(k)
            b = n * cxy / sd
            coef = np.linalg.solve(a, b) / sd
            out.append([my - float(coef @ mean), *coef.tolist()])
        return pd.Series(out)

    return solve


def fit_from_moments(stats: DataFrame, k: int, alpha: float, by: Sequence[str], min_rows: int = 3) -> DataFrame:
    packed = F.array(*[F.col(c).cast("double") for c in moment_names(k)])
    return stats.where(F.col("n") >= min_rows).select(*by, "n", solve_ridge(k, alpha)(packed).alias("coef"))


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float, by: Sequence[str], weight: str | None = None, min_rows: int = 3) -> DataFrame:
    """One row per group: n and coef = [intercept, slopes...]."""
    return fit_from_moments(moments(df, features, label, by, weight), len(features), alpha, by, min_rows)


def linear(features: Sequence[str], coef: str = "coef") -> Column:
    out = F.get(coef, F.lit(0))
    for i, f in enumerate(features, 1):
        out = out + F.get(coef, F.lit(i)) * F.col(f)
    return out


def score(df: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str], out: str = "predicted") -> DataFrame:
    j = df.join(models.select(*by, F.col("coef").alias("_coef")), list(by), "left")
    return j.withColumn(out, linear(features, "_coef")).drop("_coef")


def fit_with_fallback(df: DataFrame, features: Sequence[str], label: str, alpha: float, key: str, group: str, min_rows: int) -> DataFrame:
    """One model per (key, group); groups with few rows use the model of the whole key."""
    per = moments(df, features, label, [key, group])
    names = moment_names(len(features))
    whole = per.groupBy(key).agg(*[F.sum(c).alias(c) for c in names])
    small = per.where(F.col("n") < min_rows).select(key, group).join(whole, key)
    return fit_from_moments(per.where(F.col("n") >= min_rows).unionByName(small), len(features), alpha, [key, group])


def walk_forward(df: DataFrame, features: Sequence[str], label: str, fold: str, alpha: float, key: str, min_rows: int, out: str, default: Column) -> DataFrame:
    """Each fold is predicted by the model of all earlier folds. Moments are summed per fold and
    accumulated over folds, so all models come from one pass over the rows; folds with fewer than
    ``min_rows`` earlier rows pass ``default`` through."""
    k = len(features)
    folds = df.select(key, fold).distinct()
    per = folds.join(moments(df, features, label, [key, fold]), [key, fold], "left")
    before = Window.partitionBy(key).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    cum = per.select(key, fold, *[F.sum(c).over(before).alias(c) for c in moment_names(k)])
    models = fit_from_moments(cum, k, alpha, [key, fold], min_rows)
    scored = score(df, models, features, [key, fold], "_p")
    return scored.withColumn(out, F.coalesce("_p", default)).drop("_p")


# -- weights ---------------------------------------------------------------------------
def quantile_weights(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """2 from the 80th and 3 from the 90th percentile of the label on, else 1."""
    q = F.percentile(label, F.array(F.lit(0.8), F.lit(0.9)))
    lv = df.groupBy(*by).agg(q.alias("_q"))
    w = F.when(F.col(label) >= F.col("_q")[1], 3.0).when(F.col(label) >= F.col("_q")[0], 2.0).otherwise(1.0)
    return df.join(lv, list(by)).withColumn("target_weight", w).drop("_q")


def recency_weight(day: str, first_break: int, second_break: int) -> Column:
    """0.5 up to the first year, 0.8 up to the second, 1.2 after."""
    y = F.year(day)
    return F.when(y <= first_break, 0.5).when(y <= second_break, 0.8).otherwise(1.2)


def promo_weight(flag: str) -> Column:
    return F.when(F.col(flag) > 0, 1.6).otherwise(1.0)


# -- forecasts built on a base ---------------------------------------------------------
def conformal_quantile(df: DataFrame, calib: Column, by: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Mean forecast plus the residual quantile of its regime on the calibration rows."""
    res = df.where(calib).groupBy(*by).agg(F.percentile(F.col("actual") - F.col("predicted"), F.array(*[F.lit(a) for a in alphas])).alias("_q"))
    j = df.where(~calib).join(res, list(by), "left")
    return j.select(*df.columns, *[clip(F.col("predicted") + F.col("_q")[i], lo=0).alias(f"q{round(a * 100)}") for i, a in enumerate(alphas)])


def ratio_targets(df: DataFrame, label: str, baseline: str) -> DataFrame:
    """target_ratio and its log; rows need a positive baseline."""
    r = F.when(F.col(baseline) > 0, F.col(label) / F.col(baseline))
    return df.select("*", r.alias("target_ratio"), F.log(clip(r, lo=1e-6)).alias("target_log_ratio"))


def from_ratio(baseline: str, ratio: Column, lo: float, hi: float) -> Column:
    return clip(F.col(baseline) * clip(ratio, lo, hi), lo=0)


def compose(orders: Column, aov: Column, shape: Column | None = None) -> Column:
    """Orders x order value; with a shape forecast 0.70 / 0.30 stabilised."""
    raw = clip(orders * aov, lo=0)
    return raw if shape is None else clip(0.70 * raw + 0.30 * F.coalesce(shape, raw), lo=0)


# -- pyspark.ml models ------------------------------------------------------------------
def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as a vector. A missing value fails the job: impute before (``fit_medians``), so that no
    row is dropped from training or scoring."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, validation: str | None = None, **params):
    """Trees of pyspark.ml, ``ROUNDS`` of them at most. With a boolean ``validation`` column boosting stops
    once a round lowers the error on those rows by less than ``validationTol``."""
    from pyspark.ml.regression import GBTRegressor

    kw = {"maxIter": ROUNDS if validation else 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42, "subsamplingRate": 0.9, **params}
    if weight is not None:
        kw["weightCol"] = weight
    if validation is not None:
        kw |= {"validationIndicatorCol": validation, "validationTol": 0.01}
    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="predicted", **kw).fit(assembled(df, features))


def tree_importance(spark, model, features: Sequence[str]) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in rows])))


def permutation_importance(df: DataFrame, models: DataFrame, features: Sequence[str], key: str = "series_id") -> DataFrame:
    """RMSE increase when one feature is shuffled within its series. The shuffle is the order of a
    hash of date and feature name, so it is repeatable."""
    from aisleflow.operators import metrics as mt

    numbered = df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("date")))
    base = mt.regression_metrics(score(numbered, models, features, [key]), [key]).select(key, F.col("rmse").alias("base_rmse"))
    parts = []
    for f in features:
        h = F.md5(F.concat(F.col("date").cast("string"), F.lit(f)))
        moved = df.select(key, F.row_number().over(Window.partitionBy(key).orderBy(h, "date")).alias("_i"), F.col(f).alias("_f"))
        shuffled = numbered.join(moved, [key, "_i"]).withColumn(f, F.col("_f"))
        m = mt.regression_metrics(score(shuffled, models, features, [key]), [key])
        parts.append(m.select(key, F.lit(f).alias("feature"), F.col("rmse").alias("shuffled_rmse")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(base, key).withColumn("importance", F.col("shuffled_rmse") - F.col("base_rmse"))


def select_features(importance: DataFrame, corr: DataFrame, threshold: float, at_most: int) -> DataFrame:
    """Greedy pass in importance order that skips features correlated with one already kept. Both
    inputs are as small as the list of feature names, so the pass is one array fold."""
    pairs = F.collect_list(F.struct(F.concat_ws("|", "left", "right").alias("k"), F.abs("corr").alias("v")))
    both = corr.unionByName(corr.select(F.col("right").alias("left"), F.col("left").alias("right"), "corr")).where("left <> right").distinct()
    lookup = both.agg(F.map_from_entries(pairs).alias("m")).select("m").scalar()
    ranked = importance.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature"))), lambda s: s["feature"]).alias("names"))
    one = ranked.select("names", lookup.alias("m"))

    def keep(acc, x):
        clash = F.exists(acc, lambda kept: F.coalesce(F.try_element_at(F.col("m"), F.concat_ws("|", kept, x)), F.lit(0.0)) >= threshold)
        return F.when(clash | (F.size(acc) >= at_most), acc).otherwise(F.concat(acc, F.array(x)))

    start = F.array().cast("array<string>")
    return one.select(F.posexplode(F.aggregate("names", start, keep)).alias("position", "feature"))
