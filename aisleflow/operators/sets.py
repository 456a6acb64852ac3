"""Sorting, top-k and set operators on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worst_n(df: DataFrame, error: str, n: int, tiebreak: Sequence[str]) -> DataFrame:
    """Rows with the largest absolute error; a bounded top-k per partition, no full sort."""
    return df.orderBy(F.desc(F.abs(F.col(error))), *tiebreak).limit(n)


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep one row per key, the last under ``order`` (map-side reduced with max_by)."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def rank_features(importance: DataFrame, n: int) -> DataFrame:
    """Top-n features; positive importance first, one row per feature."""
    one = importance.groupBy("feature").agg(F.max("importance").alias("importance"))
    return one.orderBy((F.col("importance") <= 0).cast("int"), F.desc("importance"), "feature").limit(n)


def feature_sets(importance: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Nested top-k feature sets in long form: (set_size, position, feature)."""
    w = Window.orderBy(F.desc("importance"), "feature")
    ranked = importance.withColumn("position", F.row_number().over(w))
    sets = F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: F.col("position") <= k)
    return ranked.select(F.explode(sets).alias("set_size"), "position", "feature", "importance")


def group_presence(importance: DataFrame, prefixes: dict[str, str], n: int) -> DataFrame:
    """Which feature groups occur among the n most important features."""
    top = rank_features(importance, n)
    aggs = [F.count_if(F.startswith("feature", F.lit(p))).alias(g) for g, p in prefixes.items()]
    names = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.col(g).alias("members"), (F.col(g) > 0).alias("present")) for g in prefixes])
    return top.agg(*aggs).select(F.inline(names))


def in_dates(df: DataFrame, dates: DataFrame, col: str = "date") -> DataFrame:
    return df.join(dates.select(F.col("date").alias(col)).distinct(), col, "left_semi")
