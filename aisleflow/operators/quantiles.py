"""Exact quantiles and ranks that stay distributed.

Values are first reduced to (value, count), so a hot value is one row. Where the number of
distinct values is bounded (day gaps, sizes) a weighted percentile finishes the job. For
unbounded values the rows are split into value buckets; only bucket totals are compared
globally and each quantile is read from the single bucket that holds its rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_percentile(value: str, p: float | Sequence[float], weight: str) -> Column:
    """Exact linear-interpolated percentile of a (value, count) histogram."""
    prob = F.lit(p) if isinstance(p, float) else F.array(*[F.lit(x) for x in p])
    return F.percentile(F.col(value), prob, F.col(weight))


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values with their row counts."""
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))


def bucket_count(df: DataFrame) -> int:
    """As many value buckets as shuffle partitions, 32 at least."""
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucketed(hist: DataFrame, rows: DataFrame, col: str, out: str = "_b") -> DataFrame:
    """Number each value of ``hist`` by approximate splitters of ``rows``. The splitters only balance
    the buckets; numbering is monotone in the value, so ranks built on it stay exact."""
    from pyspark.ml.feature import Bucketizer

    n = bucket_count(rows)
    sketch = F.percentile_approx(col, [i / n for i in range(1, n)], max(1000, 10 * n))
    found = rows.agg(sketch.alias("s")).first()["s"] or []
    splits = sorted(set(found))
    if not splits:
        return hist.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol=col, outputCol="_bucket", handleInvalid="keep")
    return cut.transform(hist).withColumn(out, F.col("_bucket").cast("int")).drop("_bucket")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles in long form: (*by, p, value)."""
    by = list(by)
    rows = df.select(*by, F.col(col).cast("double").alias("_v")).where("_v is not null")
    hist = bucketed(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), rows, "_v")
    per_bucket = hist.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"))
    over_all = Window.partitionBy(*(by or [F.lit(0)]))  # one row per bucket and group
    placed = per_bucket.select(
        *by,
        "_b",
        (F.sum("_bn").over(over_all.orderBy("_b")) - F.col("_bn")).alias("_before"),
        F.col("_bn"),
        F.sum("_bn").over(over_all).alias("_total"),
    )
    wanted = placed.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumn("_pos", F.col("p") * (F.col("_total") - 1))
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    wanted = wanted.where("_rank >= _before and _rank < _before + _bn")
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("_upto", F.sum("_n").over(inside))
    hit = ranked.join(wanted, [*by, "_b"], "inner").where(
        "_rank - _before < _upto and _rank - _before >= _upto - _n"
    )
    lo = F.min("_v")
    hi = F.max("_v")
    frac = F.max(F.col("_pos") - F.floor("_pos"))
    return hit.groupBy(*by, "p").agg((lo + (hi - lo) * frac).alias("value"))


def quantile_columns(df: DataFrame, col: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` turned sideways: one row per group, one column per name."""
    q = exact_quantiles(df, col, sorted(set(probs.values())), by)
    picks = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in probs.items()]
    return q.groupBy(*by).agg(*picks)
