"""Mixing sources to target weights.

Every document gets a hash-random key. The documents are range-sorted by (source, key), each range
partition sums its token counts per source, a prefix sum over those partition totals gives every
partition its offset, and a running sum inside the partition gives every document its place in its
source's token stream. The stream is cut at the source's exact budget, after as many whole epochs
as the budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.llm.storage import materialize, without

ADDED = ("source_size", "target", "taken")


def source_targets(totals: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Targets per source from ``totals`` (source, source_size), one row per source.

    Weights repeat over the sources in code point order, null last. The sources share ``share`` times
    all tokens by weight; a target stops at ``epochs`` times its source and the excess goes to the
    others by weight until none is above. Sorting sources by cap per unit of weight makes that a
    prefix sum: the first source whose cap holds its part, and all after it, are not capped.
    The frame is as small as the list of sources; it is sorted in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = totals.withColumn("_place", F.row_number().over(by_name) - 1)
    t = t.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * int(epochs))
    t = t.withColumns({
        "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weights": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
        "_all": F.sum("source_size").over(whole),
    })
    level = (F.lit(float(share)) * F.col("_all") - F.col("_capped")) / F.col("_weights")
    t = t.withColumn("_level", level)
    # the level holds for all sources from the first whose cap is not below its part
    t = t.withColumn("_fits", F.when(F.col("_w") * F.col("_level") <= F.col("_cap"), F.col("_level")))
    t = t.withColumn("_flat", F.min(F.struct(F.col("_fits").isNull().alias("n"), (F.col("_cap") / F.col("_w")).alias("c"), "_place", F.col("_fits").alias("level"))).over(whole)["level"])
    target = F.coalesce(F.least(F.col("_w") * F.col("_flat"), F.col("_cap").cast("double")), F.col("_cap").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (of the source) and ``taken`` (tokens of the document in the mix).

    ``taken`` is a whole number of epochs of ``size`` plus, for documents before the cut in the last
    epoch, their size, and for the one document at the cut the part before it. The order is a hash of
    ``key`` and ``seed``, so reruns agree. Edge cases: null or negative sizes count as 0; a null source
    is a source of its own, the last; a null key is a key; repeated rows each have their place; rows
    equal in key, size and source are interchangeable; an empty frame gives an empty frame; input
    columns named like the added ones are replaced. Nothing is dropped, sizes of 0 included.
    """
    base = without(docs, *ADDED, "_n", "_order", "_part", "_src")
    base = base.withColumns({
        "_n": F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)),
        "_order": F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))),
        "_src": F.col(source).cast("string"),
    })
    # ties of equal keys are broken by size, so a key that many rows share still spreads over ranges
    ranged = base.repartitionByRange(F.col("_src").asc_nulls_last(), "_order", "_n").sortWithinPartitions(F.col("_src").asc_nulls_last(), "_order", "_n")
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "mix")

    parts = ranged.groupBy("_src", "_part").agg(F.sum("_n").alias("_sum"))
    up_to = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)))
    targets = source_targets(parts.groupBy(F.col("_src").alias("source")).agg(F.sum("_sum").alias("source_size")), weights, share, epochs)
    parts = parts.join(targets, parts["_src"].eqNullSafe(targets["source"])).select(F.col("_src").alias("_psrc"), F.col("_part").alias("_ppart"), "_offset", "source_size", "target")

    inside = Window.partitionBy("_part", "_src").orderBy("_order", "_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    placed = placed.join(parts, (F.col("_part") == F.col("_ppart")) & F.col("_src").eqNullSafe(F.col("_psrc")))
    start = F.col("_offset") + F.col("_before")
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * int(epochs))
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - rounds * F.col("source_size")
    last = F.least(F.greatest(rest - start, F.lit(0)), F.col("_n"))
    placed = placed.withColumn("taken", rounds * F.col("_n") + last)
    return placed.select(*[F.col(f"`{c}`") for c in without(docs, *ADDED).columns], "source_size", "target", "taken")


def repeat_taken(mixed: DataFrame, size: str = "size", text: str = "text", word: str = r"[^\x20\x09-\x0D]+", gap: str = r"[\x20\x09-\x0D]*") -> DataFrame:
    """The rows of a mix: a document once per epoch it is taken whole, and its first words where the
    budget ends inside it. Input: the result of :func:`mix_sources`. Documents of size 0 take no part."""
    n, taken = F.coalesce(F.col(size).cast("long"), F.lit(0)), F.col("taken")
    full = F.when(n > 0, F.floor(taken / n)).otherwise(0)
    left = F.when(n > 0, taken - full * n).otherwise(0).cast("long")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), full.cast("int")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<long>")))
    rows = mixed.withColumn("_cut", F.explode(copies))
    words = F.slice(F.regexp_extract_all(F.col(text), F.lit(gap + word), F.lit(0)), F.lit(1), F.greatest(F.col("_cut"), F.lit(1)).cast("int"))
    return rows.withColumn(text, F.when(F.col("_cut") > 0, F.array_join(words, "")).otherwise(F.col(text))).drop("_cut")
