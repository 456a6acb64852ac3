"""Transaction fact, reconciliation to official totals and the level hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleflow.functions.scalars import units

UNKNOWN, NO_PROMO = "UNKNOWN", "NO_PROMO"

# Level names, ids and series prefixes of the hierarchy.
LEVELS = {"TOTAL": 0, "CATEGORY": 1, "SEGMENT": 2, "CATEGORY_PROMO": 3, "REGION": 4}


def build_fact(items: DataFrame, orders: DataFrame, products: DataFrame, geography: DataFrame, promos: DataFrame) -> DataFrame:
    """Item lines with date, product attributes, region and campaign (primary promotion, else
    secondary). Dimensions are joined without hints: Catalyst broadcasts those under its size
    threshold and AQE splits skewed sort-merge partitions for the rest."""
    names = promos.select("promo_id", F.col("promo_name_base").alias("_campaign"))
    joined = (
        items.join(orders, "order_id", "left")
        .join(products, "product_id", "left")
        .join(geography, "customer_id", "left")
        .join(names.withColumnRenamed("_campaign", "_primary"), "promo_id", "left")
        .join(names.select(F.col("promo_id").alias("promo_id_2"), F.col("_campaign").alias("_secondary")), "promo_id_2", "left")
    )
    return joined.where("date is not null").select(
        "date", "order_id", "product_id", "quantity",
        *[F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("category", "segment", "region")],
        F.coalesce("_primary", "_secondary", F.lit(NO_PROMO)).alias("campaign_base"),
        F.greatest(F.col("net_value"), F.lit(0)).alias("raw_revenue"),
        (F.col("quantity") * F.coalesce("unit_cost", F.lit(0.0))).alias("raw_cogs"),
    )


def folded_lines(items: DataFrame, orders: DataFrame, products: DataFrame, geography: DataFrame, promos: DataFrame) -> DataFrame:
    """Lines summed per (date, category, segment, region, primary promotion, secondary promotion id).

    Products and promotions have one row per key and meet the lines first, without hints: while Catalyst
    may broadcast them that moves no line. The one exchange of lines is the join with their orders, which have
    got their region before, and its rows fold at once to a grain bounded by the calendar and the
    levels. A secondary id is kept only where there is no primary promotion to prevail over it."""
    by_order = orders.join(geography, "customer_id", "left").where("date is not null").select("order_id", "date", F.coalesce("region", F.lit(UNKNOWN)).alias("region"))
    names = promos.select("promo_id", F.col("promo_name_base").alias("_primary"))
    lines = _named(items.join(products, "product_id", "left"), names, "promo_id", "order_id").select(
        "order_id", *[F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("category", "segment")], "_primary", F.when(F.col("_primary").isNull(), F.col("promo_id_2")).alias("promo_id_2"),
        F.greatest(F.col("net_value"), F.lit(0)).alias("_revenue"), units(F.col("quantity") * F.coalesce("unit_cost", F.lit(0.0))).alias("_cogs"), "quantity",
    )
    return lines.join(by_order, "order_id").groupBy("date", "category", "segment", "region", "_primary", "promo_id_2").agg(
        F.sum("_revenue").alias("raw_revenue"), F.sum("_cogs").alias("raw_cogs"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("item_lines"),
    )


def _named(df: DataFrame, names: DataFrame, key: str, other: str) -> DataFrame:
    """Left join on an id that most rows lack: those get keys of their own, made of another column, so that
    nulls never gather in one partition where the join is a shuffle."""
    own = F.coalesce(key, F.concat(F.lit("none/"), F.coalesce(F.col(other).cast("string"), F.lit(""))))
    return df.withColumn("_key", own).join(names.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def compact_lines(items: DataFrame, orders: DataFrame, products: DataFrame, geography: DataFrame, promos: DataFrame) -> DataFrame:
    """The lines of :func:`build_fact` reduced to the finest grain any level needs: ``folded_lines``, whose
    rows then meet the secondary promotions."""
    folded = folded_lines(items, orders, products, geography, promos)
    names = promos.select(F.col("promo_id").alias("promo_id_2"), F.col("promo_name_base").alias("_secondary"))
    return _named(folded, names, "promo_id_2", "date").groupBy("date", "category", "segment", "region", F.coalesce("_primary", "_secondary", F.lit(NO_PROMO)).alias("campaign_base")).agg(
        *[F.sum(c).alias(c) for c in ("raw_revenue", "raw_cogs", "quantity", "item_lines")],
    )


def reconcile_to_total(fact: DataFrame, totals: DataFrame) -> DataFrame:
    """Scale line revenue and COGS so that each day adds up to the official figures. Days with no
    line value keep factor 1."""
    day = fact.groupBy("date").agg(F.sum("raw_revenue").alias("_r"), F.sum("raw_cogs").alias("_c"))
    t = day.join(totals.select("date", F.col("revenue").alias("_tr"), F.col("cogs").alias("_tc")), "date", "left")

    def factor(total: str, raw: str) -> Column:
        return F.when((F.col(raw) > 1e-9) & F.col(total).isNotNull(), F.col(total) / F.col(raw)).otherwise(F.lit(1.0))

    scales = t.select("date", factor("_tr", "_r").alias("revenue_scale"), factor("_tc", "_c").alias("cogs_scale"))
    return fact.join(scales, "date", "left").select(
        *fact.columns, "revenue_scale", "cogs_scale",
        (F.col("raw_revenue") * F.coalesce("revenue_scale", F.lit(1.0))).alias("revenue"),
        (F.col("raw_cogs") * F.coalesce("cogs_scale", F.lit(1.0))).alias("cogs"),
    )


def _measures() -> list[Column]:
    return [F.sum("revenue").alias("target_revenue"), F.sum("cogs").alias("target_cogs"), F.sum("quantity").alias("target_quantity"), F.sum("item_lines").alias("target_item_lines")]


def level_aggregate(fact: DataFrame, level: str, keys: list[str], prefix: str) -> DataFrame:
    """One level of the hierarchy on the common schema; keys not used are 'ALL'."""
    g = fact.groupBy("date", *keys).agg(*_measures())
    sid = F.concat_ws("::", F.lit(prefix), *keys) if keys else F.lit(prefix)
    dims = [F.col(c) if c in keys else F.lit("ALL").alias(c) for c in ("category", "segment", "region", "campaign_base")]
    return g.select("date", sid.alias("series_id"), F.lit(level).alias("level"), F.lit(LEVELS[level]).alias("level_id"), *dims, "target_revenue", "target_cogs", "target_quantity", "target_item_lines")


def hierarchy(fact: DataFrame) -> DataFrame:
    """All levels in one pass with grouping sets over the compact fact."""
    dims = ["category", "segment", "region", "campaign_base"]
    sets = [["date"], ["date", "category"], ["date", "segment"], ["date", "region"], ["date", "category", "campaign_base"]]
    g = fact.groupingSets([[F.col(c) for c in x] for x in sets], F.col("date"), *[F.col(c) for c in dims]).agg(*_measures(), *[F.grouping(c).alias(f"_g_{c}") for c in dims])
    used = {c: F.col(f"_g_{c}") == 0 for c in dims}
    level = (
        F.when(used["campaign_base"], "CATEGORY_PROMO").when(used["category"], "CATEGORY").when(used["segment"], "SEGMENT").when(used["region"], "REGION").otherwise("TOTAL")
    )
    sid = (
        F.when(used["campaign_base"], F.concat_ws("::", F.lit("CATPROMO"), "category", "campaign_base"))
        .when(used["category"], F.concat_ws("::", F.lit("CAT"), "category"))
        .when(used["segment"], F.concat_ws("::", F.lit("SEG"), "segment"))
        .when(used["region"], F.concat_ws("::", F.lit("REG"), "region"))
        .otherwise("TOTAL")
    )
    out = g.select(
        "date", sid.alias("series_id"), level.alias("level"),
        *[F.when(used[c], F.col(c)).otherwise("ALL").alias(c) for c in dims],
        "target_revenue", "target_cogs", "target_quantity", "target_item_lines",
    )
    return out.where((F.col("level") != "CATEGORY_PROMO") | (F.col("campaign_base") != NO_PROMO))


def densify(df: DataFrame, keys: list[str], lo: Column, hi: Column, fill: list[str]) -> DataFrame:
    """Every key on every day of [lo, hi]; measures 0 where absent. Days are generated per key row,
    so no cross join is needed."""
    grid = df.select(*keys).distinct().withColumn("date", F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))))
    return grid.join(df, [*keys, "date"], "left").na.fill(0, fill)
