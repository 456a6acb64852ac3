"""Daily aggregates of orders, items, traffic, stock and returns.

Every function groups a fact to its day (or to a small key set) with map-side partial
aggregation. NULL keys are dropped first; sums of nothing are 0; means of nothing stay NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleflow.functions.scalars import div_fill, div_zero


def daily_sales(sales: DataFrame) -> DataFrame:
    return sales.where("date is not null").groupBy("date").agg(
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"), F.coalesce(F.sum("cogs"), F.lit(0.0)).alias("cogs")
    )


def daily_orders(orders: DataFrame) -> DataFrame:
    """Distinct orders and customers per day. Spark de-duplicates on (day, id) before counting,
    so a customer with very many orders is one row per day."""
    return orders.where("date is not null").groupBy("date").agg(
        F.countDistinct("order_id").alias("orders_count"), F.countDistinct("customer_id").alias("unique_customers")
    )


def daily_items(lines: DataFrame, unit: int = 1) -> DataFrame:
    """Line counts, quantities and discounts; keeps the mean of line rates and the ratio of sums.
    Amounts are in 1 / ``unit`` of money."""
    rate = div_zero(F.col("discount_amount").cast("double"), F.col("gross_value").cast("double"))
    g = lines.where("date is not null").groupBy("date").agg(
        F.count(F.lit(1)).alias("item_lines_count"),
        F.sum(F.coalesce("quantity", F.lit(0.0))).alias("total_quantity"),
        (F.sum("gross_value").cast("double") / unit).alias("_gross"),
        (F.sum("discount_amount").cast("double") / unit).alias("total_discount_amount"),
        (F.sum("discount_amount").cast("double") / unit / F.count(F.lit(1))).alias("avg_discount_amount"),
        F.avg(rate).alias("avg_discount_rate"),
        F.avg("promo_used").alias("promo_usage_rate"),
    )
    return g.withColumn("discount_to_gross_rate", div_zero("total_discount_amount", "_gross")).drop("_gross")


def daily_traffic(web: DataFrame) -> DataFrame:
    """Traffic totals with session-weighted bounce rate and duration."""
    w = web.where("date is not null").na.fill(0)
    g = w.groupBy("date").agg(
        F.sum("sessions").alias("web_sessions"), F.sum("unique_visitors").alias("web_unique_visitors"),
        F.sum("page_views").alias("web_page_views"), F.sum(F.col("bounce_rate") * F.col("sessions")).alias("_b"),
        F.sum(F.col("avg_session_duration_sec") * F.col("sessions")).alias("_d"),
    )
    return g.select(
        "date", "web_sessions", "web_unique_visitors", "web_page_views",
        div_zero("_b", "web_sessions").alias("web_bounce_rate"),
        div_zero("_d", "web_sessions").alias("web_avg_session_duration_sec"),
        F.lit(1).alias("web_traffic_available"),
    )


def daily_traffic_wide(web: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Unweighted means, number of active sources and sessions per source (explicit pivot list)."""
    per_source = [
        F.coalesce(F.sum(F.when(F.col("traffic_source") == v, F.col("sessions"))), F.lit(0.0)).alias(f"{v}_sessions") for v in sources
    ]
    return web.where("date is not null").groupBy("date").agg(
        F.sum("sessions").alias("sessions_sum"), F.sum("unique_visitors").alias("unique_visitors_sum"),
        F.sum("page_views").alias("page_views_sum"), F.avg("bounce_rate").alias("avg_bounce_rate"),
        F.avg("avg_session_duration_sec").alias("avg_session_duration_sec"),
        F.countDistinct("traffic_source").alias("source_diversity_count"), *per_source,
    )


def snapshot_aggregate(inventory: DataFrame) -> DataFrame:
    """Stock totals and rates per snapshot date; optional columns only when present."""
    optional = {"days_of_supply": "inventory_days_of_supply", "overstock_flag": "inventory_overstock_rate", "reorder_flag": "inventory_reorder_rate"}
    extra = [F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(n) for c, n in optional.items() if c in inventory.columns]
    i = inventory.where("snapshot_date is not null").na.fill(0)
    return i.groupBy(F.col("snapshot_date").alias("date")).agg(
        F.countDistinct("product_id").alias("inventory_product_count"),
        F.sum("stock_on_hand").alias("inventory_stock_on_hand"), F.sum("units_received").alias("inventory_units_received"),
        F.sum("units_sold").alias("inventory_units_sold"), F.sum("stockout_days").alias("inventory_stockout_days"),
        F.avg("stockout_flag").alias("inventory_stockout_rate"), F.avg("fill_rate").alias("inventory_fill_rate"),
        F.avg("sell_through_rate").alias("inventory_sell_through_rate"), *extra,
    )


def snapshot_median(inventory: DataFrame, col: str) -> DataFrame:
    """Exact median per snapshot date. Values are reduced to (date, value, count) first and the
    middle ranks are found per value bucket, so the products of one date never meet in one task."""
    from aisleflow.operators.quantiles import exact_quantiles

    q = exact_quantiles(inventory.where("snapshot_date is not null").na.fill(0, [col]), col, [0.5], ["snapshot_date"])
    return q.select(F.col("snapshot_date").alias("date"), F.col("value").alias(f"median_{col}"))


def stock_snapshot_features(inventory: DataFrame) -> DataFrame:
    """Operational stock signals per snapshot date, including build-up against the mean of the
    three snapshots before."""
    i = inventory.where("snapshot_date is not null").na.fill(0)
    g = i.groupBy(F.col("snapshot_date").alias("date")).agg(
        F.avg("days_of_supply").alias("inv_avg_days_of_supply"), F.min("days_of_supply").alias("inv_min_days_of_supply"),
        F.avg("sell_through_rate").alias("inv_avg_sell_through_rate"), F.avg("stockout_flag").alias("inv_stockout_rate"),
        F.avg("reorder_flag").alias("inv_reorder_rate"), F.avg("fill_rate").alias("inv_fill_rate_mean"),
        F.avg("overstock_flag").alias("inv_overstock_rate"), F.sum("stock_on_hand").alias("stock_on_hand_sum"),
        F.sum("units_received").alias("units_received_sum"),
    )
    g = g.join(snapshot_median(inventory, "days_of_supply").withColumnRenamed("median_days_of_supply", "inv_median_days_of_supply"), "date", "left")
    last3 = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-3, -1)
    recent = F.avg("stock_on_hand_sum").over(last3)
    return g.select(
        "*",
        F.try_divide(F.col("units_received_sum"), F.col("stock_on_hand_sum")).alias("restock_signal"),
        F.try_divide(F.col("stock_on_hand_sum"), recent).alias("stock_build_up"),
        F.try_divide(F.col("inv_avg_sell_through_rate"), F.col("inv_avg_days_of_supply")).alias("stock_pressure"),
        (F.col("inv_stockout_rate") * F.col("inv_avg_sell_through_rate")).alias("stockout_pressure"),
    )


def daily_returns(returns: DataFrame, unit: int = 1) -> DataFrame:
    return returns.where("date is not null").groupBy("date").agg(
        F.countDistinct("return_id").alias("returns_count"), F.countDistinct("order_id").alias("returned_orders_count"),
        F.coalesce(F.sum("return_quantity"), F.lit(0.0)).alias("return_quantity"),
        F.coalesce(F.sum("refund_amount").cast("double") / unit, F.lit(0.0)).alias("refund_amount"),
    )


def daily_order_level(lines: DataFrame, orders: DataFrame, unit: int = 1) -> DataFrame:
    """Two stages: one row per order (any promoted line, lines, net value), then per day of ``orders``
    (order_id, date). Lines fold to their order before they meet it."""
    folded = lines.groupBy("order_id").agg(F.max("promo_used").alias("promo_order"), F.count(F.lit(1)).alias("lines"), F.sum("net_value").alias("net"))
    per_order = folded.join(orders.select("order_id", "date"), "order_id").groupBy("date", "order_id").agg(
        F.max("promo_order").alias("promo_order"), F.sum("lines").alias("lines"), F.sum("net").alias("net")
    )
    return per_order.groupBy("date").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("promo_order").alias("promo_orders"), F.avg("lines").alias("lines_per_order"),
        (F.max("net").cast("double") / unit).alias("largest_order"),
    )


def pivot_counts(df: DataFrame, col: str, values: Sequence[str], prefix: str) -> DataFrame:
    """Rows per day and value; an explicit value list keeps it to one aggregation."""
    aggs = [F.count_if(F.col(col) == v).alias(f"{prefix}_{i}") for i, v in enumerate(values, 1)]
    return df.where("date is not null").groupBy("date").agg(*aggs)


def top_k_groups(df: DataFrame, key: str, value: Column, k: int) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(k)


def mix_shares(lines: DataFrame, col: str, value: str, k: int = 3, until: Column | None = None) -> DataFrame:
    """Share of the ``k`` largest groups in each day's value. The groups are ranked on history
    up to ``until`` only, so later days cannot change which groups are followed."""
    per = lines.where(F.col("date").isNotNull() & F.col(col).isNotNull()).groupBy("date", col).agg(F.sum(value).cast("double").alias("_v"))
    ranked_on = per if until is None else per.where(F.col("date") <= until)
    top = top_k_groups(ranked_on, col, F.col("_v"), k)
    ranked = top.select(col, F.row_number().over(Window.orderBy(F.desc("total"), col)).alias("_rank"))
    joined = per.join(ranked, col, "left")
    total = F.sum("_v")
    shares = [div_zero(F.sum(F.when(F.col("_rank") == r, F.col("_v"))), total).alias(f"share_{r}") for r in range(1, k + 1)]
    return joined.groupBy("date").agg(*shares)


def status_counts(orders: DataFrame, cancelled: Sequence[str], fulfilled: Sequence[str]) -> DataFrame:
    s = F.col("order_status")
    return orders.where("date is not null").groupBy("date").agg(
        F.count_if(s.isin(list(cancelled))).alias("cancelled_orders"), F.count_if(s.isin(list(fulfilled))).alias("fulfilled_orders")
    )


def promo_item_share(lines: DataFrame) -> DataFrame:
    return lines.where("date is not null").groupBy("date").agg(
        F.sum("promo_used").alias("promo_items"), (F.sum("promo_used") / F.count(F.lit(1))).alias("promo_item_share")
    )


def funnel_ratios(daily: DataFrame) -> DataFrame:
    """Order value, conversion and unit ratios of a daily fact; 0 where the base is 0."""
    return daily.select(
        "*",
        div_fill("revenue", "orders_count").alias("aov"),
        div_fill("orders_count", "web_sessions").alias("conversion_rate"),
        div_fill("revenue", "web_sessions").alias("revenue_per_session"),
        div_fill("quantity", "orders_count").alias("items_per_order"),
        div_fill("cogs", "orders_count").alias("cogs_per_order"),
        div_fill("revenue", "quantity").alias("unit_price"),
        div_fill("cogs", "revenue").alias("cogs_ratio"),
        div_fill("unique_customers", "orders_count").alias("customers_per_order"),
        div_fill("web_page_views", "web_sessions").alias("pages_per_session"),
    )
