"""The ten ad-hoc questions about orders, returns, traffic, regions and payments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aisleflow.functions.scalars import cents
from aisleflow.operators.quantiles import value_counts, weighted_percentile
from aisleflow.plans.registry import query
from aisleflow.plans.sqlbase import sql

# The answer options in days and the size labels.
GAP_OPTIONS = [30, 90, 144, 365]
SIZES = ["S", "M", "L", "XL"]
SIZE_SQL = "CASE WHEN p_size <= 12 THEN 'S' WHEN p_size <= 25 THEN 'M' WHEN p_size <= 38 THEN 'L' ELSE 'XL' END"


def size_label(col: str):
    c = F.col(col)
    return F.when(c <= 12, "S").when(c <= 25, "M").when(c <= 38, "L").otherwise("XL")


@query(
    "order_gap_days",
    "gap_count:i median_gap:4 q1_gap:4 q3_gap:4 nearest_option:i",
    sql(
        "ords",
        """SELECT gap_count, median_gap, q1_gap, q3_gap,
             (SELECT o FROM (VALUES (30), (90), (144), (365)) v(o) ORDER BY ABS(o - median_gap), o LIMIT 1) AS nearest_option
           FROM (SELECT COUNT(g) AS gap_count, QUANTILE_CONT(g, 0.5) AS median_gap, QUANTILE_CONT(g, 0.25) AS q1_gap,
                   QUANTILE_CONT(g, 0.75) AS q3_gap
                 FROM (SELECT DATE_DIFF('day', LAG(date) OVER (PARTITION BY customer_id ORDER BY date), date) AS g FROM ords
                       WHERE customer_id IS NOT NULL AND date IS NOT NULL))""",
    ),
)
def order_gap_days(s):
    """Days between consecutive orders. A customer is reduced to (day, orders) first: n orders
    on one day are n - 1 zero gaps, so a customer with a third of all orders is still small."""
    days = s.orders().where("customer_id is not null and date is not null").groupBy("customer_id", "date").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("customer_id").orderBy("date")
    days = days.withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    same_day = F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("weight"))
    to_next = F.struct(F.col("gap"), F.lit(1).cast("bigint").alias("weight"))
    gaps = days.select(F.inline(F.array(same_day, to_next)))
    hist = gaps.where("gap is not null and weight > 0").groupBy("gap").agg(F.sum("weight").alias("weight"))
    q = hist.agg(F.sum("weight").alias("gap_count"), weighted_percentile("gap", [0.25, 0.5, 0.75], "weight").alias("q"))
    m = F.col("q")[1]
    options = F.array(*[F.struct(F.abs(F.lit(o) - m).alias("d"), F.lit(o).alias("o")) for o in GAP_OPTIONS])
    return q.select(
        "gap_count", m.alias("median_gap"), F.col("q")[0].alias("q1_gap"), F.col("q")[2].alias("q3_gap"),
        F.array_min(options)["o"].alias("nearest_option"),
    )


@query(
    "margin_by_segment",
    "segment:s mean_margin:6 margin_rank:i",
    sql(
        "",
        """SELECT segment, mean_margin, ROW_NUMBER() OVER (ORDER BY mean_margin DESC, segment) AS margin_rank FROM (
             SELECT p_type AS segment, AVG((p_retailprice - (700 + p_partkey % 150)) / p_retailprice) AS mean_margin
             FROM part WHERE p_type IS NOT NULL GROUP BY p_type)""",
    ),
)
def margin_by_segment(s):
    """Mean of per-product margins; cost is 700..849 by product key."""
    cost = F.lit(700) + F.col("p_partkey") % 150
    margin = F.try_divide(F.col("p_retailprice") - cost, F.col("p_retailprice"))
    means = s.table("part").where("p_type is not null").groupBy(F.col("p_type").alias("segment")).agg(F.avg(margin).alias("mean_margin"))
    return means.withColumn("margin_rank", F.row_number().over(Window.orderBy(F.desc("mean_margin"), "segment")))


@query(
    "top_return_reason",
    "return_reason:s return_rows:i total_rows:i",
    sql(
        "",
        """SELECT return_reason, return_rows, SUM(return_rows) OVER () AS total_rows FROM (
             SELECT l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS return_reason, COUNT(*) AS return_rows
             FROM lineitem JOIN part ON l_partkey = p_partkey
             WHERE l_returnflag = 'R' AND p_brand = 'Brand#7' GROUP BY 1)
           QUALIFY ROW_NUMBER() OVER (ORDER BY return_rows DESC, return_reason) = 1""",
    ),
)
def top_return_reason(s):
    """Most frequent return reason in one category. Returns are counted per product and reason
    before the product join, so a hot product adds one row per reason."""
    reason = F.concat_ws("-", "l_linestatus", F.col("l_linenumber").cast("string"))
    counts = s.table("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey"), reason.alias("return_reason")).agg(F.count(F.lit(1)).alias("n"))
    part = s.table("part").where("p_brand = 'Brand#7'").select("p_partkey")
    by_reason = counts.join(part, "p_partkey").groupBy("return_reason").agg(F.sum("n").alias("return_rows"))
    totals = by_reason.withColumn("total_rows", F.sum("return_rows").over(Window.partitionBy(F.lit(0))))
    return totals.orderBy(F.desc("return_rows"), "return_reason").limit(1)


@query(
    "bounce_rate_by_source",
    "traffic_source:s mean_bounce_rate:6 bounce_rank:i",
    sql(
        "traffic",
        """SELECT traffic_source, mean_bounce_rate, ROW_NUMBER() OVER (ORDER BY mean_bounce_rate, traffic_source) AS bounce_rank
           FROM (SELECT traffic_source, ROUND(AVG(bounce_rate), 9) AS mean_bounce_rate FROM traffic
                 WHERE traffic_source IS NOT NULL GROUP BY 1)""",
    ),
)
def bounce_rate_by_source(s):
    means = s.traffic().where("traffic_source is not null").groupBy("traffic_source").agg(F.round(F.avg("bounce_rate"), 9).alias("mean_bounce_rate"))
    return means.withColumn("bounce_rank", F.row_number().over(Window.orderBy("mean_bounce_rate", "traffic_source")))


@query(
    "promo_line_share",
    "line_rows:i promo_rows:i promo_share_pct:4",
    sql("", """SELECT COUNT(*) AS line_rows, SUM(CAST(l_discount > 0 AS INT)) AS promo_rows,
                 AVG(CASE WHEN l_discount > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS promo_share_pct FROM lineitem"""),
)
def promo_line_share(s):
    used = (F.coalesce(F.col("l_discount"), F.lit(0.0)) > 0).cast("int")
    return s.table("lineitem").agg(
        F.count(F.lit(1)).alias("line_rows"), F.sum(used).alias("promo_rows"), (F.avg(used) * 100).alias("promo_share_pct")
    )


@query(
    "orders_per_customer_by_group",
    "age_group:s total_orders:i customers:i avg_orders_per_customer:6",
    sql(
        "",
        """SELECT c_mktsegment AS age_group, COUNT(*) AS total_orders, COUNT(DISTINCT c_custkey) AS customers,
             CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT c_custkey) AS avg_orders_per_customer
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1""",
    ),
)
def orders_per_customer_by_group(s):
    """Orders are counted per customer first; one row per customer then meets the dimension,
    and the number of customers with an order is a plain count."""
    per = s.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = s.table("customer").where("c_mktsegment is not null").select("c_custkey", "c_mktsegment")
    return per.join(c, "c_custkey").groupBy(F.col("c_mktsegment").alias("age_group")).agg(
        F.sum("n").alias("total_orders"), F.count(F.lit(1)).alias("customers"),
        (F.sum("n") / F.count(F.lit(1))).alias("avg_orders_per_customer"),
    )


@query(
    "revenue_by_region",
    "region:s line_revenue:2",
    sql(
        "",
        """SELECT r_name AS region, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS line_revenue
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    ),
)
def revenue_by_region(s):
    """Gross line value by region. Lines fold to orders and orders to customers before each
    join, so a hot order or customer is one row when it meets the next table."""
    per_order = s.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents("l_extendedprice")).alias("v"))
    per_customer = per_order.join(s.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("v").alias("v"))
    per_nation = per_customer.join(s.table("customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("v").alias("v"))
    nation = s.table("nation").select("n_nationkey", "n_regionkey")
    region = s.table("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return per_nation.join(nation, "n_nationkey").join(region, "n_regionkey").groupBy("region").agg((F.sum("v") / 100).alias("line_revenue"))


@query(
    "top_payment_for_cancelled",
    "payment_method:s order_rows:i",
    sql("ords", """SELECT payment_method, COUNT(*) AS order_rows FROM ords WHERE order_status = 'P' AND payment_method IS NOT NULL
                   GROUP BY 1 ORDER BY order_rows DESC, payment_method LIMIT 1"""),
)
def top_payment_for_cancelled(s):
    counts = value_counts(s.orders().where("order_status = 'P'"), "payment_method").withColumnRenamed("n", "order_rows")
    return counts.orderBy(F.desc("order_rows"), "payment_method").limit(1)


@query(
    "return_rate_by_size",
    "size:s order_item_rows:i return_rows:i return_rate:6",
    sql(
        "",
        f"""SELECT v.size, COALESCE(n, 0) AS order_item_rows, COALESCE(r, 0) AS return_rows, CAST(r AS DOUBLE) / NULLIF(n, 0) AS return_rate
           FROM (VALUES ('S'), ('M'), ('L'), ('XL')) v(size) LEFT JOIN (
             SELECT {SIZE_SQL} AS size, COUNT(*) AS n, SUM(CAST(l_returnflag = 'R' AS INT)) AS r
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) c ON c.size = v.size""",
    ),
)
def return_rate_by_size(s):
    """Fixed size list, zero-filled; lines and returns are counted per product before the join."""
    per = s.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("r")
    )
    sized = per.join(s.table("part").select("p_partkey", size_label("p_size").alias("size")), "p_partkey")
    counts = sized.groupBy("size").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    sizes = s.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in SIZES])).alias("size"))
    return sizes.join(counts, "size", "left").select(
        "size", F.coalesce("n", F.lit(0)).alias("order_item_rows"), F.coalesce("r", F.lit(0)).alias("return_rows"),
        F.try_divide(F.col("r"), F.col("n")).alias("return_rate"),
    )


@query(
    "payment_value_by_instalments",
    "installments:i mean_payment_value:4 order_count:i",
    sql("", """SELECT o_orderkey % 4 * 3 AS installments, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS mean_payment_value,
                 COUNT(*) AS order_count FROM orders GROUP BY 1"""),
)
def payment_value_by_instalments(s):
    o = s.table("orders")
    return o.groupBy((F.col("o_orderkey") % 4 * 3).alias("installments")).agg(
        (F.sum(cents("o_totalprice")) / 100 / F.count(F.lit(1))).alias("mean_payment_value"),
        F.count(F.lit(1)).alias("order_count"),
    )
