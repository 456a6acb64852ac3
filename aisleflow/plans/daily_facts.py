"""Daily aggregates and the joined daily fact as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisleflow.functions.scalars import MONEY, div_zero
from aisleflow.operators import aggregates as agg
from aisleflow.operators.joins import assert_unique
from aisleflow.operators.windows import forward_fill
from aisleflow.plans.registry import kept, query
from aisleflow.plans.sqlbase import cte, sql

SOURCES = ["click", "error", "purchase", "signup", "view"]

cte(
    "returns",
    "lines",
    """SELECT order_id || '-' || product_id || '-' || line_number AS return_id, order_id, product_id, ship_date AS date,
         quantity AS return_quantity, net_value AS refund_amount FROM lines WHERE return_flag = 'R'""",
)
cte(
    "web",
    "traffic",
    """SELECT date, SUM(sessions) AS web_sessions, SUM(unique_visitors) AS web_unique_visitors, SUM(page_views) AS web_page_views,
         SUM(bounce_rate * sessions) / SUM(sessions) AS web_bounce_rate,
         SUM(avg_session_duration_sec * sessions) / SUM(sessions) AS web_avg_session_duration_sec FROM traffic GROUP BY date""",
)
cte(
    "snaps",
    "inventory",
    """SELECT snapshot_date AS date, COUNT(DISTINCT product_id) AS inventory_product_count, SUM(stock_on_hand) AS inventory_stock_on_hand,
         SUM(units_received) AS inventory_units_received, SUM(units_sold) AS inventory_units_sold, SUM(stockout_days) AS inventory_stockout_days,
         AVG(stockout_flag) AS inventory_stockout_rate, AVG(fill_rate) AS inventory_fill_rate, AVG(sell_through_rate) AS inventory_sell_through_rate,
         AVG(days_of_supply) AS inventory_days_of_supply, AVG(overstock_flag) AS inventory_overstock_rate, AVG(reorder_flag) AS inventory_reorder_rate
       FROM inventory GROUP BY snapshot_date""",
)
SNAP_OUT = (
    "inventory_product_count:i inventory_stock_on_hand:2 inventory_units_received:2 inventory_units_sold:2 inventory_stockout_days:2 "
    "inventory_stockout_rate:6 inventory_fill_rate:6 inventory_sell_through_rate:6 inventory_days_of_supply:4 inventory_overstock_rate:6 inventory_reorder_rate:6"
)
SNAP_COLS = [p.split(":")[0] for p in SNAP_OUT.split()]


def returns(s):
    rid = F.concat_ws("-", F.col("order_id").cast("string"), F.col("product_id").cast("string"), F.col("line_number").cast("string"))
    return s.items().where("return_flag = 'R'").select(
        rid.alias("return_id"), "order_id", "product_id", F.col("ship_date").alias("date"),
        F.col("quantity").alias("return_quantity"), F.col("net_value").alias("refund_amount"),
    )


@query("daily_sales", "date:d revenue:4 cogs:4", sql("sales", "SELECT * FROM sales"))
def daily_sales(s):
    return agg.daily_sales(s.sales())


@query(
    "daily_orders",
    "date:d orders_count:i unique_customers:i",
    sql("ords", "SELECT date, COUNT(DISTINCT order_id) AS orders_count, COUNT(DISTINCT customer_id) AS unique_customers FROM ords GROUP BY date"),
)
def daily_orders(s):
    return agg.daily_orders(s.orders())


@query(
    "daily_items",
    "date:d item_lines_count:i total_quantity:2 total_discount_amount:4 avg_discount_amount:4 avg_discount_rate:6 promo_usage_rate:6 discount_to_gross_rate:6",
    sql(
        "lines",
        """SELECT date, COUNT(*) AS item_lines_count, SUM(quantity) AS total_quantity, CAST(SUM(discount_amount) AS DOUBLE) AS total_discount_amount,
             CAST(SUM(discount_amount) AS DOUBLE) / COUNT(*) AS avg_discount_amount,
             AVG(CAST(discount_amount AS DOUBLE) / CAST(gross_value AS DOUBLE)) AS avg_discount_rate, AVG(promo_used) AS promo_usage_rate,
             CAST(SUM(discount_amount) AS DOUBLE) / CAST(SUM(gross_value) AS DOUBLE) AS discount_to_gross_rate FROM lines GROUP BY date""",
    ),
)
def daily_items(s):
    return agg.daily_items(s.lines(), MONEY)


@query(
    "daily_traffic",
    "date:d web_sessions:2 web_unique_visitors:2 web_page_views:2 web_bounce_rate:6 web_avg_session_duration_sec:4 web_traffic_available:i",
    sql("web", "SELECT *, 1 AS web_traffic_available FROM web"),
)
def daily_traffic(s):
    return agg.daily_traffic(s.traffic())


@query(
    "daily_traffic_wide",
    "date:d sessions_sum:2 unique_visitors_sum:2 page_views_sum:2 avg_bounce_rate:6 avg_session_duration_sec:4 source_diversity_count:i " + " ".join(f"{v}_sessions:2" for v in SOURCES),
    sql(
        "traffic",
        "SELECT date, SUM(sessions) AS sessions_sum, SUM(unique_visitors) AS unique_visitors_sum, SUM(page_views) AS page_views_sum, AVG(bounce_rate) AS avg_bounce_rate, "
        "AVG(avg_session_duration_sec) AS avg_session_duration_sec, COUNT(DISTINCT traffic_source) AS source_diversity_count, "
        + ", ".join(f"COALESCE(SUM(sessions) FILTER (traffic_source = '{v}'), 0) AS {v}_sessions" for v in SOURCES) + " FROM traffic GROUP BY date",
    ),
)
def daily_traffic_wide(s):
    return agg.daily_traffic_wide(s.traffic(), SOURCES)


@query("inventory_snapshot_totals", "date:d " + SNAP_OUT, sql("snaps", "SELECT * FROM snaps"))
def inventory_snapshot_totals(s):
    return s.snapshots()


STOCK_OUT = (
    "inv_avg_days_of_supply:4 inv_min_days_of_supply:4 inv_median_days_of_supply:4 inv_avg_sell_through_rate:6 inv_stockout_rate:6 inv_reorder_rate:6 "
    "inv_fill_rate_mean:6 inv_overstock_rate:6 stock_on_hand_sum:2 units_received_sum:2 restock_signal:6 stock_build_up:6 stock_pressure:8 stockout_pressure:6"
)
cte(
    "stock",
    "inventory",
    """SELECT *, units_received_sum / NULLIF(stock_on_hand_sum, 0) AS restock_signal,
         stock_on_hand_sum / NULLIF(AVG(stock_on_hand_sum) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS stock_build_up,
         inv_avg_sell_through_rate / NULLIF(inv_avg_days_of_supply, 0) AS stock_pressure, inv_stockout_rate * inv_avg_sell_through_rate AS stockout_pressure
       FROM (SELECT snapshot_date AS date, AVG(days_of_supply) AS inv_avg_days_of_supply, MIN(days_of_supply) AS inv_min_days_of_supply,
         MEDIAN(days_of_supply) AS inv_median_days_of_supply, AVG(sell_through_rate) AS inv_avg_sell_through_rate, AVG(stockout_flag) AS inv_stockout_rate,
         AVG(reorder_flag) AS inv_reorder_rate, AVG(fill_rate) AS inv_fill_rate_mean, AVG(overstock_flag) AS inv_overstock_rate,
         SUM(stock_on_hand) AS stock_on_hand_sum, SUM(units_received) AS units_received_sum FROM inventory GROUP BY 1)""",
)


@query("stock_snapshot_signals", "date:d " + STOCK_OUT, sql("stock", "SELECT * FROM stock"))
def stock_snapshot_signals(s):
    return s.stock_signals()


@query(
    "daily_returns",
    "date:d returns_count:i returned_orders_count:i return_quantity:2 refund_amount:4",
    sql("returns", """SELECT date, COUNT(DISTINCT return_id) AS returns_count, COUNT(DISTINCT order_id) AS returned_orders_count,
                        SUM(return_quantity) AS return_quantity, CAST(SUM(refund_amount) AS DOUBLE) AS refund_amount FROM returns GROUP BY date"""),
)
def daily_returns(s):
    return agg.daily_returns(returns(s), MONEY)


@query(
    "daily_return_rate",
    "date:d return_quantity:2 total_quantity:2 return_rate:6",
    sql("lines returns", """SELECT date, COALESCE(r, 0) AS return_quantity, q AS total_quantity, COALESCE(r / q, 0) AS return_rate
                      FROM (SELECT date, SUM(quantity) AS q FROM lines GROUP BY 1) LEFT JOIN (SELECT date, SUM(return_quantity) AS r FROM returns GROUP BY 1) USING (date)"""),
)
def daily_return_rate(s):
    sold = agg.daily_items(s.lines(), MONEY).select("date", "total_quantity")
    back = agg.daily_returns(returns(s), MONEY).select("date", "return_quantity")
    return sold.join(back, "date", "left").na.fill(0).withColumn("return_rate", div_zero("return_quantity", "total_quantity"))


@query(
    "daily_order_level",
    "date:d orders:i promo_orders:i lines_per_order:6 largest_order:4",
    sql("lines", """SELECT date, COUNT(*) AS orders, SUM(p) AS promo_orders, AVG(n) AS lines_per_order, CAST(MAX(v) AS DOUBLE) AS largest_order
                      FROM (SELECT date, order_id, MAX(promo_used) AS p, COUNT(*) AS n, SUM(net_value) AS v FROM lines GROUP BY 1, 2) GROUP BY 1"""),
)
def daily_order_level(s):
    return agg.daily_order_level(s.items(), s.orders(), MONEY)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "daily_payment_method_counts",
    "date:d " + " ".join(f"method_{i}:i" for i in range(1, 6)),
    sql("ords", "SELECT date, " + ", ".join(f"COUNT(*) FILTER (payment_method = '{v}') AS method_{i}" for i, v in enumerate(PRIORITIES, 1)) + " FROM ords GROUP BY date"),
)
def daily_payment_method_counts(s):
    return agg.pivot_counts(s.orders(), "payment_method", PRIORITIES, "method")


def facts(s, col):
    """Daily value (in money units) per member of a product level."""
    return s.level_days().groupBy("date", col).agg(F.sum("net_value").alias("net_value"))


@query(
    "daily_category_mix",
    "date:d share_1:6 share_2:6 share_3:6",
    sql(
        "facts",
        """SELECT date, COALESCE(SUM(v) FILTER (rk = 1) / SUM(v), 0) AS share_1, COALESCE(SUM(v) FILTER (rk = 2) / SUM(v), 0) AS share_2,
             COALESCE(SUM(v) FILTER (rk = 3) / SUM(v), 0) AS share_3 FROM per LEFT JOIN ranked USING (category) GROUP BY date""",
        per="SELECT date, category, CAST(SUM(net_value) AS DOUBLE) AS v FROM facts GROUP BY 1, 2",
        ranked="""SELECT category, ROW_NUMBER() OVER (ORDER BY total DESC, category) AS rk FROM (
                    SELECT category, SUM(v) AS total FROM per WHERE date <= DATE '1999-12-31' GROUP BY 1) QUALIFY rk <= 3""",
    ),
)
def daily_category_mix(s):
    return agg.mix_shares(facts(s, "category"), "category", "net_value", 3, F.lit("1999-12-31").cast("date"))


@query(
    "top_categories_by_value",
    "category:s total:2",
    sql("facts", "SELECT category, CAST(SUM(net_value) AS DOUBLE) AS total FROM facts GROUP BY 1 ORDER BY total DESC, category LIMIT 5"),
)
def top_categories_by_value(s):
    return agg.top_k_groups(facts(s, "category"), "category", F.col("net_value"), 5).withColumn("total", F.col("total") / MONEY)


@query(
    "daily_status_counts",
    "date:d cancelled_orders:i fulfilled_orders:i",
    sql("ords", """SELECT date, COUNT(*) FILTER (order_status = 'P') AS cancelled_orders, COUNT(*) FILTER (order_status IN ('F', 'O')) AS fulfilled_orders FROM ords GROUP BY date"""),
)
def daily_status_counts(s):
    return agg.status_counts(s.orders(), ["P"], ["F", "O"])


@query(
    "daily_promo_item_share",
    "date:d promo_items:i promo_item_share:6",
    sql("lines", "SELECT date, SUM(promo_used) AS promo_items, SUM(promo_used)::DOUBLE / COUNT(*) AS promo_item_share FROM lines GROUP BY date"),
)
def daily_promo_item_share(s):
    return agg.promo_item_share(s.lines())


cte(
    "funnel",
    "daily web",
    """SELECT d.*, COALESCE(web_sessions, 0) AS web_sessions, COALESCE(web_page_views, 0) AS web_page_views,
         COALESCE(revenue / NULLIF(orders_count, 0), 0) AS aov, COALESCE(orders_count / NULLIF(web_sessions, 0), 0) AS conversion_rate,
         COALESCE(revenue / NULLIF(web_sessions, 0), 0) AS revenue_per_session, COALESCE(quantity / NULLIF(orders_count, 0), 0) AS items_per_order,
         COALESCE(cogs / NULLIF(orders_count, 0), 0) AS cogs_per_order, COALESCE(revenue / NULLIF(quantity, 0), 0) AS unit_price,
         COALESCE(cogs / NULLIF(revenue, 0), 0) AS cogs_ratio, COALESCE(unique_customers::DOUBLE / NULLIF(orders_count, 0), 0) AS customers_per_order,
         COALESCE(web_page_views / NULLIF(web_sessions, 0), 0) AS pages_per_session
       FROM daily d LEFT JOIN web USING (date)""",
)
FUNNEL_OUT = (
    "aov:4 conversion_rate:6 revenue_per_session:4 items_per_order:6 cogs_per_order:4 unit_price:4 cogs_ratio:6 customers_per_order:6 pages_per_session:4"
)


@kept
def funnel(s):
    """Daily fact with traffic and funnel ratios."""
    web = agg.daily_traffic(s.traffic()).select("date", "web_sessions", "web_page_views")
    return agg.funnel_ratios(s.daily().join(web, "date", "left").na.fill(0, ["web_sessions", "web_page_views"]))


@query("funnel_ratios", "date:d orders_count:i web_sessions:2 " + FUNNEL_OUT, sql("funnel", "SELECT * FROM funnel"))
def funnel_ratios(s):
    return funnel(s)


@query(
    "inventory_on_calendar",
    "date:d snapshot_observed:i snapshot_available:i " + SNAP_OUT,
    sql(
        "spine snaps",
        "SELECT s.date, CAST(o.date IS NOT NULL AS INT) AS snapshot_observed, CAST(a.date IS NOT NULL AS INT) AS snapshot_available, "
        + ", ".join(f"COALESCE(a.{c}, 0) AS {c}" for c in SNAP_COLS)
        + " FROM spine s LEFT JOIN snaps o ON o.date = s.date ASOF LEFT JOIN snaps a ON s.date >= a.date",
    ),
)
def inventory_on_calendar(s):
    snaps = s.snapshots()
    aligned = s.spine().join(snaps, "date", "left").withColumn("series_id", F.lit("total"))
    return forward_fill(aligned, SNAP_COLS)


@query(
    "daily_funnel_table",
    "date:d revenue:4 cogs:4 orders_count:i promo_orders:i cancelled_orders:i promo_items:i share_1:6 web_sessions:2 inventory_stock_on_hand:2 return_quantity:2 aov:4 conversion_rate:6 return_rate:6",
    sql(
        "funnel lines ords facts returns snaps",
        """SELECT f.date, f.revenue, f.cogs, f.orders_count, COALESCE(promo_orders, 0) AS promo_orders, COALESCE(cancelled_orders, 0) AS cancelled_orders,
             f.promo_lines AS promo_items, COALESCE(share_1, 0) AS share_1, f.web_sessions, COALESCE(a.inventory_stock_on_hand, 0) AS inventory_stock_on_hand,
             COALESCE(return_quantity, 0) AS return_quantity, f.aov, f.conversion_rate, COALESCE(return_quantity / NULLIF(f.quantity, 0), 0) AS return_rate
           FROM funnel f
           LEFT JOIN (SELECT date, SUM(p) AS promo_orders FROM (SELECT date, order_id, MAX(promo_used) AS p FROM lines GROUP BY 1, 2) GROUP BY 1) o USING (date)
           LEFT JOIN (SELECT date, COUNT(*) FILTER (order_status = 'P') AS cancelled_orders FROM ords GROUP BY 1) c USING (date)
           LEFT JOIN (SELECT date, SUM(v) FILTER (segment = (SELECT segment FROM (SELECT segment, SUM(CAST(net_value AS DOUBLE)) AS t FROM facts GROUP BY 1) ORDER BY t DESC, segment LIMIT 1)) / SUM(v) AS share_1
                      FROM (SELECT date, segment, CAST(SUM(net_value) AS DOUBLE) AS v FROM facts GROUP BY 1, 2) GROUP BY 1) m USING (date)
           LEFT JOIN (SELECT date, SUM(return_quantity) AS return_quantity FROM returns GROUP BY 1) r USING (date)
           ASOF LEFT JOIN snaps a ON f.date >= a.date""",
    ),
)
def daily_funnel_table(s):
    """Star join on date: each input is already one row per day, so all joins share one key."""
    out = funnel(s)
    snaps = s.stock_on_hand()
    stock = forward_fill(s.spine().join(snaps, "date", "left").withColumn("series_id", F.lit("total")), ["inventory_stock_on_hand"])
    parts = [
        agg.daily_order_level(s.items(), s.orders(), MONEY).select("date", "promo_orders"),
        agg.status_counts(s.orders(), ["P"], ["F", "O"]).select("date", "cancelled_orders"),
        agg.mix_shares(facts(s, "segment"), "segment", "net_value").select("date", "share_1"),
        agg.daily_returns(returns(s), MONEY).select("date", "return_quantity"),
        stock.select("date", "inventory_stock_on_hand"),
    ]
    for p in parts:
        out = out.join(p, "date", "left")
    out = out.na.fill(0).withColumn("promo_items", F.col("promo_lines"))
    return out.withColumn("return_rate", div_zero("return_quantity", "quantity"))


@query(
    "order_key_uniqueness",
    "date:d orders:i lines:i",
    sql("lines", "SELECT date, COUNT(DISTINCT order_id) AS orders, COUNT(*) AS lines FROM lines GROUP BY date"),
)
def order_key_uniqueness(s):
    """Many-to-one join that refuses to run when the one-side key repeats."""
    orders = assert_unique(s.orders().select("order_id", "date"), ["order_id"])
    joined = s.items().select("order_id").groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).join(orders, "order_id")
    return joined.groupBy("date").agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"))
