"""SQL building blocks (common table expressions) for the checking queries."""

from __future__ import annotations

from aisleflow.functions.scalars import half_up_sql

# name -> (names it needs, body)
CTES: dict[str, tuple[str, str]] = {
    "spine": (
        "",
        """SELECT CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
           FROM (SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders)""",
    ),
    "items": (
        "",
        """SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_number, l_quantity AS quantity,
             CAST(l_extendedprice AS DECIMAL(12,2)) AS gross_value,
             CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount_amount,
             CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS net_value,
             l_discount AS discount_rate, CAST(l_discount > 0 AS INT) AS promo_used,
             l_returnflag AS return_flag, CAST(l_shipdate AS DATE) AS ship_date
           FROM lineitem""",
    ),
    "ords": (
        "",
        """SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS date,
             o_orderstatus AS order_status, o_orderpriority AS payment_method, o_totalprice AS payment_value
           FROM orders""",
    ),
    "lines": ("items ords", "SELECT i.*, customer_id, date, order_status, payment_method FROM items i JOIN ords USING (order_id)"),
    "facts": (
        "lines",
        """SELECT l.*, p_brand AS category, p_type AS segment, p_size AS size, p_retailprice AS price,
             CAST(quantity AS DECIMAL(9,0)) * CAST(p_retailprice AS DECIMAL(9,2)) AS list_cost
           FROM lines l JOIN part ON product_id = p_partkey""",
    ),
    "sales": (
        "facts",
        """SELECT date, CAST(SUM(net_value) AS DOUBLE) AS revenue, CAST(SUM(list_cost) AS DOUBLE) * 0.89::DOUBLE AS cogs
           FROM facts GROUP BY date""",
    ),
    "revenue": (
        "spine lines",
        """SELECT 'total' AS series_id, date, COALESCE(revenue, 0::DOUBLE) AS revenue FROM spine
           LEFT JOIN (SELECT date, CAST(SUM(net_value) AS DOUBLE) AS revenue FROM lines GROUP BY date) USING (date)""",
    ),
    "daily": (
        "spine facts ords",
        """SELECT 'total' AS series_id, date, COALESCE(revenue, 0) AS revenue, COALESCE(cogs, 0) AS cogs,
             COALESCE(item_lines, 0) AS item_lines, COALESCE(quantity, 0) AS quantity,
             COALESCE(gross_value, 0) AS gross_value, COALESCE(discount_amount, 0) AS discount_amount,
             COALESCE(promo_lines, 0) AS promo_lines, COALESCE(orders_count, 0) AS orders_count,
             COALESCE(unique_customers, 0) AS unique_customers
           FROM spine
           LEFT JOIN (SELECT date, CAST(SUM(net_value) AS DOUBLE) AS revenue,
                        CAST(SUM(list_cost) AS DOUBLE) * 0.89::DOUBLE AS cogs, COUNT(*) AS item_lines,
                        SUM(quantity) AS quantity, CAST(SUM(gross_value) AS DOUBLE) AS gross_value,
                        CAST(SUM(discount_amount) AS DOUBLE) AS discount_amount,
                        CAST(SUM(promo_used) AS BIGINT) AS promo_lines
                      FROM facts GROUP BY date) USING (date)
           LEFT JOIN (SELECT date, COUNT(DISTINCT order_id) AS orders_count,
                        COUNT(DISTINCT customer_id) AS unique_customers FROM ords GROUP BY date) USING (date)""",
    ),
    "panel": (
        "spine facts",
        """SELECT series_id, date, COALESCE(revenue, 0) AS revenue, COALESCE(cogs, 0) AS cogs,
             COALESCE(quantity, 0) AS quantity, COALESCE(item_lines, 0) AS item_lines
           FROM (SELECT DISTINCT p_type AS series_id FROM part) CROSS JOIN spine
           LEFT JOIN (SELECT date, segment AS series_id, CAST(SUM(net_value) AS DOUBLE) AS revenue,
                        CAST(SUM(list_cost) AS DOUBLE) * 0.89::DOUBLE AS cogs, SUM(quantity) AS quantity,
                        COUNT(*) AS item_lines FROM facts GROUP BY 1, 2) USING (series_id, date)""",
    ),
    "cal_span": (
        "",
        "SELECT MIN(o_orderdate)::DATE AS lo, DATE_DIFF('day', MIN(o_orderdate)::DATE, MAX(o_orderdate)::DATE) + 1 AS days FROM orders",
    ),
    "promotions": (
        "cal_span",
        """SELECT *, DATE_DIFF('day', start_date, end_date) + 1 AS duration_days,
             ['Spring Sale','Mid-Year Sale','Fall Launch','Year-End Sale','Urban Blowout','Rural Special'][promo_key % 6 + 1]
               || ' ' || CAST(YEAR(start_date) AS VARCHAR) AS promo_name
           FROM (SELECT p_partkey AS promo_key, 'PROMO-' || p_partkey AS promo_id,
             CASE WHEN p_partkey % 10 = 0 THEN 'fixed' ELSE 'percentage' END AS promo_type,
             CAST(5 + p_partkey % 20 AS DOUBLE) AS discount_value,
             lo + CAST(p_partkey * 131 % days AS INT) AS start_date,
             lo + CAST(p_partkey * 131 % days AS INT) + p_size - 1 AS end_date,
             CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 7 = 0 THEN ' ' END AS applicable_category,
             ['all_channels','online','email','social_media','in_store'][p_partkey % 5 + 1] AS promo_channel,
             ['1','0',' Yes ','no'][p_partkey % 4 + 1] AS stackable_flag,
             CAST(p_partkey % 4 * 50000 AS DOUBLE) AS min_order_value
           FROM part, cal_span WHERE p_type = 'PROMO')""",
    ),
    "promo_days": (
        "promotions spine",
        """SELECT p.*, s.date FROM promotions p JOIN spine s ON s.date BETWEEN p.start_date AND p.end_date""",
    ),
    "inventory": (
        "",
        """SELECT *, CASE WHEN units_sold > 0 THEN 30 * stock_on_hand / units_sold ELSE 0 END AS days_of_supply,
             CASE WHEN units_sold + units_received > 0 THEN units_sold / (units_sold + units_received) ELSE 0 END AS fill_rate,
             CASE WHEN units_sold + stock_on_hand > 0 THEN units_sold / (units_sold + stock_on_hand) ELSE 0 END AS sell_through_rate,
             CAST(stock_on_hand = 0 AS INT) AS stockout_flag,
             CAST(CASE WHEN units_sold > 0 THEN 30 * stock_on_hand / units_sold ELSE 0 END > 45 AS INT) AS overstock_flag,
             CAST(CASE WHEN units_sold > 0 THEN 30 * stock_on_hand / units_sold ELSE 0 END < 15 AS INT) AS reorder_flag
           FROM (SELECT LAST_DAY(CAST(l_shipdate AS DATE)) AS snapshot_date, l_suppkey AS product_id,
             SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS stock_on_hand,
             SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS units_received,
             SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS units_sold,
             CAST(SUM(l_linenumber) % 8 AS DOUBLE) AS stockout_days
           FROM lineitem GROUP BY 1, 2)""",
    ),
    "traffic": (
        "cal_span",
        """SELECT lo + CAST(((event_id % 49999) * (event_id % 49999) + user_id * 131) % days AS INT) AS date, event_type AS traffic_source,
             CAST(COUNT(*) AS DOUBLE) AS sessions, CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS unique_visitors,
             CAST(SUM(CAST(json_extract_string(props, '$.k') AS INT)) AS DOUBLE) AS page_views,
             AVG(CASE WHEN value < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bounce_rate,
             CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS avg_session_duration_sec
           FROM events, cal_span GROUP BY 1, 2""",
    ),
    "components": (
        "revenue",
        "SELECT series_id, date, actual, " + ", ".join(f"{half_up_sql(half_up_sql(n, 6), 2)} AS {n}" for n in ("last_year", "recent", "weekday", "level")) + """
           FROM (SELECT series_id, date, revenue AS actual, LAG(revenue, 364) OVER w AS last_year,
             CASE WHEN COUNT(revenue) OVER w28 = 28 THEN AVG(revenue) OVER w28 END AS recent,
             (LAG(revenue, 7) OVER w + LAG(revenue, 14) OVER w + LAG(revenue, 21) OVER w + LAG(revenue, 28) OVER w
              + LAG(revenue, 35) OVER w + LAG(revenue, 42) OVER w + LAG(revenue, 49) OVER w + LAG(revenue, 56) OVER w) / 8 AS weekday,
             CASE WHEN COUNT(revenue) OVER w365 = 365 THEN AVG(revenue) OVER w365 END AS level
           FROM revenue
           WINDOW w AS (ORDER BY date), w28 AS (ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
             w365 AS (ORDER BY date ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING))
           WHERE date >= (SELECT MIN(date) + 365 FROM revenue)""",
    ),
}


def cte(name: str, needs: str, body: str) -> None:
    """Add a shared block; ``needs`` lists earlier blocks it reads."""
    CTES[name] = (needs, body)


def sql(needs: str, body: str, **extra: str) -> str:
    """WITH <needed blocks, dependencies first>, <extra blocks> body."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n not in ordered:
            for d in CTES[n][0].split():
                visit(d)
            ordered.append(n)

    for n in needs.split():
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered] + [f"{n} AS ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
