"""Window, sort and set operators over daily series and panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aisleflow.functions.scalars import MONEY, half_up, half_up_sql
from aisleflow.operators import quality as dq
from aisleflow.operators import sets
from aisleflow.operators import windows as win
from aisleflow.operators.aggregates import daily_traffic_wide
from aisleflow.operators.references import lead_lag_corr, traffic_features
from aisleflow.plans.daily_facts import SOURCES, facts
from aisleflow.plans.registry import kept, query
from aisleflow.plans.sqlbase import cte, sql

LAGS = [7, 14, 30, 60, 90, 180, 365]


def strict(col, width, agg="AVG", part=True):
    w = f"({'PARTITION BY series_id ' if part else ''}ORDER BY date ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN COUNT({col}) OVER {w} = {width} THEN {agg}({col}) OVER {w} END"


def lagged(col, k):
    return f"LAG({col}, {k}) OVER (PARTITION BY series_id ORDER BY date)"


cte(
    "twide",
    "spine traffic",
    "SELECT 'total' AS series_id, date, COALESCE(SUM(sessions), 0) AS sessions_sum, COALESCE(SUM(unique_visitors), 0) AS unique_visitors_sum, COALESCE(SUM(page_views), 0) AS page_views_sum, "
    "COALESCE(AVG(bounce_rate), 0) AS avg_bounce_rate, COALESCE(AVG(avg_session_duration_sec), 0) AS avg_session_duration_sec, COUNT(DISTINCT traffic_source) AS source_diversity_count, "
    + ", ".join(f"COALESCE(SUM(sessions) FILTER (traffic_source = '{v}'), 0) AS {v}_sessions" for v in SOURCES) + " FROM spine LEFT JOIN traffic USING (date) GROUP BY date",
)
_T = {f"sessions_lag_{k}": lagged("sessions_sum", k) for k in (1, 2, 3, 7, 14)}
_T |= {f"{c}_lag_{k}": lagged(f"{c}_sum", k) for c in ("unique_visitors", "page_views") for k in (1, 2, 3, 7)}
_T |= {"bounce_rate_lag_1": lagged("avg_bounce_rate", 1), "duration_lag_1": lagged("avg_session_duration_sec", 1), "source_diversity_lag_1": lagged("source_diversity_count", 1)}
_T |= {f"sessions_roll_mean_{w}": strict("sessions_sum", w) for w in (3, 7, 14, 30)}
_T |= {f"sessions_roll_std_{w}": strict("sessions_sum", w, "STDDEV_SAMP") for w in (7, 30)}
_T |= {"page_views_roll_mean_7": strict("page_views_sum", 7), "unique_visitors_roll_mean_7": strict("unique_visitors_sum", 7)}
_T |= {f"{v}_sessions_lag_{k}": lagged(f"{v}_sessions", k) for v in SOURCES for k in (1, 7)}
_T |= {f"{v}_sessions_roll_mean_7": strict(f"{v}_sessions", 7) for v in SOURCES}
cte(
    "tfeat",
    "twide",
    """SELECT *, CAST(sessions_growth_1_7 > 1.25 AS INT) AS traffic_spike_125, CAST(sessions_growth_1_7 > 1.5 AS INT) AS traffic_spike_150 FROM (
         SELECT *, sessions_lag_1 / NULLIF(sessions_roll_mean_7, 0) AS sessions_growth_1_7,
           (COALESCE(sessions_lag_1, 0) + COALESCE(sessions_lag_2, 0) + COALESCE(sessions_lag_3, 0))
             / NULLIF(CAST(sessions_lag_1 IS NOT NULL AS INT) + CAST(sessions_lag_2 IS NOT NULL AS INT) + CAST(sessions_lag_3 IS NOT NULL AS INT), 0) / NULLIF(sessions_roll_mean_14, 0) AS sessions_growth_3_14,
           sessions_lag_1 - sessions_lag_3 AS traffic_acceleration, page_views_lag_1 / NULLIF(sessions_lag_1, 0) AS pageview_per_session_lag_1,
           unique_visitors_lag_1 / NULLIF(sessions_lag_1, 0) AS visitor_to_session_lag_1, page_views_lag_1 * duration_lag_1 / NULLIF(bounce_rate_lag_1, 0) AS engagement_index
         FROM (SELECT date, """ + ", ".join(f"{e} AS {n}" for n, e in _T.items()) + " FROM twide))",
)
TRAFFIC_OUT = " ".join(f"{n}:{2 if 'std' in n else 4}" for n in _T) + (
    " sessions_growth_1_7:6 sessions_growth_3_14:6 traffic_acceleration:4 pageview_per_session_lag_1:6 visitor_to_session_lag_1:6 engagement_index:3 traffic_spike_125:i traffic_spike_150:i"
)


@kept
def dense_traffic(s):
    """Wide traffic on every calendar day, so that row lags are day lags."""
    return s.spine().join(daily_traffic_wide(s.traffic(), SOURCES), "date", "left").na.fill(0).withColumn("series_id", F.lit("total"))


@kept
def traffic_table(s):
    return traffic_features(dense_traffic(s), SOURCES)


@query("traffic_features", "date:d " + TRAFFIC_OUT, sql("tfeat", "SELECT * FROM tfeat"))
def traffic_feature_table(s):
    return traffic_table(s)


@query(
    "panel_revenue_lags",
    "series_id:s date:d " + " ".join(f"revenue_lag_{k}:4" for k in LAGS),
    sql("panel", "SELECT series_id, date, " + ", ".join(f"{lagged('revenue', k)} AS revenue_lag_{k}" for k in LAGS) + " FROM panel"),
)
def panel_revenue_lags(s):
    return s.panel().select("series_id", "date", *win.lag_columns(["revenue"], LAGS))


GRID_COLS, GRID_LAGS, GRID_WIDTHS = ["revenue", "orders_count", "quantity"], [1, 7, 30], [7, 30]


@query(
    "daily_lag_grid",
    "date:d " + " ".join(f"{c}_lag_{k}:4" for c in GRID_COLS for k in GRID_LAGS) + " " + " ".join(f"{c}_roll_mean_{w}:3" for c in GRID_COLS for w in GRID_WIDTHS),
    sql(
        "daily",
        "SELECT date, " + ", ".join(f"{lagged(c, k)} AS {c}_lag_{k}" for c in GRID_COLS for k in GRID_LAGS) + ", "
        + ", ".join(f"{strict(c, w)} AS {c}_roll_mean_{w}" for c in GRID_COLS for w in GRID_WIDTHS) + " FROM daily",
    ),
)
def daily_lag_grid(s):
    return win.add_lag_grid(s.daily(), GRID_COLS, GRID_LAGS, GRID_WIDTHS)


WIDTHS = [7, 30, 90, 365]


@query(
    "panel_rolling_moments",
    "series_id:s date:d " + " ".join(f"revenue_roll_mean_{w}:2 revenue_roll_std_{w}:1" for w in WIDTHS),
    sql(
        "panel",
        "SELECT series_id, date, " + ", ".join(f"{strict('revenue', w)} AS revenue_roll_mean_{w}, {strict('revenue', w, 'STDDEV_SAMP')} AS revenue_roll_std_{w}" for w in WIDTHS) + " FROM panel",
    ),
)
def panel_rolling_moments(s):
    return s.panel().select("series_id", "date", *win.roll_mean_columns(["revenue"], WIDTHS), *win.roll_std_columns(["revenue"], WIDTHS))


@query(
    "rolling_median_and_smoothing",
    "date:d median_30:3 smooth_7:3",
    sql("revenue", f"SELECT date, {strict('revenue', 30, 'MEDIAN')} AS median_30, AVG(revenue) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS smooth_7 FROM revenue"),
)
def rolling_median_and_smoothing(s):
    return s.revenue().select("date", win.roll_median("revenue", 30).alias("median_30"), win.smooth("revenue", 7).alias("smooth_7"))


@query(
    "expanding_quantiles",
    "date:d p80:3 p90:3 p95:3 median:3",
    sql(
        "revenue",
        "SELECT date, " + ", ".join(f"QUANTILE_CONT(revenue, {q}) OVER w AS {n}" for q, n in [(0.8, "p80"), (0.9, "p90"), (0.95, "p95"), (0.5, "median")])
        + " FROM revenue WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    ),
)
def expanding_quantiles(s):
    q = win.past_quantiles(s.revenue(), "revenue", [0.8, 0.9, 0.95, 0.5], "q")
    return q.select("date", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(["p80", "p90", "p95", "median"])])


@query(
    "customer_gap_days",
    "customer_id:i date:d gap:i",
    sql("ords", "SELECT customer_id, date, DATE_DIFF('day', LAG(date) OVER (PARTITION BY customer_id ORDER BY date), date) AS gap FROM (SELECT DISTINCT customer_id, date FROM ords)"),
)
def customer_gap_days(s):
    days = s.orders().select("customer_id", "date").distinct()
    return days.select("customer_id", "date", win.gap_days("date", "customer_id").alias("gap"))


@query(
    "percent_rank_average_ties",
    "series_id:s date:d rank_pct:8",
    sql(
        "panel",
        """SELECT series_id, date, (RANK() OVER (PARTITION BY series_id ORDER BY item_lines) + (COUNT(*) OVER (PARTITION BY series_id, item_lines) - 1) / 2.0::DOUBLE)
             / COUNT(*) OVER (PARTITION BY series_id) AS rank_pct FROM panel""",
    ),
)
def percent_rank_average_ties(s):
    return s.panel().select("series_id", "date", win.rank_pct("item_lines").alias("rank_pct"))


@query(
    "traffic_lead_lag_correlation",
    "horizon_days:i corr_growth_revenue:6 corr_spike125_spike:6 corr_spike150_spike:6",
    sql(
        "revenue tfeat",
        """SELECT h AS horizon_days, CORR(g, y) AS corr_growth_revenue, CORR(s125, ys) AS corr_spike125_spike, CORR(s150, ys) AS corr_spike150_spike
           FROM (SELECT h, g, s125, s150, LEAD(revenue, h::INT) OVER (PARTITION BY h ORDER BY date) AS y,
             LEAD(spike, h::INT) OVER (PARTITION BY h ORDER BY date) AS ys
             FROM (SELECT date, revenue, sessions_growth_1_7 AS g, traffic_spike_125::DOUBLE AS s125, traffic_spike_150::DOUBLE AS s150,
                     CASE WHEN revenue >= (SELECT QUANTILE_CONT(revenue, 0.9) FROM revenue JOIN tfeat USING (date)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS spike
                   FROM revenue JOIN tfeat USING (date)), (VALUES (1), (2), (3), (7)) v(h))
           GROUP BY h""",
    ),
)
def traffic_lead_lag_correlation(s):
    both = s.revenue().join(traffic_table(s).drop("series_id"), "date")
    return lead_lag_corr(both, [1, 2, 3, 7])


@query(
    "history_arrays",
    "date:d known:i oldest:4 newest:4 total:2",
    sql(
        "revenue",
        """SELECT date, LEN(a) AS known, a[1] AS oldest, a[-1] AS newest, LIST_SUM(a) AS total FROM (
             SELECT date, COALESCE(LIST(revenue) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), []) AS a FROM revenue)""",
    ),
)
def history_arrays(s):
    a = s.revenue().select("date", win.history_array("revenue", 30).alias("a"))
    total = F.when(F.size("a") > 0, F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x))
    return a.select("date", F.size("a").alias("known"), F.get("a", F.lit(0)).alias("oldest"), F.get("a", F.size("a") - 1).alias("newest"), total.alias("total"))


@query(
    "last_year_tail",
    "series_id:s days:i revenue:4 first_date:d",
    sql("panel", """SELECT series_id, COUNT(*) AS days, CAST(SUM(CAST(revenue AS DECIMAL(20,4))) AS DOUBLE) AS revenue, MIN(date) AS first_date FROM (
                      SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM panel) WHERE rn <= 365 GROUP BY 1"""),
)
def last_year_tail(s):
    return win.tail(s.panel(), 365).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.col("revenue").cast("decimal(20,4)")).cast("double").alias("revenue"), F.min("date").alias("first_date")
    )


@query(
    "last_order_per_customer",
    "customer_id:i order_id:i date:d payment_method:s",
    sql("ords", "SELECT customer_id, order_id, date, payment_method FROM ords QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date DESC, order_id DESC) = 1"),
)
def last_order_per_customer(s):
    o = s.orders().select("customer_id", "order_id", "date", "payment_method")
    return sets.dedup_last(o, ["customer_id"], [F.col("date"), F.col("order_id")])


@query(
    "ranked_order_days",
    "position:i date:d orders_count:i",
    sql("ords", """SELECT ROW_NUMBER() OVER (ORDER BY n DESC, date) AS position, date, n AS orders_count FROM (SELECT date, COUNT(*) AS n FROM ords GROUP BY 1)"""),
)
def ranked_order_days(s):
    n = s.orders().groupBy("date").agg(F.count(F.lit(1)).alias("orders_count"))
    return n.withColumn("position", F.row_number().over(Window.orderBy(F.desc("orders_count"), "date")))


@query(
    "worst_forecast_days",
    "date:d error:2",
    sql("components", "SELECT date, actual - recent AS error FROM components ORDER BY ABS(actual - recent) DESC, date LIMIT 30"),
)
def worst_forecast_days(s):
    e = s.components().select("date", (F.col("actual") - F.col("recent")).alias("error"))
    return sets.worst_n(e, "error", 30, ["date"])


FEATURES = ["revenue_lag_7", "revenue_lag_14", "revenue_lag_30", "revenue_roll_mean_7", "revenue_roll_mean_30", "orders_count_lag_7", "orders_count_roll_mean_7"]
cte(
    "g",
    "daily",
    "SELECT date, revenue, " + ", ".join(f"{lagged('revenue', k)} AS revenue_lag_{k}" for k in (7, 14, 30)) + ", "
    + ", ".join(f"{strict('revenue', w)} AS revenue_roll_mean_{w}" for w in (7, 30)) + f", {lagged('orders_count', 7)} AS orders_count_lag_7, {strict('orders_count', 7)} AS orders_count_roll_mean_7 FROM daily",
)
cte("importance", "g", f"SELECT feature, {half_up_sql('ABS(c)', 8)} AS importance FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CORR({f}, revenue) AS c FROM g" for f in FEATURES) + ")")


def importance(s):
    g = win.add_lag_grid(s.daily(), ["revenue", "orders_count"], [7, 14, 30], [7, 30])
    return dq.corr_with(g, "revenue", FEATURES).select("feature", half_up(F.abs("corr"), 8).alias("importance"))


@query(
    "top_features",
    "feature:s importance:6",
    sql("importance", "SELECT feature, importance FROM importance ORDER BY CASE WHEN importance <= 0 THEN 1 ELSE 0 END, importance DESC, feature LIMIT 4"),
)
def top_features(s):
    return sets.rank_features(importance(s), 4)


@query(
    "nested_feature_sets",
    "set_size:i position:i feature:s importance:6",
    sql("importance", """SELECT k AS set_size, position, feature, importance FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS position FROM importance)
                           JOIN (VALUES (2), (4), (6)) v(k) ON position <= k"""),
)
def nested_feature_sets(s):
    return sets.feature_sets(importance(s), [2, 4, 6])


@query(
    "feature_group_presence",
    "feature_group:s members:i present:b",
    sql(
        "importance",
        """SELECT g AS feature_group, COUNT(feature) AS members, COUNT(feature) > 0 AS present FROM (VALUES ('orders', 'orders_'), ('revenue', 'revenue_'), ('promo', 'promo_')) v(g, p)
           LEFT JOIN (SELECT feature FROM importance ORDER BY CASE WHEN importance <= 0 THEN 1 ELSE 0 END, importance DESC, feature LIMIT 4) t ON STARTS_WITH(feature, p) GROUP BY g""",
    ),
)
def feature_group_presence(s):
    return sets.group_presence(importance(s), {"orders": "orders_", "revenue": "revenue_", "promo": "promo_"}, 4)


@query(
    "stacked_levels",
    "level:s date:d category:s segment:s revenue:4",
    sql(
        "facts",
        """SELECT 'CATEGORY' AS level, date, category, NULL AS segment, CAST(SUM(net_value) AS DOUBLE) AS revenue FROM facts GROUP BY date, category
           UNION ALL SELECT 'SEGMENT', date, NULL, segment, CAST(SUM(net_value) AS DOUBLE) FROM facts GROUP BY date, segment""",
    ),
)
def stacked_levels(s):
    a = facts(s, "category").groupBy("date", "category").agg((F.sum("net_value") / MONEY).alias("revenue")).withColumn("level", F.lit("CATEGORY"))
    b = facts(s, "segment").groupBy("date", "segment").agg((F.sum("net_value") / MONEY).alias("revenue")).withColumn("level", F.lit("SEGMENT"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "distinct_series_keys",
    "category:s segment:s",
    sql("", "SELECT DISTINCT p_brand AS category, p_type AS segment FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL"),
)
def distinct_series_keys(s):
    return s.products().select("category", "segment").where("category is not null and segment is not null").dropDuplicates()


@query(
    "sales_on_promo_dates",
    "date:d revenue:4",
    sql("revenue promotions", "SELECT date, revenue FROM revenue WHERE date IN (SELECT start_date FROM promotions)"),
)
def sales_on_promo_dates(s):
    return sets.in_dates(s.revenue(), s.promotions().select(F.col("start_date").alias("date")))
