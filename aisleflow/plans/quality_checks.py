"""Source handling, column rules and data-quality reports as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisleflow.functions import scalars as fx
from aisleflow.functions.calendar import spine_of
from aisleflow.operators import quality as dq
from aisleflow.operators.windows import add_lag_grid
from aisleflow.plans.registry import query
from aisleflow.plans.sqlbase import cte, sql
from aisleflow.sources import tables as io
from aisleflow.sources.star import LONGEST_LOOK_BACK

# Typed rows with zero, tiny, negative and missing denominators, from the part table.
cte(
    "ratios",
    "",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice - 950 END AS n,
         CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 1e-10 ELSE CAST(p_size - 25 AS DOUBLE) END AS d,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS a,
         CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey % 90 - 20 AS DOUBLE) END AS b,
         p_name, p_brand, p_type FROM part""",
)


def ratios(s):
    k = F.col("p_partkey")
    return s.table("part").select(
        k.alias("id"),
        F.when(k % 17 != 0, F.col("p_retailprice") - 950).alias("n"),
        F.when(k % 11 == 0, None).when(k % 13 == 0, 1e-10).otherwise((F.col("p_size") - 25).cast("double")).alias("d"),
        F.when(k % 3 != 0, F.col("p_size").cast("double")).alias("a"),
        F.when(k % 4 != 0, (k % 90 - 20).cast("double")).alias("b"),
        "p_name", "p_brand", "p_type",
    )


@query(
    "divide_rules",
    "id:i zero_rule:1 null_rule:6 exact_rule:1 eps_rule:6 fill_rule:6 one_rule:6",
    sql(
        "ratios",
        """SELECT id, CASE WHEN d = 0 OR n IS NULL OR d IS NULL THEN 0 ELSE n / d END AS zero_rule,
             CASE WHEN ABS(d) >= 1e-9 THEN n / d END AS null_rule, n / NULLIF(d, 0) AS exact_rule,
             n / (ABS(d) + 1e-6::DOUBLE) AS eps_rule, CASE WHEN ABS(d) > 1e-9 AND n IS NOT NULL THEN n / d ELSE -1 END AS fill_rule,
             CASE WHEN ABS(d) > 1e-9 AND n IS NOT NULL THEN n / d ELSE 1 END AS one_rule FROM ratios""",
    ),
)
def divide_rules(s):
    return ratios(s).select(
        "id", fx.div_zero("n", "d").alias("zero_rule"), fx.div_null("n", "d").alias("null_rule"),
        fx.div_exact_null("n", "d").alias("exact_rule"), fx.div_eps("n", "d").alias("eps_rule"),
        fx.div_fill("n", "d", -1.0).alias("fill_rule"), fx.div_one("n", "d").alias("one_rule"),
    )


@query(
    "clip_and_flags",
    "id:i clipped:4 low_only:4 flag:i inf_null:6 filled:4 combined:s",
    sql(
        "ratios",
        """SELECT id, CASE WHEN a IS NULL THEN NULL ELSE GREATEST(5.0, LEAST(40.0, a)) END AS clipped,
             CASE WHEN b IS NULL THEN NULL ELSE GREATEST(0.0, b) END AS low_only,
             CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE CAST(a > b AS INT) END AS flag,
             CASE WHEN d = 0 THEN NULL ELSE n / d END AS inf_null,
             COALESCE(a, 0) AS filled, COALESCE(CASE WHEN id % 2 = 0 THEN p_brand END, CASE WHEN id % 3 = 0 THEN p_type END, 'NO_PROMO') AS combined
           FROM (SELECT * REPLACE (CASE WHEN d = 1e-10 THEN NULL ELSE d END AS d) FROM ratios)""",
    ),
)
def clip_and_flags(s):
    r = ratios(s).withColumn("d", F.when(F.col("d") != 1e-10, F.col("d")))
    quotient = F.when(F.col("d") == 0, F.lit(float("inf"))).otherwise(F.try_divide("n", "d"))
    return r.na.fill(0, []).select(
        "id", fx.clip("a", 5, 40).alias("clipped"), fx.clip("b", lo=0).alias("low_only"), fx.flag_gt("a", "b").alias("flag"),
        fx.finite(quotient).alias("inf_null"), F.coalesce("a", F.lit(0.0)).alias("filled"),
        F.coalesce(F.when(F.col("id") % 2 == 0, F.col("p_brand")), F.when(F.col("id") % 3 == 0, F.col("p_type")), F.lit("NO_PROMO")).alias("combined"),
    )


@query(
    "row_summaries",
    "id:i mean_value:6 max_value:4 positive_count:i weighted_value:6",
    sql(
        "ratios",
        """SELECT id, (COALESCE(a,0)+COALESCE(b,0)+COALESCE(n,0)) / NULLIF(CAST(a IS NOT NULL AS INT)+CAST(b IS NOT NULL AS INT)+CAST(n IS NOT NULL AS INT), 0) AS mean_value,
             GREATEST(a, b, n) AS max_value,
             CAST(COALESCE(a > 0, FALSE) AS INT)+CAST(COALESCE(b > 0, FALSE) AS INT)+CAST(COALESCE(n > 0, FALSE) AS INT) AS positive_count,
             (COALESCE(0.5*a,0)+COALESCE(0.3*b,0)+COALESCE(0.2*n,0)) / NULLIF(CASE WHEN a IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END
               + CASE WHEN b IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN n IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END, 0) AS weighted_value
           FROM ratios""",
    ),
)
def row_summaries(s):
    return ratios(s).select(
        "id", fx.row_mean(["a", "b", "n"]).alias("mean_value"), fx.row_max(["a", "b", "n"]).alias("max_value"),
        fx.row_count_positive(["a", "b", "n"]).alias("positive_count"),
        fx.weighted_avg([(0.5, "a"), (0.3, "b"), (0.2, "n")]).alias("weighted_value"),
    )


@query(
    "text_rules",
    "promo_id:s base_name:s base_lower:s slug:s stackable:i category_present:i category_not_null:i any_flag:i type_text:s",
    sql(
        "promotions",
        """SELECT promo_id, TRIM(REGEXP_REPLACE(promo_name, '\\s+\\d{4}$', '')) AS base_name,
             LOWER(TRIM(REGEXP_REPLACE(promo_name, '\\s+\\d{4}$', ''))) AS base_lower,
             REGEXP_REPLACE(REGEXP_REPLACE(LOWER(TRIM(promo_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
             CAST(LOWER(TRIM(stackable_flag)) IN ('1','true','yes','y') AS INT) AS stackable,
             CAST(COALESCE(LENGTH(TRIM(applicable_category)) > 0, FALSE) AS INT) AS category_present,
             CAST(applicable_category IS NOT NULL AS INT) AS category_not_null,
             CAST(applicable_category IS NOT NULL OR promo_type = 'fixed' AS INT) AS any_flag,
             LOWER(TRIM(COALESCE(CASE WHEN promo_key % 9 > 0 THEN ' ' || UPPER(promo_type) || ' ' END, 'unknown'))) AS type_text FROM promotions""",
    ),
)
def text_rules(s):
    p = s.promotions()
    fixed = F.when(F.col("promo_type") == "fixed", F.lit(1))
    shouted = F.when(F.col("promo_key") % 9 > 0, F.concat(F.lit(" "), F.upper("promo_type"), F.lit(" ")))
    return p.select(
        "promo_id", fx.campaign_base("promo_name").alias("base_name"), fx.campaign_base("promo_name", True).alias("base_lower"),
        fx.slugify("promo_name").alias("slug"), fx.truthy("stackable_flag").alias("stackable"),
        fx.present("applicable_category").alias("category_present"), fx.not_null("applicable_category").alias("category_not_null"),
        fx.any_present(["applicable_category", fixed]).alias("any_flag"), fx.norm_text(shouted).alias("type_text"),
    )


@query(
    "numeric_coercion_report",
    "column_name:s introduced_nulls:i",
    sql("", """SELECT 'brand_number' AS column_name, SUM(CAST(p_brand IS NOT NULL AND TRY_CAST(REPLACE(p_brand, 'Brand#1', '1') AS DOUBLE) IS NULL AS INT)) AS introduced_nulls FROM part
               UNION ALL SELECT 'size_text', SUM(CAST(TRY_CAST(CASE WHEN p_size > 45 THEN p_size || 'x' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) IS NULL AS INT)) FROM part"""),
)
def numeric_coercion_report(s):
    size = F.when(F.col("p_size") > 45, F.concat(F.col("p_size").cast("string"), F.lit("x"))).otherwise(F.col("p_size").cast("string"))
    raw = s.table("part").select(F.replace("p_brand", F.lit("Brand#1"), F.lit("1")).alias("brand_number"), size.alias("size_text"))
    return fx.coerce_numeric(raw, ["brand_number", "size_text"])[1]


@query(
    "date_normalisation",
    "parsed_date:d orders:i bad_rows:i",
    sql("", """SELECT d AS parsed_date, COUNT(*) AS orders, SUM(CAST(d IS NULL AS INT)) AS bad_rows FROM (
                 SELECT TRY_CAST(CASE WHEN o_orderkey % 100 = 0 THEN '2021-13-40' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS d FROM orders) GROUP BY d"""),
)
def date_normalisation(s):
    text = F.when(F.col("o_orderkey") % 100 == 0, "2021-13-40").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    days = io.normalize_dates(s.table("orders").select(text.alias("parsed_date")), ["parsed_date"])
    return days.groupBy("parsed_date").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("parsed_date").isNull()).alias("bad_rows"))


@query(
    "schema_date_ranges",
    "column_name:s first_date:d last_date:d null_dates:i rows:i",
    sql("", """SELECT 'l_shipdate' AS column_name, MIN(l_shipdate) AS first_date, MAX(l_shipdate) AS last_date, COUNT(*) - COUNT(l_shipdate) AS null_dates, COUNT(*) AS rows FROM lineitem
               UNION ALL SELECT 'o_orderdate', MIN(o_orderdate), MAX(o_orderdate), COUNT(*) - COUNT(o_orderdate), COUNT(*) FROM orders"""),
)
def schema_date_ranges(s):
    a = io.validate_schema(s.table("lineitem"), ["l_orderkey", "l_partkey", "l_shipdate"], ["l_shipdate"])
    return a.unionByName(io.validate_schema(s.table("orders"), ["o_orderkey", "o_orderdate"], ["o_orderdate"]))


@query(
    "named_table_scan",
    "table_name:s rows:i",
    sql("", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS rows FROM {t}" for t in ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"])),
)
def named_table_scan(s):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    found = io.read_tables(s.spark, s.sf_dir, names, ["orders", "lineitem"], ".parquet", lambda spark, path, name: spark.read.parquet(path))
    counts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows")) for n, df in found.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


TYPED = {"o_orderkey": "int", "o_orderstatus": "double", "o_totalprice": "double", "o_orderdate": "date", "o_orderpriority": "int", "o_clerk_name": "string"}


def _typed_sql(col, kind):
    fits = {"date": f"TRY_CAST({col} AS DATE)", "string": col}.get(kind, f"TRY_CAST({col} AS DOUBLE)")
    given = "NULL::VARCHAR" if col == "o_clerk_name" else col
    return f"SELECT '{col}' AS column_name, COUNT(*) AS rows, COUNT(*) FILTER ({given} IS NULL) AS missing, COUNT(*) FILTER ({given} IS NOT NULL AND {fits.replace(col, given)} IS NULL) AS rejected FROM orders"


@query("typed_scan_report", "column_name:s rows:i missing:i rejected:i", sql("", " UNION ALL ".join(_typed_sql(c, k) for c, k in TYPED.items())))
def typed_scan_report(s):
    """What a declared schema rejects: letters in numbers, a column the file does not have."""
    return io.scan_report(s.spark, f"{s.sf_dir}/orders.parquet", "orders", ", ".join(f"{c} {k}" for c, k in TYPED.items()))


@query(
    "typed_table_scan",
    "year:i orders:i without_status:i value:0",
    sql("", "SELECT YEAR(o_orderdate) AS year, COUNT(*) AS orders, COUNT(*) FILTER (TRY_CAST(o_orderstatus AS DOUBLE) IS NULL) AS without_status, SUM(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS value FROM orders GROUP BY 1"),
)
def typed_table_scan(s):
    t = io.read_table(s.spark, f"{s.sf_dir}/orders.parquet", "orders", ", ".join(f"{c} {k}" for c, k in TYPED.items()))
    return t.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus").isNull()).alias("without_status"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"),
    )


@query(
    "written_table_round_trip",
    "year:i days:i revenue:2",
    sql("revenue", "SELECT YEAR(date) AS year, COUNT(*) AS days, CAST(SUM(CAST(revenue AS DECIMAL(20,4))) AS DOUBLE) AS revenue FROM revenue GROUP BY 1"),
)
def written_table_round_trip(s):
    """Build once, store by year in the shared folder, read back."""
    path = io.shared_dir(s.spark, "daily-revenue")
    stored = io.read_or_build(s.spark, path, lambda: s.revenue().withColumn("year", F.year("date")))
    return stored.groupBy("year").agg(F.count(F.lit(1)).alias("days"), F.sum(F.col("revenue").cast("decimal(20,4)")).cast("double").alias("revenue"))


@query(
    "write_once_table",
    "brand:s parts:i",
    sql("", "SELECT p_brand AS brand, COUNT(*) AS parts FROM part GROUP BY 1"),
)
def write_once_table(s):
    """A result stored as CSV under a name that must not exist yet, then read back."""
    path = io.shared_dir(s.spark, "parts-per-brand")
    io.write_new(s.table("part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("parts")), path, "csv")
    return s.spark.read.schema("brand string, parts bigint").option("header", True).csv(path)


@query(
    "orders_in_time_slice",
    "date:d orders:i",
    sql("ords", "SELECT date, COUNT(*) AS orders FROM ords WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1"),
)
def orders_in_time_slice(s):
    """The slice is applied to the stored timestamp, so it reaches the parquet scan."""
    o = fx.slice_times(s.table("orders"), "1998-01-01", "1998-12-31", "o_orderdate")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "aligned_forecast",
    "date:d revenue:2",
    sql("components", "SELECT date, recent AS revenue FROM components"),
)
def aligned_forecast(s):
    fc = s.components().select("date", F.col("recent").alias("Recent_Revenue"))
    name = io.resolve_column(fc, ["revenue", "recent_revenue", "prediction"])
    spine = io.load_spine(s.spine().where(F.col("date") >= F.date_add(s.first_date(), LONGEST_LOOK_BACK)))
    return io.load_aligned(spine, fc.withColumnRenamed(name, "revenue"), ["revenue"])


@query(
    "renamed_future_features",
    "date:d active_promos:i max_discount:2 stock:2",
    sql("spine promo_days", """SELECT s.date, COUNT(promo_id) AS active_promos, MAX(discount_value) AS max_discount, CAST(NULL AS DOUBLE) AS stock
                               FROM spine s LEFT JOIN promo_days p USING (date) GROUP BY s.date"""),
)
def renamed_future_features(s):
    daily = s.promo_days().groupBy("date").agg(F.count("promo_id").alias("future_active_promos"), F.max("discount_value").alias("future_max_discount"))
    kept = io.rename_keep(s.spine().join(daily, "date", "left"), ["date"], {"future_active_promos": "active_promos", "future_max_discount": "max_discount", "future_stock": "stock"})
    return kept.na.fill(0, ["active_promos"])


@query(
    "missing_value_report",
    "column_name:s missing_count:i missing_pct:2",
    sql(
        "revenue promotions",
        """SELECT column_name, missing_count, ROUND(missing_count * 100.0::DOUBLE / n, 2) AS missing_pct FROM (
             SELECT 'applicable_category' AS column_name, COUNT(*) - COUNT(applicable_category) AS missing_count, COUNT(*) AS n FROM promotions
             UNION ALL SELECT 'revenue_lag_' || k, COUNT(*) - COUNT(v), COUNT(*) FROM (
               SELECT k, LAG(revenue, k::INT) OVER (PARTITION BY k ORDER BY date) AS v FROM revenue, (VALUES (7), (30)) t(k)) GROUP BY k
             UNION ALL SELECT 'revenue_roll_mean_7', 7, COUNT(*) FROM revenue)
           WHERE missing_count > 0""",
    ),
)
def missing_value_report(s):
    lagged = add_lag_grid(s.revenue(), ["revenue"], [7, 30], [7])
    return dq.missing_report(s.promotions()).unionByName(dq.missing_report(lagged))


@query(
    "structure_audit",
    "rows:i first_date:d last_date:d duplicate_dates:i missing_dates:i numeric_columns:i other_columns:i",
    sql("ords", """SELECT COUNT(*) AS rows, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) - COUNT(DISTINCT date) AS duplicate_dates,
                     DATE_DIFF('day', MIN(date), MAX(date)) + 1 - COUNT(DISTINCT date) AS missing_dates, 3 AS numeric_columns, 3 AS other_columns FROM ords"""),
)
def structure_audit(s):
    return dq.audit_structure(s.orders())


@query(
    "duplicate_rows",
    "rows:i duplicate_rows:i",
    sql("", """SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT COUNT(*) AS n FROM lineitem
                 GROUP BY l_orderkey, l_linenumber, l_returnflag)"""),
)
def duplicate_rows(s):
    return dq.duplicate_row_count(s.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "missing_order_dates",
    "date:d",
    sql("spine ords", "SELECT date FROM spine EXCEPT SELECT date FROM ords"),
)
def missing_order_dates(s):
    return dq.missing_dates(s.orders(), spine_of(s.orders()))


@query(
    "iqr_outlier_report",
    "lower_bound:4 upper_bound:4 outliers:i negatives:i zeros:i",
    sql(
        "",
        """SELECT MAX(lo) AS lower_bound, MAX(hi) AS upper_bound, SUM(CAST(v < lo OR v > hi AS INT)) AS outliers,
             SUM(CAST(v < 0 AS INT)) AS negatives, SUM(CAST(v = 0 AS INT)) AS zeros
           FROM (SELECT l_extendedprice AS v, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM lineitem,
             (SELECT QUANTILE_CONT(l_extendedprice, 0.25) AS q1, QUANTILE_CONT(l_extendedprice, 0.75) AS q3 FROM lineitem))""",
    ),
)
def iqr_outlier_report(s):
    """Quartiles of every line price, exact without sorting all lines in one task."""
    return dq.iqr_outliers(s.table("lineitem"), "l_extendedprice")


@query(
    "describe_line_price",
    "rows:i mean:2 std:1 min:2 max:2 p1:4 p5:4 p25:4 p50:4 p75:4 p95:4 p99:4",
    sql("", "SELECT COUNT(*) AS rows, AVG(l_extendedprice) AS mean, STDDEV_SAMP(l_extendedprice) AS std, MIN(l_extendedprice) AS min, MAX(l_extendedprice) AS max, "
        + ", ".join(f"QUANTILE_CONT(l_extendedprice, {p}) AS {n}" for n, p in dq.DESCRIBE.items()) + " FROM lineitem"),
)
def describe_line_price(s):
    return dq.describe(s.table("lineitem"), "l_extendedprice")


FACT_COLS = ["cogs", "item_lines", "quantity", "gross_value", "discount_amount", "orders_count", "unique_customers"]


@query(
    "leakage_audit",
    "feature:s corr:6 suspect:i",
    sql("daily", "SELECT feature, corr, CAST(ABS(corr) >= 0.95 AS INT) AS suspect FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CORR({c}, revenue) AS corr FROM daily" for c in FACT_COLS) + ")"),
)
def leakage_audit(s):
    return dq.leakage_candidates(s.daily(), "revenue", FACT_COLS)


MATRIX_COLS = ["revenue", "quantity", "orders_count", "discount_amount"]


@query(
    "correlation_matrix",
    "left:s right:s corr:6",
    sql("daily", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", CORR({a}, {b}) AS corr FROM daily" for i, a in enumerate(MATRIX_COLS) for b in MATRIX_COLS[i:])),
)
def correlation_matrix(s):
    return dq.corr_matrix(s.daily(), MATRIX_COLS)


@query(
    "yearly_revenue_summary",
    "year:i rows:i mean:2 median:2 std:1 total:2",
    sql("revenue", """SELECT YEAR(date) AS year, COUNT(revenue) AS rows, AVG(revenue) AS mean, MEDIAN(revenue) AS median,
                        STDDEV_SAMP(revenue) AS std, SUM(revenue) AS total FROM revenue GROUP BY 1"""),
)
def yearly_revenue_summary(s):
    return dq.yearly_summary(s.revenue(), "revenue")


@query(
    "regime_shift_audit",
    "mean_before:2 mean_after:2 median_before:2 median_after:2 total_before:2 total_after:2 mean_ratio:6 median_ratio:6 total_ratio:6 regime_shift:b",
    sql(
        "revenue",
        """SELECT *, mean_after / mean_before AS mean_ratio, median_after / median_before AS median_ratio, total_after / total_before AS total_ratio,
             ABS(mean_after / mean_before - 1) >= 0.15 OR ABS(median_after / median_before - 1) >= 0.15 AS regime_shift
           FROM (SELECT AVG(revenue) FILTER (YEAR(date) < 1999) AS mean_before, AVG(revenue) FILTER (YEAR(date) >= 1999) AS mean_after,
             MEDIAN(revenue) FILTER (YEAR(date) < 1999) AS median_before, MEDIAN(revenue) FILTER (YEAR(date) >= 1999) AS median_after,
             SUM(revenue) FILTER (YEAR(date) < 1999) AS total_before, SUM(revenue) FILTER (YEAR(date) >= 1999) AS total_after FROM revenue)""",
    ),
)
def regime_shift_audit(s):
    return dq.regime_shift(s.revenue(), "revenue", 1999)


@query(
    "time_split_audit",
    "part:s rows:i first_date:d last_date:d mean:2 median:2",
    sql("revenue", """SELECT CASE WHEN date < DATE '2000-01-01' THEN 'train' ELSE 'validation' END AS part, COUNT(*) AS rows, MIN(date) AS first_date,
                        MAX(date) AS last_date, AVG(revenue) AS mean, MEDIAN(revenue) AS median FROM revenue WHERE date <= DATE '2000-12-31' GROUP BY 1"""),
)
def time_split_audit(s):
    return dq.audit_split(s.revenue(), "revenue", "2000-01-01", "2000-12-31")


@query(
    "forecast_contract",
    "columns_ok:b forecast_rows:i spine_rows:i missing_dates:i extra_dates:i duplicate_dates:i null_rows:i negative_rows:i passed:b",
    sql(
        "spine components",
        """SELECT TRUE AS columns_ok, f.n AS forecast_rows, s.n AS spine_rows, s.n - f.n AS missing_dates, 0 AS extra_dates,
             0 AS duplicate_dates, 0 AS null_rows, 0 AS negative_rows, s.n = f.n AS passed
           FROM (SELECT COUNT(*) AS n FROM components) f, (SELECT COUNT(*) AS n FROM spine) s""",
    ),
)
def forecast_contract(s):
    fc = s.components().select("date", F.col("recent").alias("revenue"), (F.col("recent") * 0.89).alias("cogs"))
    return dq.check_forecast(fc, s.spine())
