"""Folded plans give the same rows as the plain ones they replace."""

import random

from pyspark.sql import functions as F

from aisleflow.functions.scalars import half_up, units
from aisleflow.operators import hierarchy as hier
from aisleflow.operators import stock as st
from aisleflow.operators import windows as win


def test_past_quantiles_equal_the_window(spark, series, as_rows):
    df = series(150).unionByName(series(90, key="b")).withColumn("revenue", F.when(F.dayofmonth("date") == 3, None).otherwise(F.col("revenue")))
    probs = [0.0, 0.3, 0.5, 0.9, 1.0]
    got = win.past_quantiles(df, "revenue", probs, "q").select("series_id", "date", "q")
    want = df.select("series_id", "date", win.expanding_quantiles("revenue", probs).alias("q"))
    flat = lambda d: [(k, t, None if not q else [round(x, 9) for x in q]) for k, t, q in as_rows(d, "series_id", "date")]
    assert flat(got) == flat(want)
    assert win.past_quantiles(df.limit(0), "revenue", probs, "q").count() == 0


def test_compact_lines_with_mostly_missing_promotions(spark, as_rows):
    rng = random.Random(8)
    promo = lambda: f"P{rng.randint(0, 6)}" if rng.random() < 0.1 else None
    items = spark.createDataFrame(
        [(rng.randint(0, 60), rng.choice([1, 1, 1, rng.randint(2, 9), None]), float(rng.randint(1, 5)), rng.randint(-500, 90000), promo(), promo()) for _ in range(3000)],
        "order_id long, product_id long, quantity double, net_value long, promo_id string, promo_id_2 string",
    )
    orders = spark.createDataFrame([(i, i % 7, f"2020-01-{i % 5 + 1:02d}" if i % 11 else None) for i in range(55)], "order_id long, customer_id long, date string").withColumn("date", F.col("date").cast("date"))
    products = spark.createDataFrame([(i, f"c{i % 3}", f"s{i % 2}", i * 0.25) for i in range(1, 8)], "product_id long, category string, segment string, unit_cost double")
    geography = spark.createDataFrame([(i, f"r{i % 2}") for i in range(5)], "customer_id long, region string")
    promos = spark.createDataFrame([(f"P{i}", f"campaign {i % 2}") for i in range(5)], "promo_id string, promo_name_base string")
    fact = hier.build_fact(items, orders, products, geography, promos)
    want = fact.groupBy("date", "category", "segment", "region", "campaign_base").agg(F.sum("raw_revenue").alias("raw_revenue"), F.sum(units("raw_cogs")).alias("raw_cogs"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("item_lines"))
    got = hier.compact_lines(items, orders, products, geography, promos)
    keys = ["date", "category", "segment", "region", "campaign_base"]
    assert as_rows(got.select(*want.columns), *keys) == as_rows(want, *keys)


def test_lines_fold_before_the_last_join(spark):
    """The folded frame is bounded by days and levels, however many lines there are."""
    lines = spark.range(60_000).select(
        (F.col("id") / 4).cast("long").alias("order_id"), (F.col("id") * 7919 % 500).alias("product_id"), F.lit(1.0).alias("quantity"), (F.col("id") % 900).alias("net_value"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("P"), F.col("id") % 4)).alias("promo_id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("P"), F.col("id") % 4)).alias("promo_id_2"),
    )
    orders = spark.range(15_000).select(F.col("id").alias("order_id"), (F.col("id") % 40).alias("customer_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("date"))
    products = spark.range(500).select(F.col("id").alias("product_id"), (F.col("id") % 5).cast("string").alias("category"), (F.col("id") % 2).cast("string").alias("segment"), F.lit(0.5).alias("unit_cost"))
    geography = spark.range(40).select(F.col("id").alias("customer_id"), (F.col("id") % 3).cast("string").alias("region"))
    promos = spark.range(4).select(F.concat(F.lit("P"), "id").alias("promo_id"), F.concat(F.lit("c"), "id").alias("promo_name_base"))
    folded = hier.folded_lines(lines, orders, products, geography, promos)
    assert folded.count() * 20 < 60_000
    assert folded.agg(F.sum("item_lines")).first()[0] == 60_000


def test_days_before_the_first_snapshot_fall_back_to_the_month(spark):
    spine = spark.sql("select explode(sequence(date'2020-01-30', date'2021-02-02', interval 1 day)) as date")
    snaps = spark.createDataFrame([("2020-02-29", 4.0), ("2021-01-31", 8.0), ("2021-02-01", 99.0)], "date string, v double").withColumn("date", F.col("date").cast("date"))
    got = {str(r.date): r.v for r in st.asof_month_fallback(spine, snaps, ["v"], F.lit("2021-01-31").cast("date")).collect()}
    assert got["2020-01-30"] == 8.0 and got["2020-02-01"] == 4.0 and got["2020-03-01"] == 4.0 and got["2021-02-02"] == 8.0


def test_half_up(spark):
    rows = [(0.125, 0.13), (-0.125, -0.12), (2.5e15, 2.5e15), (1e300, 1e300), (1.004, 1.0), (None, None)]
    d = spark.createDataFrame([(a,) for a, _ in rows], "x double")
    assert [r[0] for r in d.select(half_up(F.col("x"), 2)).collect()] == [b for _, b in rows]
