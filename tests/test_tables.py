from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aisleflow.functions.calendar import date_spine
from aisleflow.operators import aggregates as agg
from aisleflow.operators import hierarchy as hier
from aisleflow.operators import joins as jn
from aisleflow.operators import metrics as mt
from aisleflow.operators import quality as dq
from aisleflow.operators import sets
from aisleflow.sources import tables as io


@pytest.fixture()
def csv_dir(tmp_path):
    (tmp_path / "sales.csv").write_text("Date,Revenue,COGS\n2020-01-01,10,8\n2020-01-02,bad,7\n2020-13-02,5,4\n")
    (tmp_path / "orders.csv").write_text("order_id,order_date\n007,2020-01-01\n")
    (tmp_path / "order_items.csv").write_text("order_id,product_id,quantity\n007,1,2\n")
    (tmp_path / "products.csv").write_text("product_id,price\n1,9.5\n")
    return str(tmp_path)


def test_typed_csv_scan(spark, csv_dir):
    got = [tuple(r) for r in io.read_table(spark, f"{csv_dir}/sales.csv", "sales").selectExpr("cast(Date as string)", "Revenue", "COGS").collect()]
    assert got == [("2020-01-01", 10.0, 8.0), ("2020-01-02", None, 7.0), (None, 5.0, 4.0)]
    o = io.read_table(spark, f"{csv_dir}/orders.csv", "orders").first()
    assert o.order_id == "007" and o.zip is None


def test_directory_scan(spark, csv_dir):
    found = io.read_tables(spark, csv_dir, list(io.SCHEMAS))
    assert set(found) == {"sales", "orders", "order_items", "products"}
    assert spark.sql("select count(*) from products").first()[0] == 1
    with pytest.raises(FileNotFoundError):
        io.read_tables(spark, csv_dir, ["sales", "returns"], required=["returns"])


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "t")
    io.write_new(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_new(df, path)
    io.write_table(df.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    built = []
    for _ in range(2):
        out = io.read_or_build(spark, str(tmp_path / "d"), lambda: built.append(1) or spark.range(5))
    assert out.count() == 5 and built == [1]


def test_columns_and_alignment(spark):
    df = spark.createDataFrame([("2020-01-01", 5.0)], "d string, Revenue double").select(F.to_date("d").alias("date"), "Revenue")
    assert io.resolve_column(df, ["sales", "REVENUE"]) == "Revenue"
    with pytest.raises(ValueError):
        io.resolve_column(df, ["x"])
    spine = date_spine(spark, "2020-01-01", "2020-01-02")
    fc = df.withColumnRenamed("Revenue", "revenue")
    assert io.load_aligned(spine.where("date = date'2020-01-01'"), fc, ["revenue"]).first().revenue == 5.0
    with pytest.raises(Exception, match="no revenue"):
        io.load_aligned(spine, fc, ["revenue"]).collect()
    kept = io.strip_prefix(spark.createDataFrame([(1, 2.0, 3.0)], "date int, future_a double, b double"), ["date"])
    assert kept.columns == ["date", "a"]
    with pytest.raises(ValueError):
        io.validate_schema(df, ["nope"], ["date"])


def forecast(spark, rows):
    return spark.createDataFrame(rows, "d string, revenue double, cogs double").select(F.to_date("d").alias("date"), "revenue", "cogs")


@pytest.mark.parametrize(
    "rows,field",
    [
        ([("2020-01-01", 1.0, 1.0)], "missing_dates"), ([("2020-01-01", 1.0, 1.0), ("2020-01-02", 1.0, 1.0), ("2020-01-03", 1.0, 1.0)], "extra_dates"),
        ([("2020-01-01", 1.0, 1.0), ("2020-01-02", 1.0, 1.0), ("2020-01-02", 1.0, 1.0)], "duplicate_dates"), ([("2020-01-01", 1.0, 1.0), ("2020-01-02", None, 1.0)], "null_rows"),
        ([("2020-01-01", 1.0, 1.0), ("2020-01-02", 1.0, -1.0)], "negative_rows"), ([("2020-01-01", 1.0, 1.0), ("2020-01-02", 0.0, 0.0)], None),
    ],
)
def test_forecast_contract(spark, rows, field):
    got = dq.check_forecast(forecast(spark, rows), date_spine(spark, "2020-01-01", "2020-01-02")).first()
    assert got.passed == (field is None)
    for f in ("missing_dates", "extra_dates", "duplicate_dates", "null_rows", "negative_rows"):
        assert got[f] == (1 if f == field else 0)


def test_contract_wants_exact_columns(spark):
    df = forecast(spark, [("2020-01-01", 1.0, 1.0)]).select("date", "cogs", "revenue")
    assert not dq.check_forecast(df, date_spine(spark, "2020-01-01", "2020-01-01")).first().columns_ok


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError):
        jn.assert_unique(df, ["k"])
    assert jn.assert_unique(df, ["k", "v"]) is df
    assert dq.duplicate_row_count(df.unionByName(df)).first().duplicate_rows == 3


def test_daily_items_null_rules(spark):
    df = spark.createDataFrame([("2020-01-01", 1, 2.0, 0.0, 0.0, 0), ("2020-01-01", 1, None, 10.0, 1.0, 1), (None, 2, 5.0, 1.0, 1.0, 1)], "d string, order_id int, quantity double, gross_value double, discount_amount double, promo_used int").withColumn("date", F.to_date("d"))
    got = agg.daily_items(df).collect()
    assert len(got) == 1 and got[0].item_lines_count == 2 and got[0].total_quantity == 2.0 and got[0].avg_discount_rate == pytest.approx(0.05) and got[0].discount_to_gross_rate == pytest.approx(0.1)


def test_mix_shares_rank_on_history_only(spark):
    df = spark.createDataFrame([("2020-01-01", "a", 10.0), ("2020-01-01", "b", 5.0), ("2020-01-02", "b", 100.0), ("2020-01-02", None, 7.0)], "d string, cat string, v double").withColumn("date", F.to_date("d"))
    got = {str(r.date): (r.share_1, r.share_2) for r in agg.mix_shares(df, "cat", "v", 2, F.lit("2020-01-01").cast("date")).collect()}
    assert got["2020-01-01"] == (pytest.approx(2 / 3), pytest.approx(1 / 3)) and got["2020-01-02"] == (0.0, 1.0)


def test_hierarchy_levels_add_up(spark):
    fact = spark.createDataFrame([(1, "c1", "s1", "r1", "NO_PROMO", 10.0, 1.0, 1.0, 1), (1, "c1", "s2", "r1", "sale", 5.0, 1.0, 1.0, 1), (1, "c2", "s1", "r2", "sale", 1.0, 1.0, 1.0, 1)], "date int, category string, segment string, region string, campaign_base string, revenue double, cogs double, quantity double, item_lines int")
    got = hier.hierarchy(fact).groupBy("level").agg(F.sum("target_revenue").alias("r")).collect()
    assert {r.level: r.r for r in got} == {"TOTAL": 16.0, "CATEGORY": 16.0, "SEGMENT": 16.0, "REGION": 16.0, "CATEGORY_PROMO": 6.0}


def test_reconcile(spark):
    fact = spark.createDataFrame([(1, 30.0, 3.0), (1, 10.0, 1.0), (2, 0.0, 0.0), (3, 4.0, 4.0)], "date int, raw_revenue double, raw_cogs double")
    totals = spark.createDataFrame([(1, 80.0, 2.0), (2, 9.0, 9.0)], "date int, revenue double, cogs double")
    got = hier.reconcile_to_total(fact, totals).groupBy("date").agg(F.sum("revenue").alias("r"), F.sum("cogs").alias("c")).collect()
    assert {r.date: (r.r, r.c) for r in got} == {1: (80.0, 2.0), 2: (0.0, 0.0), 3: (4.0, 4.0)}


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "date date, order_id int, customer_id int, order_status string, sessions double, unique_visitors double, page_views double, bounce_rate double, avg_session_duration_sec double, traffic_source string")
    assert agg.daily_orders(e).count() == 0 and agg.daily_traffic(e).count() == 0 and agg.status_counts(e, ["a"], ["b"]).count() == 0
    assert dq.missing_report(e.select("date")).count() == 0


def test_dedup_and_overlay(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 1, None)], "k int, t int, v string")
    assert sorted(tuple(r) for r in sets.dedup_last(df, ["k"], [F.col("t")]).collect()) == [(1, 9, "y"), (2, 1, None)]
    base, patch = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double"), spark.createDataFrame([(1, None, 7.0), (2, 5.0, 8.0)], "k int, a double, b double")
    assert sorted(tuple(r) for r in jn.overlay(base, patch, ["k"]).collect()) == [(1, 1.0, 7.0), (2, 5.0, 8.0)]
    assert jn.add_missing_columns(base, patch, ["k"]).columns == ["k", "a", "b"]


def test_numeric_features_refuse_text(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, s string, b double")
    assert mt.numeric_features(df, ["s"]) == ["a", "b"]
    with pytest.raises(ValueError):
        mt.numeric_features(df, [])


def test_entry_without_the_training_data_part():
    """A library that only that part needs may be missing; the other queries stay."""
    import subprocess
    import sys

    import __spark_entry__ as entry
    from aisleflow.plans.registry import QUERIES

    assert entry.queries()
    hide = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", hide], cwd=str(Path(__file__).resolve().parent.parent), capture_output=True, text=True, check=True).stdout.split()
    assert out[-2:] == [str(len(QUERIES)), "False"]


def test_shared_frames_are_released(spark):
    from aisleflow.plans import registry

    path = "/root/testdata/sf0.001"
    registry.QUERIES["daily_sales"](spark, path).where("true").count()
    kept = [df for star in registry._OPEN for df in star._kept.values()]
    assert kept and all(df.storageLevel.useMemory for df in kept)
    registry.release()
    assert not any(df.storageLevel.useMemory for df in kept) and not registry._OPEN
