"""Rules that show on larger tables only."""

import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from aisleflow.operators import boosting as bo
from aisleflow.plans.evaluation import sliced_error_metrics
from aisleflow.sources.star import Star

SF = "/root/testdata/sf0.001"


def by_sql(name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con.execute(entry.oracle_sql()[name]).df()


def test_uplift_without_promotion_free_days(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    for t in ("orders", "events"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    n = 15000  # six begin on every day of the calendar
    part = pd.read_parquet(f"{SF}/part.parquet").sample(n, replace=True, random_state=1)
    part.assign(p_partkey=np.arange(n), p_type="PROMO", p_size=np.full(n, 1, np.int32)).to_parquet(tmp_path / "part.parquet", index=False)
    got = entry.queries()["promo_uplift_factor"](spark, str(tmp_path)).toPandas()
    assert got.values.tolist() == by_sql("promo_uplift_factor", tmp_path)[got.columns].values.tolist()


def test_edges_beyond_six_places(spark):
    """Above 2**53 millionths an edge is the value itself, so a row that is the edge is not above it."""
    rng = np.random.default_rng(5)
    x = [float(v) for v in rng.uniform(1e10, 1e13, 801)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert bo.edges(df, ["x"])["x"] == sorted(x)[100:800:100]


def test_lines_cross_the_network_twice(spark):
    """Level days from tables too large to broadcast: lines and orders meet on the order, lines and parts on
    the product, and what is summed per level goes to its level: five exchanges, no other."""
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Star(spark, SF)._build_level_days()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 5


def test_level_days_keep_lines_without_a_part(spark, tmp_path):
    """Lines of an unknown product stay in revenue and have no cost; a discount of less than a hundredth is one of promotion all the same."""
    day = pd.Series(pd.to_datetime(["1998-03-01", "1998-03-02"])).astype("datetime64[us]")
    pd.DataFrame({"o_orderkey": [1, 2], "o_custkey": 1, "o_orderstatus": "F", "o_totalprice": 1.0, "o_orderdate": day, "o_orderpriority": "x"}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"l_orderkey": [1, 1, 2, 3], "l_partkey": [1, 9, 1, 1], "l_quantity": [2.0, 3.0, 1.0, 7.0], "l_extendedprice": [10.5, 4.0, 8.0, 1.0], "l_discount": [0.1, 0.0, 0.004, 0.0]}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"p_partkey": [1], "p_name": "n", "p_brand": "b", "p_type": "t", "p_size": 1, "p_retailprice": 2.25}).to_parquet(tmp_path / "part.parquet")
    got = {(r.date.day, r.segment): tuple(r)[3:] for r in Star(spark, str(tmp_path))._build_level_days().collect()}
    assert got == {
        (1, "t"): (1, 2.0, 105000, 10500, 94500, 1, 45000),
        (1, None): (1, 3.0, 40000, 0, 40000, 0, None),
        (2, "t"): (1, 1.0, 80000, 0, 80000, 1, 22500),
    }


def test_sliced_metrics_take_revenue_from_the_daily_fact(spark):
    """The forecasts take their revenue from the daily fact, so lines meet orders once."""
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    star = Star(spark, SF)
    sliced_error_metrics(star)
    assert "unique_customers" in star.revenue()._jdf.queryExecution().analyzed().toString()  # a column of the daily fact
    alone = Star(spark, SF)
    assert sorted(map(tuple, alone.revenue().collect())) == sorted(map(tuple, star.revenue().collect()))
    star.release(), alone.release()


def test_funnel_lines_fold_before_they_travel(spark):
    """Lines fold to their order before they meet it, and stock to its date without a row per stock unit."""
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["daily_funnel_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        level = entry.queries()["daily_order_level"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "l_suppkey" not in plan
    assert "partial_max(promo_used" in plan.split("SortMergeJoin [order_id", 1)[1] and re.search(r"Exchange hashpartitioning\(order_id[^\n]*\n[^\n]*HashAggregate", level)


def test_order_level_of_odd_orders(spark, tmp_path):
    """Lines without an order or a day, an order that the table repeats, null quantities and dates: as the SQL."""
    day = pd.Series(pd.to_datetime(["1998-03-01", "1998-03-02", "1998-03-02", "1998-03-04"])).astype("datetime64[us]")
    pd.DataFrame({"o_orderkey": [1, 2, 2, 4], "o_custkey": 1, "o_orderstatus": ["F", "P", "P", "O"], "o_totalprice": 1.0, "o_orderdate": day, "o_orderpriority": "x"}).to_parquet(tmp_path / "orders.parquet")
    ship = pd.Series(pd.to_datetime(["1998-03-01", "1998-03-02", "1998-03-03", "1998-03-31", "1998-02-03", None, "1998-02-04"])).astype("datetime64[us]")
    pd.DataFrame({
        "l_orderkey": [1, 1, 2, 3, 4, 4, 4], "l_partkey": 1, "l_suppkey": [1, 2, 2, 1, 3, 3, None], "l_linenumber": 1, "l_quantity": [2.0, 3.0, 1.0, 7.0, None, 5.0, 4.0],
        "l_extendedprice": [10.5, 4.0, 8.0, 1.0, 2.0, 3.0, 4.0], "l_discount": [0.1, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0], "l_returnflag": ["N", "R", "N", "N", "N", "N", "N"], "l_linestatus": "O", "l_shipdate": ship,
    }).to_parquet(tmp_path / "lineitem.parquet")
    got = [tuple(r) for r in entry.queries()["daily_order_level"](spark, str(tmp_path)).orderBy("date").collect()]
    assert got == [tuple(r) for r in by_sql("daily_order_level", tmp_path).sort_values("date").assign(date=lambda d: [x.date() for x in pd.to_datetime(d.date)]).itertuples(index=False)]
    star = Star(spark, str(tmp_path))
    stock = {r.date: r.inventory_stock_on_hand for r in star.stock_on_hand().collect()}
    assert stock == {r.date: r.inventory_stock_on_hand for r in star.snapshots().collect()} and len(stock) == 2
    star.release()
