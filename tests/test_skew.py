"""Keys that hold most of the rows give the same answers as plain pandas."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from aisleflow.functions import scalars as fx


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    """One customer has 70 % of the orders, one order 40 % and one product 60 % of the lines."""
    rng = np.random.default_rng(11)
    d = tmp_path_factory.mktemp("hot")
    n, m = 600, 3000
    days = pd.to_datetime("1998-01-01") + pd.to_timedelta(rng.integers(0, 200, n), unit="D")
    orders = pd.DataFrame({"o_orderkey": np.arange(n), "o_custkey": np.where(rng.uniform(size=n) < 0.7, 1, rng.integers(2, 40, n)), "o_orderstatus": "F", "o_totalprice": 10.0, "o_orderdate": days.astype("datetime64[us]"), "o_orderpriority": "5-LOW"})
    lines = pd.DataFrame({
        "l_orderkey": np.where(rng.uniform(size=m) < 0.4, 0, rng.integers(0, n, m)), "l_partkey": np.where(rng.uniform(size=m) < 0.6, 3, rng.integers(0, 30, m)), "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 2.0,
        "l_extendedprice": rng.integers(100, 99999, m) / 100, "l_discount": rng.integers(0, 11, m) / 100, "l_tax": 0.0, "l_returnflag": rng.choice(["A", "R", "N"], m), "l_linestatus": "O",
        "l_shipdate": pd.Series(pd.to_datetime("1998-03-01")).repeat(m).to_numpy().astype("datetime64[us]"),
    })
    part = pd.DataFrame({"p_partkey": np.arange(30), "p_name": "x", "p_brand": [f"b{i % 3}" for i in range(30)], "p_type": [f"t{i % 2}" for i in range(30)], "p_size": np.arange(30) % 50 + 1, "p_retailprice": 5.0})
    for name, t in (("orders", orders), ("lineitem", lines), ("part", part)):
        t.to_parquet(d / f"{name}.parquet", index=False)
    return str(d), orders, lines, part


def test_gaps_of_a_hot_customer(spark, hot):
    d, orders, _, _ = hot
    got = entry.queries()["order_gap_days"](spark, d).first()
    gaps = orders.sort_values(["o_custkey", "o_orderdate"]).groupby("o_custkey").o_orderdate.diff().dt.days.dropna()
    assert got.gap_count == len(gaps) and got.median_gap == pytest.approx(gaps.median(), abs=1e-3) and got.q3_gap == pytest.approx(gaps.quantile(0.75), abs=1e-3)


def test_daily_items_and_sizes_with_hot_keys(spark, hot):
    d, orders, lines, part = hot
    both = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    got = entry.queries()["daily_items"](spark, d).toPandas().set_index("date").sort_index()
    want = both.groupby("o_orderdate").agg(n=("l_orderkey", "size"), q=("l_quantity", "sum"))
    assert got.item_lines_count.tolist() == want.n.tolist() and got.total_quantity.tolist() == want.q.tolist()
    sizes = {r["size"]: r.order_item_rows for r in entry.queries()["return_rate_by_size"](spark, d).collect()}
    assert sum(sizes.values()) == len(lines) and set(sizes) == {"S", "M", "L", "XL"} and sizes["XL"] == 0


def test_panel_of_a_hot_product(spark, hot):
    d, orders, lines, part = hot
    both = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey").merge(part, left_on="l_partkey", right_on="p_partkey")
    both["net"] = both.l_extendedprice * (1 - both.l_discount)
    got = entry.queries()["dense_panel"](spark, d).groupBy("series_id").sum("revenue").collect()
    want = both.groupby("p_type").net.sum()
    assert {r[0]: r[1] for r in got} == pytest.approx(want.to_dict(), abs=0.05)


def test_time_slices(spark):
    df = spark.sql("select date'2020-01-01' + id as date, timestamp'2020-01-01 23:30:00' + make_interval(0, 0, 0, id) as ts from (select cast(id as int) id from range(10))")
    assert fx.slice_dates(df, "2020-01-03", "2020-01-05").count() == 3 and fx.slice_dates(df, hi="2020-01-02").count() == 2
    assert fx.slice_times(df, "2020-01-03", "2020-01-05", "ts").count() == 3
