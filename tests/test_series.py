import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aisleflow.operators import features as ft
from aisleflow.operators import joins as jn
from aisleflow.operators import promos as pr
from aisleflow.operators import references as ref
from aisleflow.operators import stock as st
from aisleflow.operators import windows as win
from aisleflow.functions.calendar import date_spine


def frame(df):
    return df.orderBy("series_id", "date").toPandas().reset_index(drop=True)


def close(a, b):
    np.testing.assert_allclose(np.array(a, dtype=float), np.array(b, dtype=float), rtol=1e-9, atol=1e-9)


def test_windows_equal_pandas(series):
    p = frame(ft.revenue_history(series(420)))
    r, past = p.revenue, p.revenue.shift(1)
    for k in ft.LAGS:
        close(p[f"revenue_lag_{k}"], r.shift(k))
    for w in ft.MEANS:
        close(p[f"revenue_roll_mean_{w}"], past.rolling(w, min_periods=w).mean())
    for w in ft.STDS:
        close(p[f"revenue_roll_std_{w}"], past.rolling(w, min_periods=w).std())


def test_rolling_needs_all_values(spark, series):
    p = frame(series(40).withColumn("revenue", F.when(F.dayofmonth("date") != 10, F.col("revenue"))).select("*", win.roll_mean("revenue", 7).alias("m"), win.roll_median("revenue", 5).alias("d")))
    close(p.m, p.revenue.shift(1).rolling(7, min_periods=7).mean())
    close(p.d, p.revenue.shift(1).rolling(5, min_periods=5).median())


def test_expanding_and_rank(series):
    p = frame(series(120).select("*", win.expanding_quantile("revenue", 0.9).alias("q"), win.expanding_quantiles("revenue", [0.5, 0.9]).alias("a"), win.rank_pct("revenue").alias("r")))
    close(p.q, p.revenue.shift(1).expanding(min_periods=1).quantile(0.9))
    close(p.a.map(lambda v: np.nan if v is None else v[1]), p.q)
    close(p.r, p.revenue.rank(pct=True))


def test_rank_pct_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0, 3.0, None])], "series_id string, date int, v double")
    p = frame(df.select("*", win.rank_pct("v").alias("r")))
    close(p.r, p.v.rank(pct=True))


def test_forward_fill(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "series_id string, date int, v double")
    got = [tuple(r) for r in win.forward_fill(df, ["v"]).select("series_id", "date", "v", "snapshot_observed", "snapshot_available").orderBy("series_id", "date").collect()]
    assert got == [("a", 1, 0.0, 0, 0), ("a", 2, 5.0, 1, 1), ("a", 3, 5.0, 0, 1), ("b", 1, 0.0, 0, 0)]


def test_leap_day_reference(spark, series):
    s = series(900, "2018-06-01")
    got = {str(r.date): (r.ref, r.last) for r in ref.year_references(jn.same_date_reference(s, "revenue", 1, "last"), s, "revenue", "y", backs=[1]).withColumnRenamed("y_1y", "ref").collect()}
    values = {str(r.date): r.revenue for r in s.collect()}
    assert got["2020-02-29"] == (values["2019-02-28"],) * 2
    assert got["2020-03-01"] == (values["2019-03-01"],) * 2
    assert got["2018-07-01"] == (None, None)


@pytest.mark.parametrize("offset", [0, 1])
def test_asof(spark, offset):
    left = date_spine(spark, "2020-01-01", "2020-01-10")
    right = spark.createDataFrame([("2020-01-03", 1.0), ("2020-01-07", 2.0)], "d string, v double").select(F.date_add(F.to_date("d"), offset).alias("date"), "v")
    got = jn.asof_backward(left, right, ["v"]).orderBy("date").toPandas()
    a, b = left.toPandas(), right.toPandas()
    a["date"], b["date"] = pd.to_datetime(a["date"]), pd.to_datetime(b["date"])
    close(got.v, pd.merge_asof(a, b, on="date").v)
    cut = jn.asof_backward(left, right, ["v"], cutoff=F.lit("2020-01-05").cast("date")).agg(F.max("v")).first()[0]
    assert cut == 1.0


def test_asof_keeps_null_hits_and_keys(spark):
    left = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "k string, date int")
    right = spark.createDataFrame([("a", 1, 9.0), ("a", 4, None), ("b", 6, 1.0)], "k string, date int, v double")
    got = [tuple(r) for r in jn.asof_backward(left, right, ["v"], ["k"]).orderBy("k").collect()]
    assert got == [("a", 5, 4, None), ("b", 5, None, None), ("c", 5, None, None)]


def test_same_month_and_day_means_by_brute_force(series):
    s = series(1300, "2017-01-15").withColumn("reference_end", F.least(F.date_sub("date", 1), F.lit("2019-09-10").cast("date")))
    got = frame(jn.same_day_recent_mean(jn.same_month_recent_mean(s, s, "revenue", "m"), s, "revenue", "d"))
    p = got.copy()
    p["date"], p["reference_end"] = pd.to_datetime(p.date), pd.to_datetime(p.reference_end)
    for i in range(0, len(p), 61):
        r = p.iloc[i]
        known = p[(p.date <= r.reference_end) & p.date.dt.year.isin([r.date.year - k for k in (1, 2, 3)])]
        gap = (known.date.dt.dayofyear - r.date.dayofyear).abs()
        close([r.m], [known[known.date.dt.month == r.date.month].revenue.mean()])
        close([r.d], [known[np.minimum(gap, 366 - gap) <= 3].revenue.mean()])


def test_intervals(spark):
    df = spark.createDataFrame(
        [("x", "2020-01-01", "2020-01-03"), ("one", "2020-01-05", "2020-01-05"), ("back", "2020-01-09", "2020-01-02"), ("null", None, "2020-01-02"), ("out", "2021-01-01", "2021-02-01"), ("wide", "2019-01-01", "2022-01-01")],
        "id string, a string, b string",
    ).select("id", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    lo, hi = (F.lit(d).cast("date") for d in ("2020-01-02", "2020-01-06"))
    got = {r.id: r["n"] for r in jn.expand_intervals(df, "a", "b", lo, hi).groupBy("id").agg(F.count("date").alias("n")).collect()}
    assert got == {"x": 2, "one": 1, "wide": 5}


def promos(spark):
    return spark.createDataFrame(
        [("p1", "Spring Sale 2021", "percentage", 12.0, "2021-03-18", "2021-03-20", None, "online", "1", 0.0), ("p2", "Spring Sale 2021", "percentage", 18.0, "2021-03-18", "2021-03-20", "Cat", "online", "0", 10.0),
         ("p3", "Fall Launch 2020", "fixed", 50.0, "2020-02-29", "2020-03-01", " ", "email", "yes", 0.0)],
        "promo_id string, promo_name string, promo_type string, discount_value double, start_date string, end_date string, applicable_category string, promo_channel string, stackable_flag string, min_order_value double",
    ).select(*["promo_id", "promo_name", "promo_type", "discount_value"], F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"), "applicable_category", "promo_channel", "stackable_flag", "min_order_value")


def test_promo_calendar_on_equal_intervals(spark):
    spine = date_spine(spark, "2021-03-17", "2021-03-21")
    iv = pr.promo_intervals(pr.prepare_promotions(promos(spark)))
    days = jn.expand_intervals(iv, "start_date", "end_date", F.lit("2021-03-17").cast("date"), F.lit("2021-03-21").cast("date"))
    got = pr.promo_phase(days, spine).orderBy("date").collect()
    assert [r.active_promo_count for r in got] == [0, 2, 2, 2, 0]
    assert got[1].avg_discount_value == 15.0 and got[1].has_stackable_promo == 1 and got[1].has_category_specific_promo == 1
    assert [r.avg_day_number for r in got] == [0, 1, 2, 3, 0] and got[2].short_promo_count == 2
    flags = pr.campaign_flags(days, spine).orderBy("date").collect()
    assert [r.campaign_spring_sale for r in flags] == [0, 1, 1, 1, 0] and sum(r.campaign_fall_launch for r in flags) == 0


def test_projection_moves_leap_day(spark):
    p = pr.prepare_promotions(promos(spark))
    got = pr.project_promotions(p, F.lit(2020), F.lit(2023)).first()
    assert (got.promo_id, got.promo_name, str(got.start_date), str(got.end_date), got.duration_days) == ("SYN_PROMO_2023_01", "Fall Launch 2023", "2023-02-28", "2023-03-01", 2)
    assert [r.campaign_index for r in pr.campaign_index(p).orderBy("promo_id").collect()] == [1, 2, 1]
    assert pr.pattern_year(p, F.lit(2024)).first()[0] == 2020


def test_stock_month_fallback(spark):
    snaps = spark.createDataFrame([("2020-01-31", 10.0), ("2020-02-29", 20.0), ("2021-01-31", 30.0)], "d string, v double").select(F.to_date("d").alias("date"), "v")
    spine = spark.createDataFrame([("2020-01-15",), ("2020-03-05",), ("2019-05-01",), ("2021-01-31",)], "d string").select(F.to_date("d").alias("date"))
    got = {str(r.date): r.v for r in st.asof_month_fallback(spine, snaps, ["v"], F.lit("2020-12-31").cast("date")).collect()}
    assert got == {"2020-01-15": 10.0, "2020-03-05": 20.0, "2019-05-01": 0.0, "2021-01-31": 20.0}
    live = {(r.scenario, str(r.date)): r.v for r in st.stock_context(spine, snaps, ["v"]).collect()}
    assert live[("monthavg", "2021-01-31")] == 20.0 and live[("carry", "2021-01-31")] == 30.0 and live[("hybrid", "2021-01-31")] == pytest.approx(27.0)


def test_no_leakage(spark, series):
    """Changing values from a day on leaves every feature up to that day unchanged."""
    a = series(500)
    day = F.lit("2020-08-01").cast("date")
    b = a.withColumn("revenue", F.when(F.col("date") >= day, F.col("revenue") * 3 + 1000).otherwise(F.col("revenue")))

    def build(df):
        return ft.past_quantiles(ft.revenue_history(df)).where(F.col("date") <= day).drop("revenue")

    x, y = frame(build(a)), frame(build(b))
    pd.testing.assert_frame_equal(x, y)


def test_training_and_scoring_features_agree(series):
    """Look-backs over history plus supplied values equal the look-backs of the full series."""
    full = series(450)
    day = F.lit("2020-06-01").cast("date")
    scored = ft.features_over_forecast(full.where(F.col("date") < day), full.where(F.col("date") >= day), ft.revenue_history)
    pd.testing.assert_frame_equal(frame(scored), frame(ft.revenue_history(full).where(F.col("date") >= day)), check_like=True)


def test_scenarios_do_not_mix(spark, series):
    past = series(20).withColumnRenamed("revenue", "value")
    ahead = spark.createDataFrame([("a", "s1", 1.0), ("a", "s2", 2.0)], "series_id string, scenario string, value double").withColumn("date", F.lit("2019-06-21").cast("date"))
    both = ft.continue_history(past, ahead, ["scenario"])
    got = {r.scenario: r["n"] for r in both.groupBy("scenario").agg(F.count("value").alias("n")).collect()}
    assert got == {"s1": 21, "s2": 21}
