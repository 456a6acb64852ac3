import math

import pytest
from pyspark.sql import functions as F

from aisleflow.functions import scalars as fx
from aisleflow.functions.calendar import calendar_features, date_spine, reference_end, spine_of


def one(spark, **cols):
    return spark.range(1).select(*[(F.lit(v) if not isinstance(v, F.Column) else v).alias(k) for k, v in cols.items()])


@pytest.mark.parametrize(
    "n,d,zero,null,exact,fill,one_",
    [
        (6.0, 2.0, 3.0, 3.0, 3.0, 3.0, 3.0), (6.0, 0.0, 0.0, None, None, -1.0, 1.0), (6.0, 1e-12, 6e12, None, 6e12, -1.0, 1.0),
        (-6.0, -3.0, 2.0, 2.0, 2.0, 2.0, 2.0), (None, 2.0, 0.0, None, None, -1.0, 1.0), (6.0, None, 0.0, None, None, -1.0, 1.0),
    ],
)
def test_divide_rules(spark, n, d, zero, null, exact, fill, one_):
    df = one(spark, n=F.lit(n).cast("double"), d=F.lit(d).cast("double"))
    got = df.select(fx.div_zero("n", "d"), fx.div_null("n", "d"), fx.div_exact_null("n", "d"), fx.div_fill("n", "d", -1.0), fx.div_one("n", "d")).first()
    for g, w in zip(got, (zero, null, exact, fill, one_)):
        assert g == w if w is None else g == pytest.approx(w)


def test_eps_rule_drops_the_sign(spark):
    assert one(spark, n=4.0, d=-2.0).select(fx.div_eps("n", "d")).first()[0] == pytest.approx(2.0, rel=1e-6)


def test_dirty_text(spark):
    df = spark.createDataFrame([("12x", "2021-13-40", " Yes "), ("7.5", "2021-02-03", ""), (None, None, None), ("NaN", "2021-02-03 11:00:00", "0")], "n string, d string, f string")
    got = df.select(fx.to_number("n"), fx.to_day("d").cast("string"), fx.truthy("f"), fx.present("f")).collect()
    assert [tuple(r) for r in got] == [(None, None, 1, 1), (7.5, "2021-02-03", 0, 0), (None, None, 0, 0), (None, "2021-02-03", 0, 1)]
    report = dict(fx.coerce_numeric(df, ["n"])[1].collect())
    assert report == {"n": 2}


def test_finite_and_clip(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (5.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fx.finite("x")).collect()] == [None, None, None, 5.0, None]
    assert [r[0] for r in df.where("x = 5 or x is null").select(fx.clip("x", 6, 9)).collect()] == [6.0, None]


def test_row_helpers(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = df.select(fx.row_mean(["a", "b", "c"]), fx.row_max(["a", "b", "c"]), fx.row_count_positive(["a", "b", "c"]), fx.weighted_avg([(0.5, "a"), (0.3, "b"), (0.2, "c")])).collect()
    assert got[0][0] == 2.0 and got[0][1] == 3.0 and got[0][2] == 2 and got[0][3] == pytest.approx((0.5 + 0.6) / 0.7)
    assert tuple(got[1]) == (None, None, 0, None)


def test_names(spark):
    df = spark.createDataFrame([("  Year-End Sale 2021 ",), ("!!!",)], "s string")
    assert [tuple(r) for r in df.select(fx.slugify("s"), fx.campaign_base(F.trim("s"), True)).collect()] == [("year_end_sale_2021", "year-end sale"), ("unknown", "!!!")]
    assert fx.weights_json({"b": 0.123456, "a": 0.5}) == '{"a": 0.5, "b": 0.1235}'


def test_calendar(spark):
    d = date_spine(spark, "2020-02-27", "2020-03-02")
    got = calendar_features(d, F.lit("2020-01-01").cast("date")).orderBy("date").collect()
    assert [r.day_of_year for r in got] == [58, 59, 60, 61, 62]
    assert [r.is_month_end for r in got] == [0, 0, 1, 0, 0]
    assert [r.day_of_week for r in got] == [3, 4, 5, 6, 0]
    assert [r.is_weekend for r in got] == [0, 0, 1, 1, 0]
    q = calendar_features(date_spine(spark, "2020-03-31", "2020-04-01"), F.lit("2020-01-01").cast("date")).orderBy("date").collect()
    assert (q[0].is_quarter_end, q[0].is_quarter_start, q[1].is_quarter_start) == (1, 0, 1)


def test_empty_spine_and_reference_end(spark):
    empty = date_spine(spark, "2020-01-01", "2020-01-03").where("false")
    assert spine_of(empty).count() == 0
    d = date_spine(spark, "2020-01-05", "2020-01-05")
    assert str(d.select(reference_end("date")).first()[0]) == "2020-01-04"
    assert str(d.select(reference_end("date", F.lit("2019-12-31").cast("date"))).first()[0]) == "2019-12-31"
