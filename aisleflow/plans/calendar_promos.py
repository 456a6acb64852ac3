"""Calendar columns and promotion calendars as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisleflow.functions import calendar as cal
from aisleflow.functions.scalars import log_ratio, month_label, seasonal_phase, weekday_name
from aisleflow.operators import promos as pr
from aisleflow.operators.joins import expand_intervals
from aisleflow.plans.registry import kept, query
from aisleflow.plans.sqlbase import cte, sql

cte(
    "prepared",
    "promotions",
    """SELECT *, YEAR(start_date) AS source_year, TRIM(REGEXP_REPLACE(promo_name, '\\s+\\d{4}$', '')) AS promo_name_base,
         CAST(LOWER(TRIM(stackable_flag)) IN ('1','true','yes','y') AS INT) AS stackable,
         CAST(COALESCE(LENGTH(TRIM(applicable_category)) > 0, FALSE) AS INT) AS category_specific,
         CAST(promo_type = 'percentage' AS INT) AS percentage_promo, CAST(promo_type = 'fixed' AS INT) AS fixed_promo,
         ROW_NUMBER() OVER (PARTITION BY YEAR(start_date) ORDER BY start_date, end_date, promo_id) AS campaign_index
       FROM promotions""",
)
PDAYS_COLS = """DATE_DIFF('day', p.start_date, s.date) + 1 AS day_number, DATE_DIFF('day', s.date, p.end_date) AS days_remaining,
         (DATE_DIFF('day', p.start_date, s.date) + 1) / p.duration_days AS progress"""
cte("pdays", "prepared spine", f"SELECT p.*, s.date, {PDAYS_COLS} FROM prepared p JOIN spine s ON s.date BETWEEN p.start_date AND p.end_date")
CAL_AGGS = """COUNT(DISTINCT promo_id) AS active_promo_count, AVG(discount_value) AS avg_discount_value, MAX(discount_value) AS max_discount_value,
         SUM(stackable) AS stackable_promo_count, MAX(stackable) AS has_stackable_promo, MAX(category_specific) AS has_category_specific_promo,
         SUM(percentage_promo) AS percentage_promo_count, SUM(fixed_promo) AS fixed_promo_count"""
cte(
    "pcal",
    "spine pdays",
    """SELECT s.date, COALESCE(active_promo_count, 0) AS active_promo_count, COALESCE(avg_discount_value, 0) AS avg_discount_value,
         COALESCE(max_discount_value, 0) AS max_discount_value, COALESCE(stackable_promo_count, 0) AS stackable_promo_count,
         COALESCE(has_stackable_promo, 0) AS has_stackable_promo, COALESCE(has_category_specific_promo, 0) AS has_category_specific_promo,
         COALESCE(percentage_promo_count, 0) AS percentage_promo_count, COALESCE(fixed_promo_count, 0) AS fixed_promo_count,
         COALESCE(avg_min_order_value, 0) AS avg_min_order_value, CAST(active_promo_count IS NOT NULL AS INT) AS any_promo
       FROM spine s LEFT JOIN (SELECT date, """ + CAL_AGGS + """, AVG(min_order_value) AS avg_min_order_value FROM pdays GROUP BY date) d USING (date)""",
)
CAL_OUT = (
    "active_promo_count:i avg_discount_value:6 max_discount_value:2 stackable_promo_count:i has_stackable_promo:i has_category_specific_promo:i "
    "percentage_promo_count:i fixed_promo_count:i avg_min_order_value:4 any_promo:i"
)
SPREAD = [(c, a) for c in ("duration_days", "day_number", "days_remaining", "progress") for a in ("avg", "min", "max")]
FLAGS = {
    "is_first_3_days": "MAX(CAST(day_number <= 3 AS INT))", "is_last_3_days": "MAX(CAST(days_remaining <= 2 AS INT))",
    "is_first_7_days": "MAX(CAST(day_number <= 7 AS INT))", "is_last_7_days": "MAX(CAST(days_remaining <= 6 AS INT))",
    "short_promo_count": "COUNT(*) FILTER (duration_days <= 7)", "medium_promo_count": "COUNT(*) FILTER (duration_days BETWEEN 8 AND 30)",
    "long_promo_count": "COUNT(*) FILTER (duration_days > 30)",
}
cte(
    "pphase",
    "pcal pdays",
    "SELECT c.*, " + ", ".join(f"COALESCE({a}_{c}, 0) AS {a}_{c}" for c, a in SPREAD) + ", " + ", ".join(f"COALESCE({f}, 0) AS {f}" for f in FLAGS)
    + """, COALESCE(avg_discount_value * active_promo_count * avg_duration_days, 0) AS discount_duration_intensity,
         COALESCE(avg_discount_value * active_promo_count * avg_progress, 0) AS discount_progress_intensity,
         COALESCE(avg_discount_value * is_last_3_days, 0) AS end_urgency_intensity
       FROM pcal c LEFT JOIN (SELECT date, """ + ", ".join(f"{a.upper()}({c}) AS {a}_{c}" for c, a in SPREAD) + ", "
    + ", ".join(f"{e} AS {n}" for n, e in FLAGS.items()) + " FROM pdays GROUP BY date) d USING (date)",
)
CAMPAIGNS = pr.campaign_columns()
CAMPAIGN_SQL = ", ".join(f"MAX(CAST(LOWER(promo_name_base) = '{n}' AS INT)) AS {c}" for n, c in zip(pr.CAMPAIGN_NAMES, CAMPAIGNS))
cte(
    "pknown",
    "pcal pdays",
    """SELECT c.date, c.active_promo_count, c.avg_discount_value, c.max_discount_value, c.stackable_promo_count, c.any_promo,
         COALESCE(promo_duration, 0) AS promo_duration, COALESCE(promo_day_number, 0) AS promo_day_number,
         COALESCE(promo_progress_ratio, 0) AS promo_progress_ratio, COALESCE(promo_days_remaining, 0) AS promo_days_remaining,
         COALESCE(is_first_7_days, 0) AS is_first_7_days, COALESCE(is_last_7_days, 0) AS is_last_7_days, COALESCE(campaign_index, 0) AS campaign_index, """
    + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in CAMPAIGNS)
    + """, avg_discount_value * active_promo_count AS campaign_intensity, COALESCE(avg_discount_value * promo_progress_ratio, 0) AS discount_x_progress,
         COALESCE(avg_discount_value * promo_days_remaining, 0) AS discount_x_days_remaining
       FROM pcal c LEFT JOIN (SELECT date, AVG(duration_days) AS promo_duration, AVG(day_number) AS promo_day_number, AVG(progress) AS promo_progress_ratio,
         AVG(days_remaining) AS promo_days_remaining, MAX(CAST(day_number <= 7 AS INT)) AS is_first_7_days, MAX(CAST(days_remaining <= 6 AS INT)) AS is_last_7_days,
         MAX(campaign_index) AS campaign_index, """ + CAMPAIGN_SQL + " FROM pdays GROUP BY date) d USING (date)",
)


def promo_table(s):
    return pr.campaign_index(pr.prepare_promotions(s.promotions()))


def days_of(s, promos, lo=None, hi=None):
    return expand_intervals(promos, "start_date", "end_date", lo if lo is not None else s.first_date(), hi if hi is not None else s.last_date())


def active_days(s):
    return days_of(s, pr.promo_intervals(pr.prepare_promotions(s.promotions())))


@kept
def known_calendar(s):
    return pr.promo_known(days_of(s, pr.promo_intervals(promo_table(s))), s.spine())


@kept
def phase_calendar(s):
    return pr.promo_phase(active_days(s), s.spine())


@query("calendar_spine", "date:d", sql("spine", "SELECT date FROM spine"))
def calendar_spine(s):
    return cal.spine_of(s.orders())


CALF_OUT = " ".join(f"{c}:i" for c in cal.CALENDAR_COLUMNS)
cte(
    "calendar",
    "spine",
    """SELECT *, time_index * regime_flag AS regime_time_index FROM (SELECT date, ISODOW(date) - 1 AS day_of_week, DAYOFYEAR(date) AS day_of_year,
         WEEK(date) AS week_of_year, MONTH(date) AS month, QUARTER(date) AS quarter, YEAR(date) AS year, CAST(ISODOW(date) >= 6 AS INT) AS is_weekend,
         CAST(DAY(date) = 1 AS INT) AS is_month_start, CAST(date = LAST_DAY(date) AS INT) AS is_month_end,
         CAST(date = DATE_TRUNC('quarter', date) AS INT) AS is_quarter_start,
         CAST(date = CAST(DATE_TRUNC('quarter', date) + INTERVAL 3 MONTH AS DATE) - 1 AS INT) AS is_quarter_end,
         DATE_DIFF('day', MIN(date) OVER (), date) AS time_index, CAST(date >= DATE '1999-01-01' AS INT) AS regime_flag,
         YEAR(date) - YEAR(MIN(date) OVER ()) AS years_since_start, GREATEST(0, YEAR(date) - 1999) AS years_since_regime FROM spine)""",
)


def calendar(s):
    return cal.calendar_features(s.spine(), s.first_date(), regime_start="1999-01-01")


@query("calendar_columns", "date:d " + CALF_OUT, sql("calendar", "SELECT * FROM calendar"))
def calendar_columns(s):
    return calendar(s)


@query(
    "calendar_labels",
    "date:d month_label:s weekday:s odd_year:i high_risk:i phase_sin:6 phase_cos:6 log_revenue:6 log_to_mean:6",
    sql(
        "revenue",
        """SELECT date, STRFTIME(date, '%Y-%m') AS month_label, DAYNAME(date) AS weekday, YEAR(date) % 2 AS odd_year,
             CAST(MONTH(date) IN (2, 3, 5, 8) AS INT) AS high_risk, SIN(2 * PI() * DAYOFYEAR(date) / 365) AS phase_sin,
             COS(2 * PI() * DAYOFYEAR(date) / 365) AS phase_cos, LN(1 + revenue) AS log_revenue, LN(GREATEST(revenue / 500000, 1e-6)) AS log_to_mean FROM revenue""",
    ),
)
def calendar_labels(s):
    sin, cos = seasonal_phase("date")
    return s.revenue().select(
        "date", month_label("date").alias("month_label"), weekday_name("date").alias("weekday"), cal.is_odd_year("date").alias("odd_year"),
        cal.is_high_risk("date").alias("high_risk"), sin.alias("phase_sin"), cos.alias("phase_cos"), F.log1p("revenue").alias("log_revenue"),
        log_ratio("revenue", F.lit(500000.0)).alias("log_to_mean"),
    )


@query(
    "promotion_days",
    "promo_id:s date:d day_number:i days_remaining:i progress:6",
    sql("pdays", "SELECT * FROM pdays"),
)
def promotion_days(s):
    return pr.promo_day_columns(days_of(s, pr.prepare_promotions(s.promotions())))


@query("promo_calendar", "date:d " + CAL_OUT, sql("pcal", "SELECT * FROM pcal"))
def promo_calendar(s):
    return pr.promo_calendar(active_days(s), s.spine())


PHASE_OUT = " ".join(f"{a}_{c}:{6 if a == 'avg' or c == 'progress' else 'i'}" for c, a in SPREAD) + " " + " ".join(f"{f}:i" for f in FLAGS) + (
    " discount_duration_intensity:4 discount_progress_intensity:4 end_urgency_intensity:6"
)


@query("promo_phase_calendar", "date:d " + CAL_OUT + " " + PHASE_OUT, sql("pphase", "SELECT * FROM pphase"))
def promo_phase_calendar(s):
    return phase_calendar(s)


KNOWN_OUT = (
    "active_promo_count:i avg_discount_value:6 max_discount_value:2 stackable_promo_count:i any_promo:i promo_duration:6 promo_day_number:6 promo_progress_ratio:6 "
    "promo_days_remaining:6 is_first_7_days:i is_last_7_days:i campaign_index:i " + " ".join(f"{c}:i" for c in CAMPAIGNS) + " campaign_intensity:4 discount_x_progress:6 discount_x_days_remaining:4"
)


@query("known_promo_features", "date:d " + KNOWN_OUT, sql("pknown", "SELECT * FROM pknown"))
def known_promo_features(s):
    return known_calendar(s)


@query(
    "campaign_flags",
    "date:d " + " ".join(f"{c}:i" for c in CAMPAIGNS),
    sql("pknown", "SELECT * FROM pknown"),
)
def campaign_flags(s):
    return pr.campaign_flags(active_days(s), s.spine())


@query(
    "campaign_index_in_year",
    "promo_id:s source_year:i campaign_index:i duration_days:i",
    sql("prepared", "SELECT * FROM prepared"),
)
def campaign_index_in_year(s):
    return promo_table(s)


@query(
    "campaigns_started",
    "date:d campaigns_started:i",
    sql("spine promotions", "SELECT s.date, (SELECT COUNT(*) FROM promotions p WHERE p.start_date <= s.date) AS campaigns_started FROM spine s"),
)
def campaigns_started(s):
    return pr.campaigns_started(s.promotions(), s.spine())


# The two years after the last order day follow the newest complete year of their parity.
cte("ahead", "", "SELECT YEAR(MAX(o_orderdate)) + k AS target_year FROM orders, (VALUES (1), (2)) v(k) GROUP BY k")
cte("per_year", "prepared ahead", "SELECT target_year, source_year, COUNT(*) AS n FROM prepared JOIN ahead ON source_year < target_year AND source_year % 2 = target_year % 2 GROUP BY ALL")
cte(
    "pattern",
    "per_year",
    """SELECT target_year, COALESCE(MAX(source_year) FILTER (n >= usual), MAX(source_year)) AS source_year FROM per_year
       JOIN (SELECT target_year, n AS usual FROM (SELECT target_year, n, COUNT(*) AS c FROM per_year GROUP BY ALL) QUALIFY ROW_NUMBER() OVER (PARTITION BY target_year ORDER BY c DESC, n) = 1) USING (target_year) GROUP BY target_year""",
)
cte(
    "projected",
    "prepared pattern",
    """SELECT 'SYN_PROMO_' || target_year || '_' || CASE WHEN idx < 10 THEN '0' ELSE '' END || idx AS promo_id, promo_name_base || ' ' || target_year AS promo_name,
         CAST(start_date + TO_YEARS((target_year - source_year)::INT) AS DATE) AS start_date, CAST(end_date + TO_YEARS((target_year - source_year)::INT) AS DATE) AS end_date,
         DATE_DIFF('day', CAST(start_date + TO_YEARS((target_year - source_year)::INT) AS DATE), CAST(end_date + TO_YEARS((target_year - source_year)::INT) AS DATE)) + 1 AS duration_days,
         discount_value, stackable, category_specific, percentage_promo, fixed_promo, source_year AS source_pattern_year, target_year, idx AS campaign_index
       FROM (SELECT prepared.*, target_year, ROW_NUMBER() OVER (PARTITION BY target_year ORDER BY start_date, end_date, promo_name, promo_id) AS idx
         FROM prepared JOIN pattern USING (source_year))""",
)


def projected(s):
    p = pr.prepare_promotions(s.promotions())
    last = s.bounds().select(F.year("hi").alias("y")).scalar()
    one, two = (pr.project_promotions(p, pr.pattern_year(p, last + k).scalar(), last + k) for k in (1, 2))
    return one.unionByName(two)


@query(
    "projected_promotions",
    "promo_id:s promo_name:s start_date:d end_date:d duration_days:i discount_value:2 source_pattern_year:i target_year:i campaign_index:i",
    sql("projected", "SELECT * FROM projected"),
)
def projected_promotions(s):
    return projected(s)


@query(
    "projected_promo_summary",
    "target_year:i promo_count:i first_start:d last_end:d",
    sql("projected", "SELECT target_year, COUNT(*) AS promo_count, MIN(start_date) AS first_start, MAX(end_date) AS last_end FROM projected GROUP BY 1"),
)
def projected_promo_summary(s):
    return pr.promo_summary(projected(s))


FUTURE_MEANS = ["avg_duration_days", "avg_day_number", "avg_days_remaining", "avg_progress_ratio", "avg_discount_value"]
FUTURE_INTS = [
    "active_promo_count", "stackable_promo_count", "has_stackable_promo", "has_category_specific_promo", "percentage_promo_count", "fixed_promo_count",
    "max_duration_days", "is_first_3_days", "is_last_3_days", "is_first_7_days", "is_last_7_days", "campaign_index", "any_promo",
]
FUTURE_EXPR = CAL_AGGS + """, AVG(duration_days) AS avg_duration_days, MAX(duration_days) AS max_duration_days, AVG(day_number) AS avg_day_number,
  AVG(days_remaining) AS avg_days_remaining, AVG(progress) AS avg_progress_ratio, MAX(campaign_index) AS campaign_index, 1 AS any_promo, """ + ", ".join(
    f"{FLAGS[f]} AS {f}" for f in ("is_first_3_days", "is_last_3_days", "is_first_7_days", "is_last_7_days")
)


@query(
    "future_promo_features",
    "date:d " + " ".join(f"future_{c}:6" for c in FUTURE_MEANS) + " future_max_discount_value:2 " + " ".join(f"future_{c}:i" for c in FUTURE_INTS),
    sql(
        "projected",
        "SELECT date, " + ", ".join(f"COALESCE({c}, 0) AS future_{c}" for c in [*FUTURE_MEANS, *FUTURE_INTS, "max_discount_value"])
        + f" FROM horizon LEFT JOIN (SELECT date, {FUTURE_EXPR} FROM fdays GROUP BY date) USING (date)",
        horizon="SELECT CAST(UNNEST(generate_series(lo, lo + 547, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT MAKE_DATE(YEAR(MAX(o_orderdate)) + 1, 1, 1) AS lo FROM orders)",
        fdays=f"SELECT p.*, s.date, {PDAYS_COLS} FROM projected p JOIN horizon s ON s.date BETWEEN p.start_date AND p.end_date",
    ),
)
def future_promo_features(s):
    """548 days from the first of the year after the last order, described by the projected promotions."""
    lo = F.make_date(F.year("hi") + 1, F.lit(1), F.lit(1))
    ends = s.bounds().where("hi is not null").select(lo.alias("lo"), F.date_add(lo, 547).alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    days = days_of(s, pr.promo_intervals(projected(s)), ends.select("lo").scalar(), ends.select("hi").scalar())
    return pr.future_promo_features(days, spine)


@query(
    "promo_regime_by_day",
    "date:d promo_intensity:6 regime:s",
    sql(
        "pcal",
        """SELECT date, avg_discount_value * active_promo_count AS promo_intensity,
             CASE WHEN any_promo = 0 THEN 'none' WHEN avg_discount_value * active_promo_count >= (
               SELECT QUANTILE_CONT(avg_discount_value * active_promo_count, 0.75) FROM pcal WHERE any_promo > 0 AND date < DATE '2000-01-01') THEN 'high' ELSE 'normal' END AS regime FROM pcal""",
    ),
)
def promo_regime_by_day(s):
    c = pr.promo_calendar(active_days(s), s.spine())
    p75 = pr.intensity_threshold(c, F.lit("2000-01-01").cast("date")).scalar()
    return pr.promo_regime(c, p75)
