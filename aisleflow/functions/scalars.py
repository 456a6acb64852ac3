"""Column functions: divide rules, NULL rules, text rules, row-wise summaries.

Missing values are NULL; NaN and infinities are turned into NULL at the edge. All
functions are ANSI-safe: bad input gives NULL, never an exception.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-9


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# -- divide rules -----------------------------------------------------------
def div_zero(n, d) -> Column:
    """0 when the denominator is zero or missing, or the numerator is missing."""
    return F.coalesce(F.try_divide(_c(n), _c(d)), F.lit(0.0))


def div_null(n, d) -> Column:
    """NULL when the denominator is tiny or missing."""
    return F.when(F.abs(_c(d)) >= TINY, _c(n) / _c(d))


def div_exact_null(n, d) -> Column:
    """NULL only when the denominator is exactly zero or missing."""
    return F.try_divide(_c(n), _c(d))


def div_eps(n, d) -> Column:
    """n / (|d| + 1e-6); NULL inputs propagate."""
    return _c(n) / (F.abs(_c(d)) + F.lit(1e-6))


def div_fill(n, d, fill: float = 0.0) -> Column:
    """``fill`` when the denominator is tiny or missing."""
    return F.when((F.abs(_c(d)) > TINY) & _c(n).isNotNull(), _c(n) / _c(d)).otherwise(F.lit(fill))


def div_one(n, d) -> Column:
    """1 when either side is missing or the denominator is tiny."""
    return div_fill(n, d, 1.0)


# -- exact money ------------------------------------------------------------
MONEY = 10_000  # line amounts are whole ten-thousandths, so sums are exact long additions


def cents(c) -> Column:
    """Amount as whole cents."""
    return F.floor(_c(c) * 100 + 0.5)


def units(c) -> Column:
    """Amount given to the cent as whole ten-thousandths."""
    return cents(c) * 100


# -- NULL rules -------------------------------------------------------------
def to_number(c) -> Column:
    """Text to double; unparsable, NaN and infinite values become NULL."""
    return finite(_c(c).try_cast("double"))


def finite(c) -> Column:
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def to_day(c) -> Column:
    """Text or timestamp to date; unparsable values become NULL."""
    return F.try_to_timestamp(_c(c).cast("string")).cast("date")


def to_day_strict(c) -> Column:
    return F.to_date(_c(c))


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    c = _c(c)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(c.isNotNull(), out)


def flag_gt(a, b) -> Column:
    """1 / 0 for a > b, NULL when either side is missing."""
    return (_c(a) > _c(b)).cast("int")


# -- text rules -------------------------------------------------------------
def norm_text(c) -> Column:
    return F.lower(F.trim(F.coalesce(_c(c), F.lit("unknown"))))


def slugify(c) -> Column:
    """Lower-case name with every run of other characters as one underscore; 'unknown' if empty."""
    s = F.regexp_replace(F.lower(F.trim(_c(c))), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(F.length(s) > 0, s).otherwise("unknown")


def campaign_base(c, lower: bool = False) -> Column:
    s = F.trim(F.regexp_replace(_c(c), r"\s+\d{4}$", ""))
    return F.lower(s) if lower else s


def truthy(c) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin("1", "true", "yes", "y"), F.lit(False)).cast("int")


def present(c) -> Column:
    """1 when there is text other than blanks."""
    return F.coalesce(F.length(F.trim(_c(c).cast("string"))) > 0, F.lit(False)).cast("int")


def not_null(c) -> Column:
    return _c(c).isNotNull().cast("int")


def any_present(cols: Sequence) -> Column:
    return reduce(lambda a, b: a | b, [_c(c).isNotNull() for c in cols]).cast("int")


def weights_json(weights: dict[str, float], digits: int = 4) -> str:
    return json.dumps({k: round(v, digits) for k, v in sorted(weights.items())})


def weights_json_column(pairs: Column, digits: int = 4) -> Column:
    """JSON object of an array of (name, weight) structs, sorted by name and rounded."""
    return F.to_json(
        F.map_from_entries(F.transform(F.array_sort(pairs), lambda p: F.struct(p["name"], F.round(p["weight"], digits))))
    )


# -- row-wise summaries ------------------------------------------------------
def _add(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def row_mean(cols: Sequence) -> Column:
    n = _add([_c(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(_add([F.coalesce(_c(c), F.lit(0.0)) for c in cols]), n)


def row_max(cols: Sequence) -> Column:
    """Largest present value; NULL only when all are missing."""
    return F.greatest(*[_c(c) for c in cols])


def row_count_positive(cols: Sequence) -> Column:
    return _add([F.coalesce(_c(c) > 0, F.lit(False)).cast("int") for c in cols])


def weighted_avg(pairs: Sequence[tuple[float, object]]) -> Column:
    """Weighted mean of the values that are present, weights renormalised."""
    top = _add([F.coalesce(F.lit(float(w)) * _c(c), F.lit(0.0)) for w, c in pairs])
    weight = _add([F.when(_c(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for w, c in pairs])
    return F.try_divide(top, weight)


# -- transforms --------------------------------------------------------------
def log_ratio(n, d, floor: float = 1e-6) -> Column:
    return F.log(clip(_c(n) / _c(d), lo=floor))


def seasonal_phase(day, period: float = 365.0) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * F.dayofyear(_c(day)) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def month_label(day) -> Column:
    return F.date_format(_c(day), "yyyy-MM")


def weekday_name(day) -> Column:
    return F.date_format(_c(day), "EEEE")


# -- frame helpers ------------------------------------------------------------
def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cast to double; also report how many non-null values were lost per column."""
    cast = df.select(*[to_number(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    lost = [F.count_if(F.col(c).isNotNull() & to_number(c).isNull()).alias(c) for c in cols]
    report = df.agg(*lost).unpivot([], list(cols), "column_name", "introduced_nulls")
    return cast, report


def fit_medians(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Exact medians of a daily frame, one row per group."""
    return df.groupBy(*by).agg(*[F.median(c).alias(f"_med_{c}") for c in cols])


def apply_medians(df: DataFrame, medians: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    joined = df.join(medians, list(by), "left")
    filled = [F.coalesce(c, f"_med_{c}", F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns]
    return joined.select(*filled)


def drop_unsafe(df: DataFrame, denylist: Sequence[str]) -> DataFrame:
    """Remove columns only known after the day they describe."""
    return df.drop(*denylist)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def slice_dates(df: DataFrame, lo: str | None = None, hi: str | None = None, col: str = "date") -> DataFrame:
    if lo is not None:
        df = df.where(F.col(col) >= F.lit(lo).cast("date"))
    if hi is not None:
        df = df.where(F.col(col) <= F.lit(hi).cast("date"))
    return df


def slice_times(df: DataFrame, lo: str, hi: str, col: str) -> DataFrame:
    """Closed date range on a timestamp column without wrapping the column, so files and row groups
    outside the range are skipped."""
    end = F.date_add(F.lit(hi).cast("date"), 1).cast(df.schema[col].dataType)
    return df.where((F.col(col) >= F.lit(lo).cast(df.schema[col].dataType)) & (F.col(col) < end))


def one_hot(df: DataFrame, col: str, categories: Sequence[str], prefix: str | None = None, other: str | None = None) -> DataFrame:
    """0/1 columns for a fixed training template; unseen and NULL values give all zeros, or 1 in the column
    ``{prefix}_{other}`` where ``other`` is named."""
    prefix = prefix or col
    flags = [F.coalesce(F.col(col) == v, F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in categories]
    if other is not None:
        flags.append((~F.coalesce(F.col(col).isin(list(categories)), F.lit(False))).cast("int").alias(f"{prefix}_{other}"))
    return df.select("*", *flags)


def fit_categories(train: DataFrame, col: str, limit: int = 1000) -> Column:
    """The ``limit`` most frequent values of the training rows in ascending order, as a scalar array for
    :func:`one_hot_codes`; ties go to the smaller value. NULL is no category; no rows give an empty array. The
    counts are aggregated first, so only ``limit`` values meet in one row."""
    counts = train.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).count()
    top = counts.orderBy(F.desc("count"), "value").limit(limit)
    return top.agg(F.sort_array(F.collect_list("value"))).scalar()


def one_hot_codes(df: DataFrame, col: str, categories: Column, prefix: str | None = None) -> DataFrame:
    """Adds ``{prefix}_code`` (place of the value in ``categories`` from 0; the number of categories for an
    unseen or NULL value) and ``{prefix}_onehot``, 0/1 per category and a last one for such other values. The width is that
    of the fit, whatever ``df`` holds."""
    prefix = prefix or col
    fitted = df.withColumn("_fit", categories)
    place = F.coalesce(F.array_position("_fit", F.col(col).cast("string")), F.lit(0))
    code = F.when(place > 0, place - 1).otherwise(F.size("_fit")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.size("_fit")), lambda i: (i == F.col(f"{prefix}_code")).cast("int"))
    return fitted.withColumn(f"{prefix}_code", code).withColumn(f"{prefix}_onehot", cells).drop("_fit")


def half_up(c: Column, digits: int) -> Column:
    """Round a double half up, from plain double arithmetic so that every engine gives the same
    value. Beyond 2**53 units of the last place there is nothing to round."""
    unit = float(10**digits)
    scaled = c.cast("double") * unit
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled + 0.5) / unit).otherwise(c.cast("double"))


def half_up_sql(expr: str, digits: int) -> str:
    """:func:`half_up` as DuckDB SQL."""
    unit = f"1e{digits}::DOUBLE"
    return f"(CASE WHEN ABS(({expr})::DOUBLE * {unit}) < 9007199254740992 THEN FLOOR(({expr})::DOUBLE * {unit} + 0.5::DOUBLE) / {unit} ELSE ({expr})::DOUBLE END)"
