"""Readers, writers and schema checks for the retail tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleflow.functions.scalars import to_day, to_day_strict, to_number

# Column names and types of the retail star schema.
SCHEMAS: dict[str, str] = {
    "customers": "customer_id string, zip string, city string, signup_date date, gender string, age_group string, acquisition_channel string",
    "geography": "zip string, city string, region string, district string",
    "inventory": (
        "snapshot_date date, product_id string, stock_on_hand double, units_received double, units_sold double, "
        "stockout_days double, days_of_supply double, fill_rate double, sell_through_rate double, stockout_flag int, "
        "overstock_flag int, reorder_flag int"
    ),
    "order_items": "order_id string, product_id string, quantity double, unit_price double, discount_amount double, promo_id string, promo_id_2 string",
    "orders": "order_id string, customer_id string, zip string, order_date date, order_status string, payment_method string, device_type string, order_source string",
    "payments": "order_id string, payment_method string, payment_value double, installments int",
    "products": "product_id string, product_name string, category string, segment string, size string, price double, cogs double",
    "promotions": (
        "promo_id string, promo_name string, promo_type string, discount_value double, start_date date, end_date date, "
        "applicable_category string, promo_channel string, stackable_flag string, min_order_value double"
    ),
    "returns": "return_id string, order_id string, product_id string, return_date date, return_reason string, return_quantity double, refund_amount double",
    "reviews": "review_id string, order_id string, product_id string, customer_id string, review_date date, rating int",
    "sales": "Date date, Revenue double, COGS double",
    "sample_submission": "Date date, Revenue double, COGS double",
    "shipments": "order_id string, ship_date date, delivery_date date, shipping_fee double",
    "web_traffic": "date date, traffic_source string, sessions double, unique_visitors double, page_views double, bounce_rate double, avg_session_duration_sec double",
}
CRITICAL = ["sales", "orders", "order_items", "products"]


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """Typed scan of one table. CSV text is read as strings and cast with NULL on bad values,
    so a dirty cell never drops a row; columns absent from the file become typed NULLs. ``schema``
    declares the columns of a table that ``SCHEMAS`` does not have."""
    raw = _raw(spark, path)
    return raw.select(*_typed(raw, schema or SCHEMAS[name]))


def scan_report(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """(column_name, rows, missing, rejected): for each declared column the rows without a value and those
    whose value does not fit the declared type. One pass; an absent column is missing in every row."""
    raw = _raw(spark, path)
    counts = []
    for part, typed in zip((schema or SCHEMAS[name]).split(","), _typed(raw, schema or SCHEMAS[name]), strict=True):
        col = part.strip().split(" ")[0]
        given = F.col(f"`{col}`").isNotNull() if col in raw.columns else F.lit(False)
        counts.append(F.struct(F.lit(col).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count_if(~given).alias("missing"), F.count_if(given & typed.isNull()).alias("rejected")))
    return raw.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def _typed(raw: DataFrame, schema: str) -> list[Column]:
    cols = []
    for col, kind in [part.strip().split(" ") for part in schema.split(",")]:
        if col not in raw.columns:
            cols.append(F.lit(None).cast(kind).alias(col))
        elif kind == "date":
            cols.append(to_day(col).alias(col))
        elif kind in ("double", "int"):
            cols.append(to_number(col).cast(kind).alias(col))
        else:
            cols.append(F.col(col).cast("string").alias(col))
    return cols


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException:
        return False


def read_tables(
    spark: SparkSession, directory: str, names: Sequence[str], required: Sequence[str] = CRITICAL, suffix: str = ".csv",
    reader: Callable[[SparkSession, str, str], DataFrame] = read_table,
) -> dict[str, DataFrame]:
    """Named tables under a directory, each also a temp view; a missing required one raises."""
    found = {}
    for name in names:
        path = f"{directory.rstrip('/')}/{name}{suffix}"
        if path_exists(spark, path):
            found[name] = reader(spark, path, name)
            found[name].createOrReplaceTempView(name)
    missing = [n for n in required if n not in found]
    if missing:
        raise FileNotFoundError(f"required tables missing: {missing}")
    return found


def normalize_dates(df: DataFrame, cols: Sequence[str], strict: bool = False) -> DataFrame:
    rule = to_day_strict if strict else to_day
    return df.select(*[rule(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def validate_schema(df: DataFrame, required: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """Raise on missing columns; otherwise one row per date column with its range and NULLs."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    aggs = []
    for c in dates:
        day = F.col(c).cast("date")
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
                F.count_if(day.isNull()).alias("null_dates"), F.count(F.lit(1)).alias("rows"),
            )
        )
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write, and raise when the target exists."""
    w = df.write.mode("errorifexists").format(fmt)
    (w.option("header", True) if fmt == "csv" else w).save(path)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stored parquet when the path exists, otherwise build, store and read it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        write_table(build(), path)
        return spark.read.parquet(path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's checkpoint folder, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load_spine(df: DataFrame, col: str = "date") -> DataFrame:
    """Forecast dates only; values in the file are ignored."""
    return df.select(F.col(col).cast("date").alias("date")).where("date is not null").distinct()


def load_aligned(spine: DataFrame, forecast: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Forecast on the spine's dates; a date without a value fails the job when it is read."""
    joined = spine.join(forecast.select("date", *cols), "date", "left")
    checked: list[Column] = []
    for c in cols:
        fail = F.raise_error(F.concat(F.lit(f"forecast has no {c} for "), F.col("date").cast("string")))
        checked.append(F.coalesce(F.col(c), fail.cast("double")).alias(c))
    return joined.select("date", *checked)


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First of several accepted names that exists, ignoring case."""
    by_lower = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise ValueError(f"none of {list(candidates)} found")


def rename_keep(df: DataFrame, keys: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    """Keep the keys and the mapped columns under their new names; absent ones become NULL."""
    cols = [F.col(a).alias(b) if a in df.columns else F.lit(None).cast("double").alias(b) for a, b in mapping.items()]
    return df.select(*keys, *cols)


def strip_prefix(df: DataFrame, keys: Sequence[str], prefix: str = "future_") -> DataFrame:
    return rename_keep(df, keys, {c: c.removeprefix(prefix) for c in df.columns if c.startswith(prefix)})
