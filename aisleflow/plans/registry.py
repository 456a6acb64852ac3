"""Registry that pairs each Spark query with the SQL that must give the same rows.

``out`` is the output contract, one ``name:kind`` per column. Kinds: ``s`` string,
``d`` date, ``i`` bigint, ``b`` boolean and a digit for a double rounded to that many
places. The same contract is applied to the DataFrame and to the SQL, so both sides
agree on names, types and rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleflow.functions.scalars import half_up, half_up_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


OPEN = 4  # queries that keep their shared frames; building one more frees those of the oldest
_OPEN: list = []  # the stars of the queries built since the last release


def release() -> None:
    """Free the frames that the queries built so far share among their parts; call it once their results
    have been written. A result built
    before stays right, it only computes its shared frames anew."""
    while _OPEN:
        _OPEN.pop().release()


def _fields(out: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in out.split()]


def _spark_column(name: str, kind: str, extra: int = 0) -> Column:
    c = F.col(f"`{name}`")
    if kind == "s":
        c = c.cast("string")
    elif kind == "d":
        c = c.cast("date")
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "b":
        c = c.cast("boolean")
    else:
        c = half_up(c, int(kind) + extra)
    return c.alias(name)


def _sql_column(name: str, kind: str, extra: int = 0) -> str:
    q = f'"{name}"'
    if kind == "s":
        return f"CAST({q} AS VARCHAR) AS {q}"
    if kind == "d":
        return f"CAST({q} AS DATE) AS {q}"
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "b":
        return f"CAST({q} AS BOOLEAN) AS {q}"
    rounded = half_up_sql(q, int(kind) + extra)
    return f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END AS {q}"


#: Doubles are rounded in steps: sums that differ in their last bits agree after the fine ones, so that
#: an exact half goes the same way in every engine.
STEPS = (5, 2, 0)


def conform(df: DataFrame, out: str) -> DataFrame:
    for extra in STEPS:
        df = df.select(*[_spark_column(n, k, extra) for n, k in _fields(out)])
    return df


def conform_sql(sql: str, out: str) -> str:
    sql = sql.strip().rstrip(";")
    for extra in STEPS:
        cols = ",\n       ".join(_sql_column(n, k, extra) for n, k in _fields(out))
        sql = f"SELECT {cols}\nFROM (\n{sql}\n) AS result{extra}"
    return sql


def kept(fn):
    """Mark a shared daily-grain helper ``fn(star)``: built and persisted once per star."""

    @wraps(fn)
    def run(star) -> DataFrame:
        return star.kept(fn.__name__, lambda: fn(star))

    return run


def query(name: str, out: str, sql: str | None = None):
    """Register ``fn(star) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from aisleflow.sources.star import Star

            while len(_OPEN) >= OPEN:
                _OPEN.pop(0).release()
            star = Star(spark, sf_dir)
            _OPEN.append(star)
            return conform(fn(star), out)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = conform_sql(sql, out)
        return fn

    return register
