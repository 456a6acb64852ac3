"""Joins of rows to one row per key when a few keys hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of the rows; there are fewer such keys than its inverse.
PART = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``rows`` left joined to ``table`` (or inner, by ``how``), which has one row for each ``key`` and in
    ``count`` the number of rows that hold it.

    The rows of hot keys stay where they are: fewer than 1,000 keys can hold more than a thousandth of
    all rows each, so their part of ``table`` is broadcast. All other rows are shuffled, and no key among
    them fills a task. ``table`` is read several times and should be written before.
    Edge cases: a null key finds nothing; an empty table gives nulls (no rows if inner).
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    limit = max(1, total // PART)
    hot = table.where(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(table, key, how)
    added = [c for c in table.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*added).alias("_hot"))), key, "left")
    held = marked.where("_hot is not null").select(*[c for c in marked.columns if c != "_hot"], "_hot.*")
    rest = marked.where("_hot is null").drop("_hot").join(table.where(F.col(count) <= limit), key, how)
    return held.unionByName(rest)
