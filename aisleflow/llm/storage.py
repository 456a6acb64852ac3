"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []

# The white space that separates words, and its complement.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; the warehouse, also shared, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that is never to broadcast it. Spark sizes a written table by its compressed file and an
    exploded one by the rows before, so it would send tables that grow with the corpus through the driver."""
    return df.hint("merge")


def drop(df: DataFrame | None) -> None:
    """Delete the folder of a materialized frame that nothing reads any more."""
    if path := getattr(df, "_folder", None):
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every folder this process wrote; call it when the results have been written."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, unless the session says where it is."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, split at runs of ASCII white space; a null text has none."""
    trimmed = F.regexp_replace(text, f"^{SPACES}", "")
    return F.coalesce(F.size(F.regexp_extract_all(trimmed, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names clash with those an operator adds (names ignore case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
