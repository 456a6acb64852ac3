import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.cleaner.periodicGC.interval", "2min").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def nothing_cached(request):
    """Frames that a test's queries share end with the test; those of wider fixtures stay."""
    yield
    from aisleflow.plans.registry import release

    release()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="session")
def as_rows():
    return rows


@pytest.fixture(scope="session")
def series(spark):
    """Dense daily series across a leap day, with a known formula."""
    from pyspark.sql import functions as F

    def make(n=800, start="2019-06-01", key="a"):
        v = (F.col("id") * 37 % 101 + F.col("id") % 7 * 10).cast("double")
        return spark.range(n).select(F.lit(key).alias("series_id"), F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"), v.alias("revenue"))

    return make
