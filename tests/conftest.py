import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

WORK = tempfile.mkdtemp(prefix="kindred-tests-")

# Started here, since test modules name columns when they are imported.
SESSION = (
    SparkSession.builder.master("local[4]")
    .appName("kindred-tests")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "4g")
    .config("spark.sql.warehouse.dir", f"{WORK}/warehouse")
    .config("spark.checkpoint.dir", f"{WORK}/shared")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one row of literals."""

    def value(expression, schema, *values):
        return spark.createDataFrame([values], schema).select(expression.alias("x")).first()["x"]

    return value


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()
