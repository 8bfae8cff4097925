import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.stop()
        session = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def column(spark):
    """One text column of literal values, in order of ``i``."""

    def make(values, dtype="string"):
        rows = list(enumerate(values))
        return spark.createDataFrame(rows, f"i int, v {dtype}")

    return make


@pytest.fixture
def apply(column):
    """Values of an expression over literal values."""
    from pyspark.sql import functions as F

    def run(function, values, dtype="string"):
        df = column(values, dtype)
        return [r[0] for r in df.orderBy("i").select(function(F.col("v")).alias("r")).collect()]

    return run
