import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from shelfmark import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield configure(session)
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one text."""

    def evaluate(text, function):
        df = spark.createDataFrame([(text,)], "s string")
        return df.select(function(df["s"]).alias("r")).collect()[0]["r"]

    return evaluate
