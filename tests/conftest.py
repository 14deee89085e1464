import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="postloom-tests-")
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", folder).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def col(spark):
    """Values of one expression over one string column `t`."""

    def run(values, expression, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
        return [r[0] for r in df.orderBy("i").select(expression.alias("x")).collect()]

    return run
