import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    yield s


@pytest.fixture
def frame(spark):
    """frame("a int, b string", rows) -> DataFrame"""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def tables(spark):
    from cohortlens.plans.tables import Tables
    return Tables(spark, DATA)
