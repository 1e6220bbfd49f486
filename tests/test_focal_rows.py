"""Queries that ask for one focal row, on tables that lack it: no rows, as their SQL gives."""

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["j07_rule_peers", "w07_focal_percentile"])
def test_no_focal_row_gives_no_rows(spark, tmp_path, name):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").filter(~((F.col("o_custkey") == 7) & (F.year("o_orderdate") == 1997)))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{DATA}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    assert catalog.queries()[name](spark, str(tmp_path)).collect() == []
