"""Registered queries against DuckDB on the smallest data; tools/verify.py runs all of them."""

import math

import duckdb
import pytest

from cohortlens.plans import catalog
from tests.conftest import DATA

SAMPLE = ["p06_three_ratios", "p13_feature_coverage", "f12_grad_rates", "f22_series_growth", "j05_effective_dated_crosswalk", "j07_all_targets_peer_mean",
          "j08_nearest_peers", "w06_average_rank", "w08_robust_z", "a04_describe", "a18_histogram", "q01_one_pass_validation", "d03_complementary_suppression",
          "b06_reconstruction", "t02_mann_whitney_u", "t04_variance_tests", "t05_bootstrap_interval", "t18_event_study_estimates", "m12_binary_metrics",
          "a16_kpi_block", "s15_report_rows", "k05_serving_records"]


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in (x.asDict() for x in df.collect()))
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_registry_is_consistent():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() == 5
