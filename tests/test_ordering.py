"""The distributed ordering against numpy, on skewed data, in two buckets and in many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ordering


@pytest.fixture(scope="module", params=[250_000, 300])
def path(request):
    saved = ordering.BUCKET_ROWS
    ordering.BUCKET_ROWS = request.param
    yield request.param
    ordering.BUCKET_ROWS = saved


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value a third of them."""
    rng = np.random.default_rng(7)
    g = np.where(rng.random(6000) < 0.7, "hot", rng.choice(list("abcdef"), 6000))
    v = np.where(rng.random(6000) < 0.33, 5.0, np.round(rng.lognormal(1, 1, 6000), 3))
    pdf = pd.DataFrame({"id": np.arange(6000), "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_numpy(path, skewed):
    pdf, df = skewed
    got = {r["g"]: (r["p1"], r["med"], r["p99"]) for r in ordering.quantiles(df, ["g"], "v", {"p1": 0.01, "med": 0.5, "p99": 0.99}).collect()}
    for g, x in pdf.groupby("g")["v"]:
        assert np.allclose(got[g], np.quantile(x, [0.01, 0.5, 0.99]))


def test_average_ranks_match_pandas(path, skewed):
    pdf, df = skewed
    got = ordering.average_rank(df, ["g"], "v", "r", descending=True).select("id", "r").toPandas().sort_values("id")["r"].to_numpy()
    assert np.allclose(got, pdf.groupby("g")["v"].rank(ascending=False).to_numpy())


def test_global_running_sum(path, skewed):
    pdf, df = skewed
    counts = df.groupBy("id").agg(F.sum("v").alias("s"))
    got = ordering.running(counts, [], ["id"], ["s"]).toPandas().sort_values("id")
    want = pdf["v"].cumsum() - pdf["v"]
    assert np.allclose(got["s_below"], want) and np.allclose(got["s_total"], pdf["v"].sum())


def test_picks_and_bins(path, skewed):
    pdf, df = skewed
    s = np.sort(pdf["v"].to_numpy())
    r = ordering.picks(df, [], "v", {"a": 0.2, "b": 0.9}).collect()[0]
    assert (r["a"], r["b"]) == (s[int(0.2 * (len(s) - 1))], s[int(0.9 * (len(s) - 1))])
    bins = ordering.quantile_bins(df, [], "v", 4, "q").toPandas()
    edges = np.quantile(pdf["v"], [0.25, 0.5, 0.75])
    want = 1 + (bins["v"].to_numpy()[:, None] > edges).sum(axis=1)
    assert (bins["q"].to_numpy() == want).all()


def test_missing_values_and_groups_are_left_out(spark, path):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 9.0), ("a", float("nan")), ("a", 3.0)], "g string, v double")
    assert [tuple(r) for r in ordering.medians(df, ["g"], "v").collect()] == [("a", 2.0)]


def test_positions_are_dense(path, skewed):
    _, df = skewed
    r = ordering.row_positions(df.select("g", "id"), ["g"], ["id"]).groupBy("g").agg(
        F.min("position").alias("a"), F.max("position").alias("b"), F.count_distinct("position").alias("c"), F.count("*").alias("n"))
    assert all(x["a"] == 1 and x["b"] == x["c"] == x["n"] for x in r.collect())


def test_long_values_keep_their_rank(spark):
    df = spark.createDataFrame([(1, 2**53), (2, 2**53 + 1), (3, None)], "id int, v long")
    assert {r["id"]: r["r"] for r in ordering.average_rank(df, [], "v", "r").collect()} == {1: 1.0, 2: 2.0, 3: None}


def test_spearman_reads_its_rows_once(spark):
    """Values that come out a little different whenever they are computed again: every row keeps its rank."""
    import random

    from cohortlens.operators import inference

    def shaken(batches):
        for pdf in batches:
            pdf["y"] = pdf["x"] + [random.SystemRandom().random() * 1e-9 for _ in range(len(pdf))]
            yield pdf
    df = spark.range(300).select((F.col("id") % 100).cast("double").alias("x")).mapInPandas(shaken, "x double, y double")
    r = inference.spearman(df, "x", "y").first()
    assert r["n"] == 300 and r["rho"] > 0.99
