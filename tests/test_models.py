"""Linear family and models against numpy brute force, and bounds for the learned ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import inference, linear, models, segments


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 400
    x1, x2 = rng.normal(5, 2, n), rng.normal(size=n)
    y = 1 + 0.5 * x1 - 2 * x2 + rng.normal(size=n) * (1 + np.abs(x2))
    pdf = pd.DataFrame({"id": range(n), "x1": x1, "x2": x2, "y": y, "e": np.arange(n) % 40})
    return pdf, spark.createDataFrame(pdf)


def test_ols_hc3_and_vif(spark, data):
    pdf, df = data
    fit = linear.ols(df, "y", ["x1", "x2"])
    x, y = np.c_[np.ones(len(pdf)), pdf[["x1", "x2"]].to_numpy()], pdf["y"].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    u = y - x @ b
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    v = inv @ (x.T * ((u / (1 - h)) ** 2)) @ x @ inv
    assert np.allclose(fit.beta, b) and np.allclose(fit.cov, v)
    r = np.corrcoef(pdf["x1"], pdf["x2"])[0, 1]
    assert all(abs(t["vif"] - 1 / (1 - r * r)) < 1e-9 for t in linear.vif(df, ["x1", "x2"]).collect())
    assert {r["term"] for r in fit.table(spark).collect()} == {"intercept", "x1", "x2"}


def test_count_models_reach_the_likelihood_maximum(spark):
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(3, 1, 1500).round(1))
    mu = np.exp(0.3 + 0.7 * np.log(x))
    y = rng.negative_binomial(2, 2 / (2 + mu))
    df = spark.createDataFrame(pd.DataFrame({"y": y.astype(float), "x": x}))
    fit = {r["model"]: r for r in linear.count_models(df, "y", "x").collect()}
    p, nb = fit["poisson"], fit["negative binomial"]
    m = np.exp(p["intercept"] + p["elasticity"] * np.log(x))
    assert abs((y - m).sum()) < 1e-4 * y.sum() and p["dispersion"] > 2 and nb["aic"] < p["aic"]
    assert abs(nb["alpha"] - 0.5) < 0.1 and abs(nb["elasticity"] - 0.7) < 0.05

    def loglik(a, b, alpha):
        m, r = np.exp(a + b * np.log(x)), 1 / alpha
        return sum(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) for k in y) + (r * np.log(r / (r + m)) + y * np.log(m / (r + m))).sum()
    best = loglik(nb["intercept"], nb["elasticity"], nb["alpha"])
    assert abs(-2 * best + 6 - nb["aic"]) < 1e-3
    assert all(loglik(nb["intercept"] + da, nb["elasticity"] + db, nb["alpha"] * f) <= best + 1e-6
               for da, db, f in [(0.01, 0, 1), (-0.01, 0, 1), (0, 0.005, 1), (0, -0.005, 1), (0, 0, 1.02), (0, 0, 0.98)])


def test_count_models_raise_where_they_do_not_settle(frame):
    d = linear.count_rows(frame("y double, x double", [(float(i % 7 + i), float(i + 1)) for i in range(40)]), "y", "x")
    with pytest.raises(RuntimeError):
        linear.fit_poisson(d, max_iter=2)
    with pytest.raises(RuntimeError):
        linear.fit_negative_binomial(d, rounds=2)


def test_event_study_clustered_errors(spark):
    rng = np.random.default_rng(2)
    e, t = np.repeat(np.arange(30), 4), np.tile([2000, 2001, 2002, 2003], 30)
    y = rng.normal(size=30)[e] + 0.5 * (t - 2000) + rng.normal(size=120)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "e": e, "t": t, "y": y}))
    got = {r["period"]: r for r in linear.event_study(df, "g", "e", "t", "y", [2000, 2001, 2002, 2003], 2001).collect()}
    d = np.c_[t == 2000, t == 2002, t == 2003].astype(float)
    dm = lambda v: v - np.array([v[e == i].mean(axis=0) for i in range(30)])[e]
    x, yy = dm(d), dm(y)
    b = np.linalg.lstsq(x, yy, rcond=None)[0]
    u = yy - x @ b
    s = np.array([(x[e == i] * u[e == i, None]).sum(axis=0) for i in range(30)])
    inv = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(30 / 29 * 119 / 117 * inv @ s.T @ s @ inv))
    for k, p in enumerate((2000, 2002, 2003)):
        assert abs(got[p]["estimate"] - b[k]) < 1e-9 and abs(got[p]["std_err"] - se[k]) < 1e-9
    assert got[2001]["estimate"] == 0


def test_components_and_noise(spark, data):
    pdf, df = data
    cols = ["x1", "x2", "y"]
    z = linear.standardise(df, cols)
    fit = linear.pca(z, cols)
    zz = (pdf[cols] - pdf[cols].mean()) / pdf[cols].std(ddof=0)
    assert np.allclose(np.sort(fit.eigenvalues), np.linalg.eigvalsh(np.cov(zz.T)))
    scores = fit.scores(z, 2).toPandas()
    assert abs(scores["pc1"].var() - fit.eigenvalues[0]) < 1e-9 and abs(scores["pc1"].mean()) < 1e-9
    noise = linear.noise_eigenvalues(spark, 200, 4, 300, 1).groupBy("component").agg(F.avg("eigenvalue").alias("m")).toPandas().set_index("component")["m"]
    rng = np.random.default_rng(0)
    brute = np.mean([np.linalg.eigvalsh(np.cov(rng.standard_normal((200, 4)).T))[::-1] for _ in range(300)], axis=0)
    assert np.allclose(noise.sort_index().to_numpy(), brute, atol=0.02)


def test_spearman_and_adjusted_rand(spark, data):
    pdf, df = data
    r = inference.spearman(df.withColumn("x1", F.round("x1", 0)), "x1", "y").collect()[0]["rho"]
    a, b = pdf["x1"].round().rank(), pdf["y"].rank()
    assert abs(r - np.corrcoef(a, b)[0, 1]) < 0.02
    same = df.select((F.col("id") % 3).alias("a"), ((F.col("id") + 1) % 3).alias("b"))
    assert inference.adjusted_rand(same, "a", "b").collect()[0]["ari"] == 1.0


def test_binary_metrics_known_answer(frame):
    d = frame("y int, p double", [(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)])
    r = models.binary_metrics(d, "y", "p").collect()[0]
    assert abs(r["auc"] - 0.875) < 1e-12 and abs(r["brier"] - (0.01 + 0.01 + 0.36 + 0.16) / 4) < 1e-12


def test_classifier_splits_and_bounds(spark):
    rng = np.random.default_rng(42)
    lab = np.repeat(["A", "B"], [180, 100])
    pdf = pd.DataFrame({"id": range(280), "t": lab, "x": rng.normal(size=280) + (lab == "A") * 3, "w": rng.normal(size=280)})
    df = spark.createDataFrame(pdf)
    train, test = models.stratified_split(df, "t", "id")
    assert {r["t"]: r["count"] for r in test.groupBy("t").count().collect()} == {"A": 45, "B": 25} and train.count() == 210
    r = models.classify_types(df, ["x", "w"], "t", "id", trees=20)
    assert r.metrics["accuracy"] > 0.8 and {x["class"] for x in r.report.collect()} == {"A", "B"}
    with pytest.raises(ValueError):
        models.classify_types(df.filter("x > 99"), ["x", "w"], "t", "id", trees=2)


def test_segments(spark):
    rng = np.random.default_rng(4)
    c = np.repeat([[0, 0], [8, 8], [0, 9]], 40, axis=0) + rng.normal(size=(120, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(120), "a": c[:, 0], "b": c[:, 1], "true": np.repeat([0, 1, 2], 40)}))
    v = segments.feature_vectors(df, ["a", "b"], ["id", "true"])
    out = segments.fit_kmeans(v, 3, (0, 1)).transform(v)
    assert inference.adjusted_rand(out, "true", "prediction").collect()[0]["ari"] > 0.9
    assert segments.choose_k(segments.selection_table(v, [2, 3], 2, mixture=False), 2, 5) == 3
    assert segments.distance_to_centre(v, 3, ["id"]).agg(F.min("distance")).collect()[0][0] >= 0


@pytest.mark.parametrize("name", ["m09_regression_comparison", "m11_permutation_importance", "m12_classifier_comparison"])
def test_boosting_queries_grow_300_trees(spark, monkeypatch, name):
    from cohortlens.plans import catalog
    asked = []

    def spy(inner):
        def made(**kw):
            asked.append(kw["maxIter"])
            return inner(**{**kw, "maxIter": 1})
        return made

    monkeypatch.setattr(models, "GBTRegressor", spy(models.GBTRegressor))
    monkeypatch.setattr(models, "GBTClassifier", spy(models.GBTClassifier))
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked and set(asked) == {300}


@pytest.mark.parametrize("name, starts, mixtures", [("m04_embedding_clusters_vs_labels", 10, 0), ("m05_choose_k", 20, 3), ("m06_mixture_agreement", 10, 5)])
def test_clustering_queries_take_all_starts(spark, monkeypatch, name, starts, mixtures):
    """The distinct seeds of each number of clusters."""
    from cohortlens.plans import catalog
    inner, asked = segments.fit_kmeans, []

    def kmeans(v, k, seeds=tuple(range(10)), max_iter=40):
        asked.append(len(set(seeds)))
        return inner(v, k, seeds[:1], 2)

    mixed = {}

    def mixture(**kw):
        mixed.setdefault(kw["k"], set()).add(kw["seed"])
        return made(**{**kw, "maxIter": 2})

    made = segments.GaussianMixture
    monkeypatch.setattr(segments, "fit_kmeans", kmeans)
    monkeypatch.setattr(segments, "GaussianMixture", mixture)
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked and set(asked) == {starts} and all(len(s) == mixtures for s in mixed.values()) and bool(mixed) == bool(mixtures)


def test_mixture_keeps_the_likeliest_start(spark):
    rng = np.random.default_rng(8)
    c = np.repeat([[0, 0], [6, 6], [0, 7], [7, 0]], 30, axis=0) + rng.normal(size=(120, 2))
    v = segments.feature_vectors(spark.createDataFrame(pd.DataFrame({"id": range(120), "a": c[:, 0], "b": c[:, 1]})), ["a", "b"], ["id"])
    single = [segments.fit_mixture(v, 4, (s,)).summary.logLikelihood for s in range(3)]
    assert segments.fit_mixture(v, 4, (0, 1, 2)).summary.logLikelihood == pytest.approx(max(single))
