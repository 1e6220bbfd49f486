"""Mixtures of several starts in shared scans against Spark ML's own."""

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture

from cohortlens.operators import mixtures, segments


@pytest.fixture(scope="module")
def v(spark):
    r = np.random.default_rng(11)
    x = np.repeat([[0, 0, 0], [5, 1, 0], [0, 6, 2]], 80, axis=0) + r.normal(size=(240, 3)) * [1, 2, 0.5]
    return segments.feature_vectors(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double, c double"), ["a", "b", "c"], ["id"])


def test_equal_to_spark_and_one_pass_a_step(v, monkeypatch):
    """Each start is Spark ML's with one step; the other steps of all starts are shared."""
    asked, steps, step = [], [], mixtures.step

    def made(**kw):
        asked.append(kw["maxIter"])
        return GaussianMixture(**kw)

    def counted(rows, weights, *rest):
        steps.append(len(weights))
        return step(rows, weights, *rest)

    monkeypatch.setattr(segments, "GaussianMixture", made)
    monkeypatch.setattr(mixtures, "step", counted)
    got = segments.fit_mixture(v, 3, (0, 1, 2))
    assert asked == [1, 1, 1] and steps[0] == 3 and len(steps) < 50
    want = max((GaussianMixture(k=3, seed=s, maxIter=50).fit(v) for s in (0, 1, 2)), key=lambda m: m.summary.logLikelihood)
    assert got.summary.logLikelihood == pytest.approx(want.summary.logLikelihood, rel=1e-9) and got.getK() == 3
    assert got.weights == pytest.approx(np.array(want.weights), rel=1e-6)
    label = lambda m: {r.id: r.prediction for r in m.transform(v).select("id", "prediction").collect()}
    assert label(got) == label(want)


def test_flat_covariance_has_a_pseudo_inverse():
    maps, factors = mixtures.whitened(np.array([[[1.0, 2.0]]]), np.array([[[[4.0, 0.0], [0.0, 0.0]]]]))
    p = mixtures.densities(np.array([[3.0, 9.0]]), np.ones((1, 1)), maps, factors)
    assert p[0, 0, 0] == pytest.approx(np.exp(-0.5 - np.log(2 * np.pi)) / 2)
    with pytest.raises(ValueError):
        mixtures.whitened(np.zeros((1, 1, 2)), np.zeros((1, 1, 2, 2)))


def test_several_numbers_of_components_share_the_steps(v, monkeypatch):
    scans, steps = [], mixtures.steps
    monkeypatch.setattr(mixtures, "steps", lambda rows, groups: (scans.append(len(groups)), steps(rows, groups))[1])
    both = segments.fit_mixture(v, [2, 3], (0, 1))
    assert scans[0] == 2 and len(scans) < 50
    for k, m in zip((2, 3), both, strict=True):
        assert m.getK() == k and m.summary.logLikelihood == pytest.approx(segments.fit_mixture(v, k, (0, 1)).summary.logLikelihood, rel=1e-12)
