"""Many k-means fits side by side against each alone, and against numpy from the same starts."""

import numpy as np
import pytest

from cohortlens.operators import inference, lloyd, segments
from cohortlens.plans import catalog


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(6)
    x = np.repeat([[0, 0, 1], [9, 8, 0], [0, 9, 5], [7, 0, 9]], 50, axis=0) + r.normal(size=(200, 3))
    inside = np.stack([np.ones(200, bool), r.random(200) < 0.8, r.random(200) < 0.5], axis=1)
    return x, inside


@pytest.fixture(scope="module")
def rows(spark, points):
    x, inside = points
    return spark.createDataFrame([(i, x[i].tolist(), inside[i].tolist()) for i in range(len(x))], "id long, x array<double>, inside array<boolean>").repartition(5)


def plain(x, centres, max_iter=40, tolerance=1e-4):
    for step in range(1, max_iter + 1):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(len(centres))])
        far = np.sqrt(((new - centres) ** 2).sum(1)).max()
        centres = new
        if far <= tolerance:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), step


def test_all_models_equal_single_fits_and_numpy(rows, points):
    x, inside = points
    seed, sample = [1, 2, 3, 1, 2, 5], [0, 0, 0, 1, 1, 2]
    together = lloyd.many_kmeans(rows, 4, seed, sample)
    begun = lloyd.starts(rows, 4, np.array(seed), np.array(sample))
    for j in range(len(seed)):
        mine = x[inside[:, sample[j]]]
        assert all((np.abs(mine - c).sum(1) < 1e-12).any() for c in begun[j])  # starts are rows of the sample
        centres, cost, steps = plain(mine, begun[j])
        assert together.centres[j] == pytest.approx(centres) and together.cost[j] == pytest.approx(cost) and together.steps[j] == steps
    alone = lloyd.many_kmeans(rows.repartition(2), 4, seed[3:4], sample[3:4])
    assert alone.centres[0] == pytest.approx(together.centres[3])
    assert together.best(0) in (0, 1, 2) and together.cost[together.best(0)] == together.cost[:3].min()


def test_starts_follow_the_squared_distance(spark):
    """The second centre of many models: a far point is drawn as often as its squared distance says."""
    rows = spark.createDataFrame([(i, [float(v)], [True]) for i, v in enumerate([0, 0, 0, 1, 3])], "id long, x array<double>, inside array<boolean>")
    begun = lloyd.starts(rows, 2, np.arange(3000), np.zeros(3000, int))[:, :, 0]
    assert abs((begun[:, 0] == 0).mean() - 0.6) < 0.04
    after = begun[begun[:, 0] == 0, 1]
    assert set(after) == {1.0, 3.0} and abs((after == 3).mean() - 0.9) < 0.03


def test_stability_of_planted_clusters_and_counts(spark, points):
    x, _ = points
    v = segments.feature_vectors(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double, c double"), ["a", "b", "c"], ["id"])
    out = segments.stability(v, "id", 4, runs=5, starts=4).collect()
    assert sorted(r.run for r in out) == list(range(5)) and all(r.ari > 0.97 and 120 < r.n < 190 for r in out)
    few = segments.stability(v.filter("id < 3"), "id", 4, runs=2, share=2.0, starts=2).collect()  # fewer rows than clusters
    assert all(r.n == 3 and r.ari == 1 for r in few)


def test_rand_index_of_cells_equals_that_of_rows(spark):
    r = np.random.default_rng(1)
    pairs = [(int(g), int(a), int(b)) for g, a, b in zip(r.integers(0, 2, 80), r.integers(0, 3, 80), r.integers(0, 4, 80), strict=True)]
    df = spark.createDataFrame(pairs, "g int, a int, b int")
    cells = df.groupBy("g", "a", "b").count().withColumnRenamed("count", "n")
    got = {x.g: (x.n, x.ari) for x in inference.adjusted_rand_of_cells(cells, "g", "a", "b").collect()}
    for g in (0, 1):
        w = inference.adjusted_rand(df.filter(df.g == g), "a", "b").first()
        assert got[g] == (w.n, pytest.approx(w.ari))


def test_query_takes_all_starts(spark, monkeypatch):
    asked = []
    inner = segments.many_kmeans
    monkeypatch.setattr(segments, "many_kmeans", lambda rows, k, seed, sample: (asked.append((k, len(seed), len(set(sample)))), inner(rows, k, seed, sample, max_iter=2))[1])
    assert catalog.queries()["m06_stability"](spark, "/root/testdata/sf0.001").count() == 30
    assert asked == [(6, 310, 31)]


def test_cluster_sums_of_all_models_at_once():
    from cohortlens.operators import lloyd
    r = np.random.default_rng(1)
    x, centres, inside = r.normal(size=(70, 3)), r.normal(size=(5, 4, 3)), r.random((70, 5)) < 0.7
    squared = ((x[:, None, None] - centres) ** 2).sum(axis=3)
    assert np.allclose(lloyd.distances(x, centres), squared)
    label = squared.argmin(axis=2)
    got = lloyd.cluster_sums(x, label, inside, 4)
    for m in range(5):
        for k in range(4):
            mine = inside[:, m] & (label[:, m] == k)
            assert np.allclose(got[m, k], [*x[mine].sum(axis=0), mine.sum()])
    assert (lloyd.nearest(x, centres) == label).all()


def test_all_numbers_of_clusters_share_the_scans(spark, points, monkeypatch):
    """The fits of three k from two seeds equal those of each k alone, in as many scans as the slowest."""
    x, _ = points
    scans, inner = [], lloyd._summed
    monkeypatch.setattr(lloyd, "_summed", lambda *a: (scans.append(a[2]), inner(*a))[1])
    v = segments.feature_vectors(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double, c double"), ["a", "b", "c"], ["id"])
    rows = spark.createDataFrame([(i, p.tolist(), [True]) for i, p in enumerate(x)], "id long, x array<double>, inside array<boolean>")
    got = lloyd.several_kmeans(rows, [2, 4, 5], [1, 2], [0, 0])
    assert len(scans) == max(f.steps.max() for f in got) + 1
    begun = lloyd.starts(rows, 5, np.array([1, 2]), np.zeros(2, int))
    for k, fits in zip((2, 4, 5), got, strict=True):
        for j in range(2):
            centres, cost, steps = plain(x, begun[j, :k])
            assert fits.centres[j] == pytest.approx(centres) and fits.cost[j] == pytest.approx(cost) and fits.steps[j] == steps
    scans.clear()
    table = segments.selection_table(v, [2, 4, 5], 3, (0, 1), mixture=False)
    assert len(scans) <= 42 and segments.choose_k(table, 2, 5) == 4 and table.filter("k = 4").first().smallest == 50
