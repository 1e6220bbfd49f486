"""Boosting of all folds in shared scans against Spark ML's own trees, fold by fold."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cohortlens.operators import boosting, models
from cohortlens.operators.lineage import cut


@pytest.fixture(scope="module")
def rows(spark):
    """Few values, so that every fold has the same cut points; the missing ones matter."""
    r, out = np.random.default_rng(3), []
    for i in range(900):
        x, z, g = float(r.integers(0, 12)), None if r.random() < 0.3 else float(r.integers(0, 9)), "abc"[r.integers(0, 3)]
        y = np.sin(x) + (2.0 if z is None else 0.2 * z) + (g == "b") * 0.5 * x + r.normal() * 0.3
        out.append((i, float(y), float(y > 2), x, z, g))
    d = spark.createDataFrame(out, "id long, y double, c double, x double, z double, g string")
    return cut(d.withColumn("fold", models.hash_fold("id", 3, 42)).coalesce(2))


@pytest.mark.parametrize("kind, y, binary", [(GBTRegressor, "y", False), (GBTClassifier, "c", True)])
def test_equal_to_spark_over_every_refresh(rows, monkeypatch, kind, y, binary):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    monkeypatch.setattr(boosting, "FEW_CELLS", 50)
    settings = models.boosting(kind, y, 1, 8)
    got = {r.id: r.p for r in boosting.fit_folds(rows, ["x", "z"], ["g"], y, settings, 3, binary).transform(rows).collect()}
    out = F.get(vector_to_array("probability"), F.lit(1)) if binary else F.col("prediction")
    want = models.out_of_fold(models.two_sided(rows, ["x", "z"]), [*models.tree_preparation(["x", "z"], ["g"]), settings], 3, out).collect()
    assert len(got) == len(want) == 900 and all(got[r.id] == pytest.approx(r.p, abs=1e-9) for r in want)


def test_folds_share_the_scans(rows, monkeypatch):
    """A scan a level of a tree, whatever the number of folds."""
    scans, inner = [], boosting._splits
    monkeypatch.setattr(boosting, "_splits", lambda counts, *a: (scans.append(counts.shape[:2]), inner(counts, *a))[1])
    fit = boosting.fit_folds(rows, ["x", "z"], ["g"], "y", models.boosting(GBTRegressor, "y", 1, 2), 3, binary=False)
    assert len(fit.trees) == 2 and scans == [(3, 1 << level) for level in range(5)] * 2


def test_many_values_are_cut_at_quantiles(spark):
    d = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    cuts = boosting.layout(d, ["x"], [], 16).cuts[0]
    assert len(cuts) == 15 and np.abs(cuts - np.arange(1, 16) * 312.5).max() < 5
    assert len(boosting.layout(d.limit(16), ["x"], [], 16).cuts[0]) == 15


def test_fold_without_rows_to_learn_from_raises(rows):
    with pytest.raises(ValueError, match="no rows to learn from"):
        boosting.fit_folds(rows.filter("fold = 0"), ["x"], [], "y", models.boosting(GBTRegressor, "y", 1, 1), 3, binary=False)
