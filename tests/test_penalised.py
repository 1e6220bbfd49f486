"""Folds from cross products against the same models fitted on the rows with numpy."""

import hashlib
import math

import numpy as np
import pytest

from cohortlens.operators import models as mo
from cohortlens.operators import penalised as pe


def fold_of(*parts, folds=5):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % folds


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    out = []
    for i in range(300):
        a, b, c = r.normal(50, 4), r.normal(), r.exponential(2)
        g = "xyz"[i % 3]
        y = 0.2 * a - 1.5 * b + (g == "y") * 2 + r.normal()
        out.append((i, y if i % 61 else None, None if i % 7 == 0 else a, math.nan if i % 11 == 0 else b, c, g if i % 83 else None))
    return out


@pytest.fixture(scope="module")
def frame_(spark, rows):
    return spark.createDataFrame(rows, "id long, y double, a double, b double, c double, g string").repartition(6)


def features(train, test):
    """Imputed and scaled as fitted on the training rows; both sides."""
    cols, out = [], []
    for k in (2, 3, 4):
        v = np.array([np.nan if r[k] is None else r[k] for r in train + test], float)
        known = v[: len(train)]
        filled = np.where(np.isnan(v), np.nanmedian(known), v)
        cols.append((filled, np.isnan(v)))
    for filled, _ in cols:
        out.append(filled)
    for _, gone in cols:
        if gone[: len(train)].any():
            out.append(gone.astype(float))
    out = [(x - x[: len(train)].mean()) / x[: len(train)].std() for x in out]
    out += [np.array([float(r[5] == level) for r in train + test]) for level in "yz"]
    x = np.stack(out, axis=1)
    return x[: len(train)], x[len(train):]


def centred_fit(x, y, solve):
    m, my = x.mean(0), y.mean()
    beta = solve(x - m, y - my)
    return beta, my - m @ beta


def lasso_rows(x, y, penalty, beta=None):
    beta = np.zeros(x.shape[1]) if beta is None else beta.copy()
    for _ in range(3000):
        old = beta.copy()
        for j in range(len(beta)):
            part = y - x @ beta + x[:, j] * beta[j]
            pull = x[:, j] @ part / len(y)
            beta[j] = np.sign(pull) * max(abs(pull) - penalty, 0) / (x[:, j] @ x[:, j] / len(y))
        if np.abs(beta - old).max() < 1e-11:
            break
    return beta


def by_rows(rows):
    used = [r for r in rows if r[1] is not None and r[5] is not None]
    out = {}
    for f in range(5):
        train, test = [r for r in used if fold_of(42, r[0]) != f], [r for r in used if fold_of(42, r[0]) == f]
        x, xt = features(train, test)
        y, yt = np.array([r[1] for r in train]), np.array([r[1] for r in test])
        rmse = lambda beta, b0: float(np.sqrt(np.mean((yt - xt @ beta - b0) ** 2)))
        out[f, "OLS"] = (rmse(*centred_fit(x, y, lambda u, v: np.linalg.lstsq(u, v, rcond=None)[0])), None)
        errors = []
        for a in pe.RIDGE_PENALTIES:  # leave-one-out by leaving one out
            e = 0.0
            for i in range(0, len(y)):
                k = np.arange(len(y)) != i
                m, my = x[k].mean(0), y[k].mean()
                # the intercept carries no penalty, the centring is the full rows' own hat matrix: refit without row i
                u, v = x[k] - m, y[k] - my
                beta = np.linalg.solve(u.T @ u + a * np.eye(u.shape[1]), u.T @ v)
                e += (y[i] - my - (x[i] - m) @ beta) ** 2
            errors.append(e)
        best = float(pe.RIDGE_PENALTIES[int(np.argmin(errors))])
        out[f, "ridge"] = (rmse(*centred_fit(x, y, lambda u, v: np.linalg.solve(u.T @ u + best * np.eye(u.shape[1]), u.T @ v))), best)
        inner = np.array([fold_of(42, "inner", r[0]) for r in train])
        u, v = x - x.mean(0), y - y.mean()
        top = np.abs(u.T @ v).max() / len(y)
        path, errors = np.geomspace(top, top / 1000, 100), []
        for j in range(5):
            k, beta, row = inner != j, None, []
            m, my = x[k].mean(0), y[k].mean()
            for a in path:
                beta = lasso_rows(x[k] - m, y[k] - my, a, beta)
                row.append(np.mean((y[~k] - my - (x[~k] - m) @ beta) ** 2))
            errors.append(row)
        best = float(path[int(np.argmin(np.mean(errors, axis=0)))])
        out[f, "lasso"] = (rmse(*centred_fit(x, y, lambda u, v: lasso_rows(u, v, best))), best)
    return out


def test_folds_equal_the_rows(frame_, rows):
    got = {(r.fold, r.model): (r.rmse, r.penalty) for r in pe.linear_comparison(frame_, ["a", "b", "c"], ["g"], "y", "id").collect()}
    want = by_rows(rows)
    assert set(got) == set(want)
    for k, (rmse, penalty) in want.items():
        assert got[k][0] == pytest.approx(rmse, rel=1e-7), k
        assert (got[k][1] is None and penalty is None) or got[k][1] == pytest.approx(penalty, rel=1e-9), k


def test_edges(spark, frame_):
    constant = frame_.selectExpr("id", "y", "5.0D a", "cast(null as double) b", "c", "'only' g")
    rows = pe.linear_comparison(constant, ["a", "b", "c"], ["g"], "y", "id").collect()
    assert len(rows) == 15 and all(math.isfinite(r.rmse) for r in rows)
    only = pe.linear_comparison(frame_, [], ["g"], "y", "id", names=("OLS",)).collect()
    assert len(only) == 5
    with pytest.raises(ValueError, match="no complete rows"):
        pe.linear_comparison(frame_.limit(0), ["a"], [], "y", "id")
    with pytest.raises(ValueError, match="columns"):
        pe.MOST_COLUMNS, kept = 3, pe.MOST_COLUMNS
        try:
            pe.linear_comparison(frame_, ["a", "b"], [], "y", "id")
        finally:
            pe.MOST_COLUMNS = kept


def test_lasso_says_when_it_does_not_settle():
    x = np.array([[1.0, 0.999], [0.999, 1.0]])
    p = pe.Prepared(np.eye(2), 1, np.zeros(2), x, np.array([1.0, -1.0]), 1.0, 0.0)
    with pytest.raises(RuntimeError, match="settle"):
        pe.lasso(p, 1e-9, sweeps=2)


def test_boosting_learns_the_side_of_missing_values(spark):
    """y is high where x is missing and low elsewhere, whatever x is: filling in a median would hide it."""
    r = np.random.default_rng(1)
    rows = [(i, float(10 * (i % 4 == 0)) + r.normal() * 0.1, None if i % 4 == 0 else float(r.normal()), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y double, x double, g string")
    oof = mo.boosted_folds(df, ["x"], ["g"], "y", "id", folds=2, iterations=40)
    assert oof.count() == 400
    assert oof.selectExpr("max(abs(p - y))").first()[0] < 2
    both = mo.two_sided(df, ["x"]).filter("id = 0").first()
    assert both["_lo_x"] < -1e300 and both["_hi_x"] > 1e300


def test_comparison_tables(frame_):
    out = {r.model: r for r in mo.compare_regressions(frame_, ["a", "b", "c"], ["g"], "y", "id", iterations=3).collect()}
    assert set(out) == {"baseline (mean)", "OLS", "ridge", "lasso", "gradient boosting"}
    assert len(out["ridge"].penalties) == 5 and out["OLS"].penalties == [] and out["OLS"].rmse < out["baseline (mean)"].rmse
    ways = mo.missing_strategies(frame_, ["b", "c"], "a", ["g"], "y", "id", iterations=3).collect()
    assert len(ways) == 6 and {r.sample for r in ways} == {"all", "reporters"} and sum("boosting" in r.model for r in ways) == 2


def test_importance_and_classifiers_on_missing_values(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor
    r = np.random.default_rng(2)
    rows = [(i, float(i % 5 == 0), None if i % 5 == 0 else float(r.normal()), float(r.normal()), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y double, x double, noise double, g string")
    ready = lambda d: mo.two_sided(d, ["x", "noise"])
    model = Pipeline(stages=[*mo.tree_preparation(["x", "noise"], ["g"]), mo.boosting(GBTRegressor, "y", 1, 10)]).fit(mo.few_files(ready(df)))
    got = {x.feature: x.rmse_increase for x in mo.permutation_importance(model, df, ["x", "noise", "g"], "y", "id", repeats=3, prepare=ready).collect()}
    assert got["x"] > 0.1 and abs(got["noise"]) < 0.02 and abs(got["g"]) < 0.02
    p = mo.classify_oof(df, ["x", "noise"], ["g"], "y", "id", "gradient boosting", folds=2, iterations=5)
    assert mo.binary_metrics(p, "y", "p").first()["auc"] == 1.0 and p.count() == 300
