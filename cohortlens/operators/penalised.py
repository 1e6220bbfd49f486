"""OLS, ridge and lasso over folds from one table of cross products.

The rows are read twice: once for the cross products of every (fold, inner fold) cell, once for the leave-one-out errors of
all ridge penalties of all folds. Everything else - imputation by the training median, indicators, scaling, dummies, fits
along the penalty paths, held-out errors - is linear algebra on sums of cells, whose size does not depend on the rows:
an imputed column is its known part plus the median times its indicator, so even the medians enter after the sums are made.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering
from .guards import require
from .lineage import cut
from .resample import hash32

RIDGE_PENALTIES = np.logspace(-3, 3, 25)
LASSO_STEPS, LASSO_SHORTEST = 100, 1e-3
INNER = 5
MOST_COLUMNS = 2000  # of the cross products: what the driver holds is bounded by this


@dataclass
class Cells:
    """Cross products of [1, known parts, indicators, dummies, y] by (fold, inner fold), with what the columns mean."""
    numeric: list[str]
    dummies: list[tuple[str, str]]
    shift: dict[str, float]
    y: str
    medians: dict[tuple[int, str], float]
    tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return 2 + 2 * len(self.numeric) + len(self.dummies)

    def columns(self) -> list[Column]:
        """The raw columns of a row, in the order of the cross products."""
        known = [F.coalesce(F.col(c).cast("double") - F.lit(self.shift[c]), F.lit(0.0)) for c in self.numeric]
        missing = [F.col(c).isNull().cast("double") for c in self.numeric]
        return [F.lit(1.0), *known, *missing, *[(F.col(c) == level).cast("double") for c, level in self.dummies], F.col(self.y).cast("double") - F.lit(self.shift[self.y])]

    def total(self, keep) -> np.ndarray:
        return sum((g for k, g in self.tables.items() if keep(*k)), np.zeros((self.width, self.width)))


def cross_products(df: DataFrame, cells: Cells, keys: list[str]) -> dict[tuple[int, ...], np.ndarray]:
    """The sum of outer products of the raw columns in every cell; a task adds up its rows and sends each cell once."""
    width = cells.width

    def run(batches):
        sums: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            at = [batch.column(i).to_numpy() for i in range(len(keys))]
            x = np.stack([c.to_numpy() for c in batch.columns[len(keys):]], axis=1)
            for key in set(zip(*(a.tolist() for a in at), strict=True)):
                rows = x[np.all([a == k for a, k in zip(at, key, strict=True)], axis=0)]
                sums[key] = sums.get(key, 0) + rows.T @ rows
        place = np.arange(width * width)
        for key, g in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(place), k)) for k in key), pa.array(place), pa.array(g.ravel())], [*keys, "place", "v"])

    rows = df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[c.alias(f"_x{i}") for i, c in enumerate(cells.columns())])
    parts = rows.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", place long, v double").groupBy(*keys, "place").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, ...], np.ndarray] = {}
    for r in parts.toArrow().to_pylist():
        out.setdefault(tuple(r[k] for k in keys), np.zeros(width * width))[r["place"]] = r["v"]
    return {k: g.reshape(width, width) for k, g in out.items()}


def training_medians(df: DataFrame, numeric: list[str], folds: int) -> dict[tuple[int, str], float]:
    """The median of each column over the rows outside each fold: one ordering pass whose counts are kept by fold."""
    if not numeric:
        return {}
    long = df.select("fold", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(["fold"], numeric, "metric", "_v")
    outside = {f"t{i}": F.count_if(F.col("fold") != i) for i in range(folds)}
    at = ordering.running(ordering.value_counts(long, ["metric"], "_v", outside), ["metric"], ["_value"], list(outside))
    aggs = []
    for t in outside:
        for side, rank in (("lo", F.floor((F.col(f"{t}_total") - 1) / 2)), ("hi", F.ceil((F.col(f"{t}_total") - 1) / 2))):
            aggs.append(F.max(F.when((F.col(f"{t}_below") <= rank) & (rank < F.col(f"{t}_below") + F.col(t)), F.col("_value"))).alias(f"{t}_{side}"))
    rows = at.groupBy("metric").agg(*aggs).collect()
    # a column without values outside a fold is filled with the shift, so it says nothing there
    return {(i, r["metric"]): (r[f"t{i}_lo"] + r[f"t{i}_hi"]) / 2 for r in rows for i in range(folds) if r[f"t{i}_lo"] is not None}


def fold_cells(df: DataFrame, numeric: list[str], categorical: list[str], y: str, entity: str, folds: int, seed: int) -> tuple[DataFrame, Cells]:
    """(the rows with fold and inner fold, their cross products). Rows without y are left out; a NaN counts as missing."""
    require(df, [*numeric, *categorical, y, entity], "regression table")
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in (*numeric, y)]
    d = df.select(entity, *clean, *[F.col(c).cast("string").alias(c) for c in categorical]).dropna(subset=[y, *categorical])
    d = cut(d.withColumns({"fold": F.pmod(hash32(seed, entity), F.lit(folds)).cast("int"), "inner": F.pmod(hash32(seed, F.lit("inner"), entity), F.lit(INNER)).cast("int")}))
    first = d.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (*numeric, y)]).first()
    if not first["n"]:
        raise ValueError("no complete rows to fit on")
    levels = [(c, r[0]) for c in categorical for r in d.groupBy(c).count().sort(c).collect()[1:]]  # the first level is the reference
    cells = Cells(numeric, levels, {c: first[c] or 0.0 for c in (*numeric, y)}, y, training_medians(d, numeric, folds))
    if cells.width > MOST_COLUMNS:
        raise ValueError(f"{cells.width} columns: the cross products are kept for at most {MOST_COLUMNS}")
    cells.tables = cross_products(d, cells, ["fold", "inner"])
    return d, cells


@dataclass
class Prepared:
    """A fold's training features as a linear map from the raw columns (``to``), and their centred cross products."""
    to: np.ndarray
    n: float
    mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    y_mean: float

    @classmethod
    def of(cls, g: np.ndarray, to: np.ndarray) -> Prepared:
        n, mean = g[0, 0], g[0] @ to / g[0, 0]
        y_mean = g[0, -1] / n
        return cls(to, n, mean, to.T @ g @ to - n * np.outer(mean, mean), to.T @ g[:, -1] - n * mean * y_mean, g[-1, -1] - n * y_mean**2, y_mean)

    def raw(self, beta: np.ndarray) -> np.ndarray:
        """Coefficients of the residual y - prediction on the raw columns."""
        v = -self.to @ beta
        v[0] -= self.y_mean - self.mean @ beta
        v[-1] += 1
        return v


def prepared(cells: Cells, fold: int, *, scale: bool = True) -> Prepared:
    """Imputed and scaled numeric columns, scaled indicators where anything is missing, plain dummies: as fitted outside ``fold``."""
    g, k = cells.total(lambda f, _: f != fold), len(cells.numeric)
    if not g[0, 0]:
        raise ValueError(f"no rows outside fold {fold}")
    maps = []
    for j, c in enumerate(cells.numeric):
        a = np.zeros(cells.width)
        a[1 + j] = 1
        a[1 + k + j] = cells.medians.get((fold, c), cells.shift[c]) - cells.shift[c]
        maps.append(a)
    for j in range(k):
        if g[0, 1 + k + j]:
            maps.append(np.eye(cells.width)[1 + k + j])
    if scale:
        for a in maps:
            mean = g[0] @ a / g[0, 0]
            var = a @ g @ a / g[0, 0] - mean**2
            a /= np.sqrt(var) if var > 1e-12 * max(1.0, a @ g @ a / g[0, 0]) else 1.0
    maps += [np.eye(cells.width)[1 + 2 * k + j] for j in range(len(cells.dummies))]
    return Prepared.of(g, np.array(maps).T if maps else np.zeros((cells.width, 0)))


def ols(p: Prepared) -> np.ndarray:
    """Least squares; of equally good coefficients (a level not met in fitting) the smallest."""
    return np.linalg.pinv(p.xx, rcond=1e-11, hermitian=True) @ p.xy


def ridge(p: Prepared, penalty: float) -> np.ndarray:
    value, vector = np.linalg.eigh(p.xx)
    return vector @ ((vector.T @ p.xy) / (np.maximum(value, 0) + penalty))


def lasso(p: Prepared, penalty: float, start: np.ndarray | None = None, tolerance: float = 1e-10, sweeps: int = 20_000) -> np.ndarray:
    """Coordinate descent on the cross products: the least of half the mean squared error plus penalty times the sum of |beta|."""
    c, b = p.xx / p.n, p.xy / p.n
    beta = np.zeros(len(b)) if start is None else start.copy()
    size = np.diag(c).copy()
    step = float("inf")
    for _ in range(sweeps):
        step = 0.0
        for j in np.flatnonzero(size > 1e-14):
            pull = b[j] - c[j] @ beta + size[j] * beta[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0) / size[j]
            step = max(step, abs(new - beta[j]) * np.sqrt(size[j]))
            beta[j] = new
        if step <= tolerance:
            return beta
    raise RuntimeError(f"coordinate descent did not settle in {sweeps} sweeps (last step {step:.2e})")


def lasso_path(p: Prepared) -> np.ndarray:
    top = np.abs(p.xy).max(initial=0) / p.n
    return np.geomspace(top, top * LASSO_SHORTEST, LASSO_STEPS) if top > 0 else np.zeros(1)


def squared_error(residual: np.ndarray, g: np.ndarray) -> float:
    """Sum of squared residuals over the rows of a cell."""
    return float(max(residual @ g @ residual, 0.0))


def choose_lasso(cells: Cells, fold: int, p: Prepared) -> float:
    """The penalty with the least mean error over the inner folds of the rows outside ``fold``."""
    path, errors = lasso_path(p), []
    for inner in range(INNER):
        train, test = cells.total(lambda f, i, out=inner: f != fold and i != out), cells.total(lambda f, i, out=inner: f != fold and i == out)
        if not train[0, 0] or not test[0, 0]:
            continue
        q, beta, row = Prepared.of(train, p.to), None, []
        for penalty in path:
            beta = lasso(q, penalty, beta)
            row.append(squared_error(q.raw(beta), test) / test[0, 0])
        errors.append(row)
    return float(path[int(np.argmin(np.mean(errors, axis=0)))]) if errors else float(path[0])


def choose_ridge(df: DataFrame, cells: Cells, fits: dict[int, Prepared], penalties: np.ndarray = RIDGE_PENALTIES) -> dict[int, float]:
    """Each fold's penalty with the least leave-one-out error, from one pass over the rows for all folds and penalties.

    In the eigenvectors of the cross products a row's residual and leverage under every penalty are short sums.
    """
    models = {}
    for fold, p in fits.items():
        value, vector = np.linalg.eigh(p.xx)
        weight = 1 / (np.maximum(value, 0)[:, None] + penalties)  # (feature, penalty)
        models[fold] = (p.to @ vector, p.mean @ vector, weight, (vector.T @ p.xy)[:, None] * weight, p.n, p.y_mean)

    def run(batches):
        sums = {f: np.zeros(len(penalties)) for f in models}
        for batch in batches:
            own = batch.column(0).to_numpy()
            raw = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            for f, (to, mean, weight, beta, n, y_mean) in models.items():
                x = raw[own != f]
                z = x @ to - mean
                left = (x[:, -1:] - y_mean - z @ beta) / (1 - 1 / n - (z * z) @ weight)
                sums[f] += (left * left).sum(axis=0)
        for f, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), f)), pa.array(np.arange(len(s))), pa.array(s)], ["fold", "penalty", "sse"])

    rows = df.select(F.col("fold").cast("long").alias("fold"), *[c.alias(f"_x{i}") for i, c in enumerate(cells.columns())])
    found = rows.mapInArrow(run, "fold long, penalty long, sse double").groupBy("fold", "penalty").agg(F.sum("sse").alias("sse")).collect()
    errors = {f: np.full(len(penalties), np.inf) for f in fits}
    for r in found:
        errors[r["fold"]][r["penalty"]] = r["sse"]
    return {f: float(penalties[int(np.argmin(e))]) for f, e in errors.items()}


def linear_comparison(df: DataFrame, numeric: list[str], categorical: list[str], y: str, entity: str, *, folds: int = 5, seed: int = 42,
                      names: tuple[str, ...] = ("OLS", "ridge", "lasso")) -> DataFrame:
    """(fold, model, n, rmse, penalty): held-out error of each model in each fold; penalty is the chosen one, NULL for OLS.

    Numeric columns are filled with the training median, with an indicator, and scaled; the alphabetically first level of a categorical is
    the reference, a level not met in fitting counts as it. Ridge takes one of 25 penalties by leave-one-out error, lasso one of
    a path of 100 by inner folds. Rows without y or with a missing level are left out; folds without rows are absent.
    """
    d, cells = fold_cells(df, numeric, categorical, y, entity, folds, seed)
    held = {f: cells.total(lambda g, _, f=f: g == f) for f in range(folds)}
    fits = {f: prepared(cells, f) for f in range(folds) if held[f][0, 0]}
    ridges = choose_ridge(d, cells, fits) if "ridge" in names else {}
    rows = []
    for f, p in fits.items():
        for name in names:
            penalty = None if name == "OLS" else ridges[f] if name == "ridge" else choose_lasso(cells, f, p)
            beta = ols(p) if name == "OLS" else ridge(p, penalty) if name == "ridge" else lasso(p, penalty)
            n = int(held[f][0, 0])
            rows.append((f, name, n, float(np.sqrt(squared_error(p.raw(beta), held[f]) / n)), penalty))
    return df.sparkSession.createDataFrame(rows, "fold int, model string, n long, rmse double, penalty double")
