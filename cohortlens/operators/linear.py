"""Least squares with robust and clustered errors, count regression, PCA and their diagnostics.

Executors reduce any number of rows to p x p cross-products in one aggregate; the driver (or one
Arrow row per group) only solves a p x p system. Row-level diagnostics are a second aggregate with
the coefficients as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import specfun
from .lineage import cut
from .resample import bootstrap_rows


def _dot(cols: list[str], beta) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * float(v) for c, v in zip(cols, beta)])


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def gram_aggs(cols: list[str], weight: Column | None = None) -> list[Column]:
    """Aggregates of the upper triangle of X'WX as one array column."""
    def term(i, j):
        e = F.col(cols[i]) * F.col(cols[j])
        return F.sum(e if weight is None else e * weight)
    return [term(i, j) for i, j in _pairs(len(cols))]


def symmetric(values, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    for v, (i, j) in zip(values, _pairs(p)):
        m[i, j] = m[j, i] = v
    return m


def cross_products(df: DataFrame, cols: list[str], weight: Column | None = None) -> np.ndarray:
    row = df.agg(*[e.alias(f"g{i}") for i, e in enumerate(gram_aggs(cols, weight))]).collect()[0]
    return symmetric([v if v is not None else 0.0 for v in row], len(cols))


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sample covariance and means; columns are centred first so that large offsets do no harm."""
    mean = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    mu = np.array([mean[f"m{i}"] for i in range(len(cols))])
    centred = df.select(*[(F.col(c) - float(m)).alias(c) for c, m in zip(cols, mu)])
    return cross_products(centred, cols) / (mean["n"] - 1), mu, mean["n"]


@dataclass
class OlsFit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    r2: float
    scored: DataFrame

    def table(self, spark: SparkSession) -> DataFrame:
        se = np.sqrt(np.diag(self.cov))
        z = self.beta / se
        rows = [(n, float(b), float(s), float(t), float(p), float(b - 1.959963984540054 * s), float(b + 1.959963984540054 * s))
                for n, b, s, t, p in zip(self.names, self.beta, se, z, specfun.norm_two_sided(z))]
        return spark.createDataFrame(rows, "term string, coef double, std_err double, z double, p double, low double, high double")


def ols(df: DataFrame, y: str, xs: list[str]) -> OlsFit:
    """Ordinary least squares with an intercept and HC3 covariance.

    Pass 1: means, pass 2: cross-products of centred columns, pass 3: residuals, leverage and the
    sandwich in one aggregate. Rows with a missing value are left out.
    """
    d = df.dropna(subset=[y, *xs]).withColumns({c: F.col(c).cast("double") for c in [y, *xs]})
    means = d.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in [*xs, y]]).collect()[0]
    n, cx = means["n"], [f"_c{i}" for i in range(len(xs))]
    cent = d.withColumns({**{c: F.col(x) - float(means[x]) for c, x in zip(cx, xs)}, "_cy": F.col(y) - float(means[y]), "_one": F.lit(1.0)})
    g = cross_products(cent, ["_one", *cx, "_cy"])
    p = len(xs) + 1
    xtx_inv = np.linalg.inv(g[:p, :p])
    b = xtx_inv @ g[:p, p]
    design = ["_one", *cx]
    fitted = _dot(design, b)
    lev = reduce(lambda a, e: a + e, [F.col(design[i]) * F.col(design[j]) * float(xtx_inv[i, j] * (1 if i == j else 2)) for i, j in _pairs(p)])
    scored = cent.withColumns({"fitted": fitted + float(means[y]), "residual": F.col("_cy") - fitted, "leverage": lev})
    meat_w = F.pow(F.col("residual") / (1 - F.col("leverage")), 2)
    sums = scored.agg(F.sum(F.col("residual") ** 2).alias("sse"), *[e.alias(f"m{i}") for i, e in enumerate(gram_aggs(design, meat_w))]).collect()[0]
    cov = xtx_inv @ symmetric([sums[f"m{i}"] for i in range(len(_pairs(p)))], p) @ xtx_inv
    mu = np.array([float(means[x]) for x in xs])
    back = np.eye(p)
    back[0, 1:] = -mu
    beta = back @ b
    beta[0] += float(means[y])
    return OlsFit(["intercept", *xs], beta, back @ cov @ back.T, n, 1 - sums["sse"] / g[p, p], scored.drop("_one", "_cy", *cx))


def vif(df: DataFrame, xs: list[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    cov, _, _ = covariance(df.dropna(subset=xs), xs)
    sd = np.sqrt(np.diag(cov))
    inv = np.linalg.inv(cov / np.outer(sd, sd))
    return df.sparkSession.createDataFrame([(x, float(v)) for x, v in zip(xs, np.diag(inv))], "term string, vif double")


def residual_shape(scored: DataFrame, residual: str = "residual") -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.skewness(residual).alias("skewness"), F.kurtosis(residual).alias("excess_kurtosis"))


# --- count regression ------------------------------------------------------------------------

@F.pandas_udf(DoubleType())
def lgamma_col(x: pd.Series) -> pd.Series:
    return pd.Series(specfun.lgamma(x.to_numpy()))


def count_rows(df: DataFrame, y: str, x: str) -> DataFrame:
    """Distinct (count, log regressor) pairs with multiplicity: what every iteration reads."""
    d = df.filter(F.col(y).isNotNull() & (F.col(x) > 0))
    return d.groupBy(F.col(y).cast("double").alias("y"), F.log(F.col(x).cast("double")).alias("x")).agg(F.count("*").cast("double").alias("w"))


def _irls_step(d: DataFrame, b: np.ndarray, alpha: float) -> np.ndarray:
    eta = F.col("x") * float(b[1]) + float(b[0])
    mu = F.exp(eta)
    w = mu / (1 + mu * float(alpha)) * F.col("w")
    work = d.withColumns({"_1": F.lit(1.0), "_z": eta + (F.col("y") - mu) / mu, "_w": w})
    g = cross_products(work, ["_1", "x", "_z"], F.col("_w"))
    return np.linalg.solve(g[:2, :2], g[:2, 2])


def _log_start(d: DataFrame) -> np.ndarray:
    r = d.agg(F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum("w").alias("n")).collect()[0]
    return np.array([math.log(r["sy"] / r["n"]), 0.0])


def fit_poisson(d: DataFrame, max_iter: int = 30) -> dict:
    """Poisson regression on log(x): coefficients, AIC and Pearson dispersion."""
    b = _log_start(d)
    for _ in range(max_iter):
        new = _irls_step(d, b, 0.0)
        done = np.abs(new - b).max() < 1e-10
        b = new
        if done:
            break
    else:
        raise RuntimeError("Poisson regression did not converge")
    eta = F.col("x") * float(b[1]) + float(b[0])
    mu = F.exp(eta)
    s = d.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.pow(F.col("y") - mu, 2) / mu).alias("chi2"),
              F.sum(F.col("w") * (F.col("y") * eta - mu)).alias("core")).collect()[0]
    const = d.groupBy("y").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * lgamma_col(F.col("y") + 1))).collect()[0][0]
    return {"intercept": b[0], "slope": b[1], "alpha": None, "aic": -2 * (s["core"] - const) + 4, "dispersion": s["chi2"] / (s["n"] - 2), "n": int(s["n"])}


def fit_negative_binomial(d: DataFrame, rounds: int = 12) -> dict:
    """NB2 regression: IRLS for the mean, and a batched grid search for alpha.

    One job evaluates the likelihood on a whole grid of alphas; the gamma terms depend on the count
    alone, so they are taken over distinct counts.
    """
    b, alpha = _log_start(d), 1.0
    counts = d.groupBy("y").agg(F.sum("w").alias("w"))
    lo, hi, best = math.log(1e-4), math.log(1e2), -math.inf
    for r in range(rounds):
        for _ in range(2):
            b = _irls_step(d, b, alpha)
        grid = np.exp(np.linspace(lo, hi, 15))
        eta = F.col("x") * float(b[1]) + float(b[0])
        mu = F.exp(eta)
        mean_part = d.agg(*[F.sum(F.col("w") * (F.col("y") * (eta + math.log(a)) - (F.col("y") + 1 / float(a)) * F.log1p(mu * float(a)))).alias(f"a{i}")
                            for i, a in enumerate(grid)]).collect()[0]
        gamma_part = counts.agg(*[F.sum(F.col("w") * (lgamma_col(F.col("y") + 1 / float(a)) - math.lgamma(1 / a) - lgamma_col(F.col("y") + 1))).alias(f"a{i}")
                                  for i, a in enumerate(grid)]).collect()[0]
        ll = [m + g for m, g in zip(mean_part, gamma_part)]
        top = int(np.argmax(ll))
        converged = abs(ll[top] - best) < 1e-9 * abs(ll[top])
        best, alpha = ll[top], float(grid[top])
        step = (hi - lo) / 14
        lo, hi = math.log(alpha) - step, math.log(alpha) + step
        if converged and hi - lo < 1e-3:
            break
    else:
        raise RuntimeError("negative binomial regression did not converge")
    return {"intercept": float(b[0]), "slope": float(b[1]), "alpha": alpha, "aic": -2 * best + 6, "dispersion": None,
            "n": int(d.agg(F.sum("w")).collect()[0][0])}


def count_models(df: DataFrame, y: str, x: str) -> DataFrame:
    """Poisson and NB2 fits of a count on log size, side by side."""
    d = cut(count_rows(df, y, x))
    rows = [("poisson", fit_poisson(d)), ("negative binomial", fit_negative_binomial(d))]
    data = [(m, r["n"], float(r["intercept"]), float(r["slope"]), r["alpha"], float(r["aic"]), r["dispersion"]) for m, r in rows]
    return df.sparkSession.createDataFrame(data, "model string, n long, intercept double, elasticity double, alpha double, aic double, dispersion double")


# --- event study -----------------------------------------------------------------------------

def event_study(df: DataFrame, group: str, entity: str, time: str, value: str, periods: list[int] | None, reference: int) -> DataFrame:
    """Two-way fixed effects per group: within-entity regression on period dummies.

    Without ``periods`` every period of the data but the reference has a dummy; a period of the data that a given list lacks
    is an error, since its rows would join the reference.

    Standard errors are clustered by entity with the usual small-sample factor. Everything stays
    grouped: entity means by aggregate and join, cross-products per group, one small solve per group
    row in Arrow, scores summed per (group, entity).
    """
    found = sorted(r[0] for r in df.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).select(time).distinct().collect())
    if reference not in found:
        raise ValueError(f"no rows in the reference period {reference}")
    if periods is not None and set(found) - set(periods):
        raise ValueError(f"periods without a dummy: {sorted(set(found) - set(periods))}")
    others = [p for p in (found if periods is None else periods) if p != reference]
    names = [f"_d{p}" for p in others]
    d = df.filter(F.col(value).isNotNull()).select(group, entity, F.col(value).cast("double").alias("_y"),
                                                   *[(F.col(time) == p).cast("double").alias(n) for p, n in zip(others, names)])
    cols = [*names, "_y"]
    means = d.groupBy(F.col(group).alias("_g"), F.col(entity).alias("_e")).agg(*[F.avg(c).alias(f"m{c}") for c in cols])
    w = d.join(means, (F.col(group) == F.col("_g")) & (F.col(entity) == F.col("_e"))).select(
        group, entity, *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in cols])
    p = len(names)
    gtype = df.schema[group].dataType.simpleString()
    gram = w.groupBy(group).agg(F.array(*gram_aggs(cols)).alias("gram"))

    def solve(batches):
        for pdf in batches:
            out = []
            for g, values in zip(pdf[group], pdf["gram"]):
                m = symmetric(values, p + 1)
                inv = np.linalg.pinv(m[:p, :p])
                out.append((g, (inv @ m[:p, p]).tolist(), inv.ravel().tolist()))
            yield pd.DataFrame(out, columns=["_g", "beta", "inv"])
    coef = cut(gram.mapInPandas(solve, f"_g {gtype}, beta array<double>, inv array<double>"))
    r = w.join(coef, F.col(group) == F.col("_g"))
    fit = reduce(lambda a, e: a + e, [F.col(n) * F.get("beta", F.lit(i)) for i, n in enumerate(names)])
    resid = r.withColumn("_u", F.col("_y") - fit)
    score = resid.groupBy(group, entity).agg(F.count("*").alias("_n"), *[F.sum(F.col(n) * F.col("_u")).alias(n) for n in names])
    meat = score.groupBy(group).agg(F.sum("_n").cast("double").alias("n"), F.count("*").cast("double").alias("entities"),
                                    F.array(*gram_aggs(names)).alias("meat"))

    def finish(batches):
        for pdf in batches:
            out = []
            for g, beta, inv, n, m, meat_values in zip(pdf[group], pdf["beta"], pdf["inv"], pdf["n"], pdf["entities"], pdf["meat"]):
                inv = np.array(inv).reshape(p, p)
                factor = m / (m - 1) * (n - 1) / (n - p) if m > 1 and n > p else np.nan
                se = np.sqrt(np.maximum(np.diag(factor * inv @ symmetric(meat_values, p) @ inv), 0))
                for t, b, s in zip(others, beta, se):
                    out.append((g, t, b, s, b - 1.959963984540054 * s, b + 1.959963984540054 * s, int(m)))
                out.append((g, reference, 0.0, 0.0, 0.0, 0.0, int(m)))
            yield pd.DataFrame(out, columns=[group, "period", "estimate", "std_err", "low", "high", "entities"])
    return meat.join(coef, F.col(group) == F.col("_g")).select(group, "beta", "inv", "n", "entities", "meat").mapInPandas(
        finish, f"{group} {gtype}, period int, estimate double, std_err double, low double, high double, entities long")


# --- principal components --------------------------------------------------------------------

def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Subtract the mean and divide by the population sd (constant columns keep sd 1)."""
    s = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])).scalar()
    return df.withColumn("_s", s).withColumns({
        c: (F.col(c) - F.col(f"_s.m_{c}")) / F.when(F.col(f"_s.s_{c}") > 0, F.col(f"_s.s_{c}")).otherwise(1.0) for c in cols}).drop("_s")


def oriented(vectors: np.ndarray) -> np.ndarray:
    """Each row with the sign that makes its strongest loading positive: flipped where the lowest lies farther from 0 than the highest."""
    return np.where((-vectors.min(axis=1) > vectors.max(axis=1))[:, None], -vectors, vectors)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    return vals[order], oriented(vecs.T[order])


@dataclass
class PcaFit:
    cols: list[str]
    eigenvalues: np.ndarray
    components: np.ndarray
    n: int

    def loadings(self, spark: SparkSession, k: int) -> DataFrame:
        rows = [(c, *[float(self.components[i, j]) for i in range(k)]) for j, c in enumerate(self.cols)]
        return spark.createDataFrame(rows, "feature string, " + ", ".join(f"pc{i + 1} double" for i in range(k)))

    def scree(self, spark: SparkSession) -> DataFrame:
        share = self.eigenvalues / self.eigenvalues.sum()
        rows = [(i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(self.eigenvalues, share, share.cumsum()))]
        return spark.createDataFrame(rows, "component int, eigenvalue double, share double, cumulative double")

    def scores(self, z: DataFrame, k: int) -> DataFrame:
        return z.withColumns({f"pc{i + 1}": _dot(self.cols, self.components[i]) for i in range(k)})


def pca(z: DataFrame, cols: list[str]) -> PcaFit:
    """Principal components of standardised columns, from one covariance aggregate."""
    cov, _, n = covariance(z, cols)
    vals, comps = eigen(cov)
    return PcaFit(list(cols), vals, comps, n)


def noise_eigenvalues(spark: SparkSession, n: int, p: int, reps: int, seed: int = 0) -> DataFrame:
    """Eigenvalues of the covariance of n x p standard-normal noise: (rep, component, eigenvalue).

    The covariance of n noise rows is drawn directly from its Wishart law (Bartlett decomposition),
    so a replicate costs p x p work whatever n is. Each replicate has its own seed.
    """
    def draw(batches):
        for pdf in batches:
            out = []
            for rep in pdf["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                a = np.tril(rng.standard_normal((p, p)), -1)
                a[np.diag_indices(p)] = np.sqrt(rng.chisquare(n - 1 - np.arange(p)))
                vals = np.linalg.eigvalsh(a @ a.T / (n - 1))[::-1]
                out += [(int(rep), i + 1, float(v)) for i, v in enumerate(vals)]
            yield pd.DataFrame(out, columns=["rep", "component", "eigenvalue"])
    return spark.range(reps).mapInPandas(draw, "rep long, component int, eigenvalue double")


def parallel_analysis(z: DataFrame, cols: list[str], reps: int = 200, seed: int = 0) -> DataFrame:
    """Observed eigenvalues beside the 95th percentile of noise, and which components to retain."""
    from . import ordering
    fit = pca(z, cols)
    noise = ordering.quantiles(noise_eigenvalues(z.sparkSession, fit.n, len(cols), reps, seed), ["component"], "eigenvalue", {"noise_p95": 0.95})
    j = fit.scree(z.sparkSession).join(noise, "component")
    first_fail = j.agg(F.min(F.when(F.col("eigenvalue") < F.col("noise_p95"), F.col("component")))).scalar()
    return j.withColumn("retained", F.col("component") < F.coalesce(first_fail, F.lit(len(cols) + 1)))


def loading_stability(z: DataFrame, entity: str, cols: list[str], k: int = 3, reps: int = 300, seed: int = 0) -> DataFrame:
    """Bootstrap loadings per replicate, sign-aligned: (rep, component, congruence, loadings).

    Rows are resampled on the executors; a replicate is reduced to its cross-products before Python
    sees it (one row per replicate).
    """
    fit = pca(z, cols)
    ref = fit.components[:k]
    rows = bootstrap_rows(z.select(F.lit(0).alias("_grp"), entity, *cols), "_grp", entity, cols, reps, seed)
    sums = rows.withColumn("_1", F.lit(1.0)).groupBy("rep").agg(F.array(*gram_aggs(["_1", *cols])).alias("g"))
    p = len(cols)

    def decompose(batches):
        for pdf in batches:
            out = []
            for rep, values in zip(pdf["rep"], pdf["g"]):
                m = symmetric(values, p + 1)
                n, s = m[0, 0], m[0, 1:]
                cov = (m[1:, 1:] - np.outer(s, s) / n) / (n - 1)
                _, comps = eigen(cov)
                for i in range(k):
                    c = comps[i] * (np.sign(comps[i] @ ref[i]) or 1)
                    out.append((int(rep), i + 1, float(abs(c @ ref[i])), c.tolist()))
            yield pd.DataFrame(out, columns=["rep", "component", "congruence", "loadings"])
    return cut(sums).mapInPandas(decompose, "rep int, component int, congruence double, loadings array<double>")


def loading_summary(stability: DataFrame, cols: list[str]) -> DataFrame:
    """Sd of every loading and the median and 5th percentile of the congruence, per component."""
    from . import ordering
    stability = cut(stability)
    sd = stability.groupBy("component").agg(*[F.stddev_pop(F.get("loadings", F.lit(i))).alias(f"sd_{c}") for i, c in enumerate(cols)])
    q = ordering.quantiles(stability, ["component"], "congruence", {"congruence_median": 0.5, "congruence_p5": 0.05})
    return sd.join(q, "component")
