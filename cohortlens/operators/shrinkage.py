"""Empirical-Bayes shrinkage of rates under a beta-binomial model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import specfun
from ..functions.nulls import ratio_pos


def usable(df: DataFrame, k: str, n: str) -> DataFrame:
    return df.filter((F.col(n) > 0) & (F.col(k) >= 0) & (F.col(k) <= F.col(n)))


def sufficient_counts(df: DataFrame, group: str, k: str, n: str) -> DataFrame:
    """How often each success count, failure count and cohort size occurs, per group.

    These histograms are sufficient for the likelihood and no longer than the largest cohort, however
    many entities there are.
    """
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), e.cast("long").alias("x")) for name, e in
                      (("k", F.col(k)), ("f", F.col(n) - F.col(k)), ("n", F.col(n)))])
    return usable(df, k, n).select(group, F.inline(kinds)).groupBy(group, "kind", "x").agg(F.count("*").alias("w"))


def _solve(h: pd.DataFrame) -> tuple[float, float, int]:
    """Maximise the beta-binomial likelihood over log a, log b by damped Newton steps; an error if they do not settle."""
    part = {kind: (g["x"].to_numpy(float), g["w"].to_numpy(float)) for kind, g in h.groupby("kind")}
    (k, wk), (f, wf), (n, wn) = part["k"], part["f"], part["n"]
    m = wn.sum()

    def loglik(a, b):
        return ((wk * (specfun.lgamma(k + a) - specfun.lgamma(a))).sum() + (wf * (specfun.lgamma(f + b) - specfun.lgamma(b))).sum()
                - (wn * (specfun.lgamma(n + a + b) - specfun.lgamma(a + b))).sum())
    p = (wk * k).sum() / (wn * n).sum()
    a, b = max(10 * p, 0.5), max(10 * (1 - p), 0.5)
    best = loglik(a, b)
    for _ in range(200):
        dg, tg = specfun.digamma, specfun.trigamma
        sn, tn = (wn * (dg(n + a + b) - dg(a + b))).sum(), (wn * (tg(n + a + b) - tg(a + b))).sum()
        g = np.array([(wk * (dg(k + a) - dg(a))).sum() - sn, (wf * (dg(f + b) - dg(b))).sum() - sn])
        haa = (wk * (tg(k + a) - tg(a))).sum() - tn
        hbb = (wf * (tg(f + b) - tg(b))).sum() - tn
        grad = g * [a, b]
        hess = np.array([[haa * a * a + grad[0], -tn * a * b], [-tn * a * b, hbb * b * b + grad[1]]])
        vals, vecs = np.linalg.eigh(hess)
        step = vecs @ ((vecs.T @ grad) / np.maximum(np.abs(vals), 1e-8))
        step = np.clip(step, -2, 2)
        scale = 1.0
        while scale > 1e-8:
            na, nb = a * np.exp(scale * step[0]), b * np.exp(scale * step[1])
            new = loglik(na, nb)
            if new >= best:
                break
            scale /= 2
        moved = np.abs(scale * step).max()
        if scale > 1e-8:
            a, b, best = na, nb, new
        stalled = scale <= 1e-8 and np.abs(grad).max() < 1e-4 * m  # no ascent left at this precision
        if moved < 1e-10 or np.abs(grad).max() < 1e-9 * m or stalled or a + b > 1e8:  # beyond that the prior is a point
            return float(a), float(b), int(m)
    raise RuntimeError(f"beta-binomial fit did not converge for {int(m)} entities")


def fit_priors(df: DataFrame, group: str, k: str, n: str) -> DataFrame:
    """Maximum-likelihood Beta(a, b) per group; a and b are null for groups with fewer than three entities."""
    every = sufficient_counts(df, group, k, n)
    sizes = every.filter("kind = 'n'").groupBy(F.col(group).alias("_g")).agg(F.sum("w").alias("_m"))
    counts = every.join(sizes.filter("_m >= 3"), F.col(group).eqNullSafe(F.col("_g"))).select(every.columns)
    gtype = counts.schema[group].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, m = _solve(pdf)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "a": [a], "b": [b], "n_entities": [m]})
    fitted = counts.groupBy(group).applyInPandas(fit, f"{group} {gtype}, a double, b double, n_entities long")
    none = F.lit(None).cast("double")
    fitted = fitted.unionByName(sizes.filter("_m < 3").select(F.col("_g").alias(group), none.alias("a"), none.alias("b"), F.col("_m").alias("n_entities")))
    s = F.col("a") + F.col("b")
    return fitted.withColumns({"prior_mean": F.col("a") / s, "prior_strength": s,
                               "prior_sd": F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1)))})


@F.pandas_udf(DoubleType())
def beta_quantile(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(p), np.nan)
    out[known] = specfun.beta_ppf(p.to_numpy()[known], a.to_numpy()[known], b.to_numpy()[known])
    return pd.Series(out).astype(object).where(known, None)


def posterior(df: DataFrame, k: str, n: str, a: str = "a", b: str = "b") -> DataFrame:
    """Raw rate, posterior mean and the weight of the entity's own data."""
    s = F.col(a) + F.col(b)
    return df.withColumns({"raw_rate": ratio_pos(k, n), "post_mean": (F.col(a) + F.col(k)) / (s + F.col(n)), "weight": F.col(n) / (F.col(n) + s)})


def interval(df: DataFrame, k: str, n: str, level: float = 0.9, a: str = "a", b: str = "b") -> DataFrame:
    """Equal-tailed posterior interval (beta quantiles, Arrow batches)."""
    tail = (1 - level) / 2
    pa, pb = F.col(a) + F.col(k), F.col(b) + F.col(n) - F.col(k)
    return df.withColumns({"post_lo": beta_quantile(F.lit(tail), pa, pb), "post_hi": beta_quantile(F.lit(1 - tail), pa, pb)})


def shrink(df: DataFrame, priors: DataFrame, group: str, k: str, n: str, level: float = 0.9) -> DataFrame:
    j = usable(df, k, n).join(priors.select(group, "a", "b"), group, "left")
    return interval(posterior(j, k, n), k, n, level)
