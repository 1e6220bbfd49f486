"""Rank tests, variance tests, correlation and multiple-comparison control.

All statistics come from counts per distinct value and distributed running sums, so no group is
ever sorted inside one task. Only the p-values (a handful of rows) go through Arrow.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import specfun
from ..functions.nulls import ratio
from . import ordering
from .lineage import cut


@F.pandas_udf(DoubleType())
def norm_p(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(z.isna(), np.nan, specfun.norm_two_sided(z.fillna(0)))).replace({np.nan: None}).astype(float)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(specfun.f_sf(f.to_numpy(), d1.to_numpy(), d2.to_numpy()))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(specfun.chi2_sf(x.to_numpy(), df.to_numpy()))


def rank_comparisons(df: DataFrame, label: str, value: str, labels: list[str]) -> DataFrame:
    """Mann-Whitney U and Cliff's delta for every pair of the listed groups.

    One ordering pass for all pairs: a value carries how many rows of each group it has, and the running sums of those. U of all
    pairs, and the sums that correct for ties, are products of these vectors, added up by task; no row is copied for a pair.
    Output: pair, a, b, n_a, n_b, u, cliffs_delta, z (tie-corrected, with continuity correction). A group without rows gives NULL.
    """
    k = len(labels)
    own = {f"g{i}": F.count_if(F.col(label) == name) for i, name in enumerate(labels)}
    counts = ordering.value_counts(df.filter(F.col(label).isin(*labels)), [], value, own)
    r = ordering.running(counts, [], ["_value"], list(own)).select(*own, *[f"{c}_below" for c in own])

    def products(batches):
        size, u, ties = np.zeros(k), np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(float)
            n, below = x[:, :k], x[:, k:]
            size += n.sum(axis=0)
            u += n.T @ (below + n / 2)
            # the sum of t^3 - t over t = n_a + n_b, multiplied out
            cube, square = (n**3 - n).sum(axis=0), (n**2).T @ n
            ties += cube[:, None] + cube[None, :] + 3 * (square + square.T)
        i, j = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i))), *(pa.array(c) for c in (size[i], size[j], u[i, j], ties[i, j]))], ["pair", "n_a", "n_b", "u", "_ties"])

    g = r.mapInArrow(products, "pair long, n_a double, n_b double, u double, _ties double").groupBy("pair").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("n_a", "n_b")], F.sum("u").alias("u"), F.sum("_ties").alias("_ties"))
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    prod = F.col("n_a").cast("double") * F.col("n_b")
    sd = F.sqrt(prod / 12 * (n + 1 - ratio("_ties", n * (n - 1))))
    z = ratio(F.greatest(F.abs(F.col("u") - prod / 2) - 0.5, F.lit(0.0)), sd)
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(labels, 2)])
    return g.withColumn("_p", F.get(names, F.col("pair").cast("int"))).select(
        F.col("pair").cast("int").alias("pair"), "_p.a", "_p.b", "n_a", "n_b", "u", (ratio(F.col("u") * 2, prod) - 1).alias("cliffs_delta"), z.alias("z"))


def mann_whitney(df: DataFrame, label: str, value: str, labels: list[str]) -> DataFrame:
    return rank_comparisons(df, label, value, labels).withColumn("p", norm_p("z"))


def holm(tests: DataFrame, p: str, tie: str, name: str = "p_holm") -> DataFrame:
    """Holm step-down adjustment over a table of tests (one row per comparison the caller listed)."""
    m = tests.agg(F.count(p)).scalar()
    order = W.orderBy(p, tie)
    step = tests.filter(F.col(p).isNotNull()).withColumn("_m", m).withColumn("_i", F.row_number().over(order))
    scaled = step.withColumn("_s", F.col(p) * (F.col("_m") - F.col("_i") + 1))
    return scaled.withColumn(name, F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))).drop("_m", "_i", "_s")


def _moments(df: DataFrame, label: str, value: str) -> DataFrame:
    return (df.filter(F.col(label).isNotNull() & F.col(value).isNotNull()).groupBy(label)
            .agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")))


def levene(df: DataFrame, label: str, value: str) -> DataFrame:
    """Brown-Forsythe test: one-way ANOVA on absolute deviations from the group median."""
    med = cut(ordering.medians(df, [label], value, "_med")).withColumnRenamed(label, "_l")
    dev = df.join(med, F.col(label) == F.col("_l")).select(label, F.abs(F.col(value) - F.col("_med")).alias("d"))
    g = _moments(dev, label, "d")
    t = g.agg(F.sum("n").alias("N"), F.count("*").cast("double").alias("k"), ratio(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("gm"),
              F.sum((F.col("n") - 1) * F.col("v")).alias("sw"), F.sum(F.col("n") * F.col("m")).alias("s1"),
              F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("N")
    return t.select(F.lit("levene").alias("test"), ratio((F.col("N") - F.col("k")) * between, (F.col("k") - 1) * F.col("sw")).alias("statistic"),
                    (F.col("k") - 1).alias("df1"), (F.col("N") - F.col("k")).alias("df2"))


def welch_anova(df: DataFrame, label: str, value: str) -> DataFrame:
    g = _moments(df, label, value).withColumn("w", ratio("n", "v"))
    t = g.agg(F.struct(F.sum("w").alias("W"), ratio(F.sum(F.col("w") * F.col("m")), F.sum("w")).alias("mw"))).scalar()
    h = g.withColumn("_t", t)
    s = h.agg(F.count("*").cast("double").alias("k"), F.sum(F.col("w") * F.pow(F.col("m") - F.col("_t.mw"), 2)).alias("a"),
              F.sum(F.pow(1 - F.col("w") / F.col("_t.W"), 2) / (F.col("n") - 1)).alias("l"))
    k = F.col("k")
    stat = (F.col("a") / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("l"))
    return s.select(F.lit("welch").alias("test"), stat.alias("statistic"), (k - 1).alias("df1"), ((k * k - 1) / (3 * F.col("l"))).alias("df2"))


def kruskal(df: DataFrame, label: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, from counts per (group, value) and ranks per value."""
    d = df.filter(F.col(label).isNotNull())
    per = ordering.value_counts(d, [label], value).withColumnRenamed("n", "n_label")
    ranks = ordering.ranked_values(d, [], value).select(F.col("_value").alias("_rv"), (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"), "n")
    ties = ranks.agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("t")).scalar()
    g = per.join(ranks, F.col("_value") == F.col("_rv")).groupBy(label).agg(
        F.sum("n_label").cast("double").alias("n"), F.sum(F.col("n_label") * F.col("rank")).alias("r"))
    s = g.agg(F.sum("n").alias("N"), F.count("*").cast("double").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).withColumn("_t", ties)
    N = F.col("N")
    h = (12 / (N * (N + 1)) * F.col("q") - 3 * (N + 1)) / (1 - F.col("_t") / (N * N * N - N))
    return s.select(F.lit("kruskal").alias("test"), h.alias("statistic"), (F.col("k") - 1).alias("df1"), F.lit(None).cast("double").alias("df2"))


def variance_tests(df: DataFrame, label: str, value: str) -> DataFrame:
    """Levene, Welch ANOVA and Kruskal-Wallis statistics with their degrees of freedom."""
    return levene(df, label, value).unionByName(welch_anova(df, label, value)).unionByName(kruskal(df, label, value))


def with_p(tests: DataFrame) -> DataFrame:
    p = F.when(F.col("df2").isNull(), chi2_p("statistic", "df1")).otherwise(f_p("statistic", "df1", F.coalesce("df2", F.lit(1.0))))
    return tests.withColumn("p", p)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation: Pearson correlation of average ranks over rows with both values.

    The counts are written once: sums of doubles computed again may differ in their last digits, and would miss their own ranks.
    """
    d = cut(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.count("*").alias("n")))

    def ranks(c):
        per = d.groupBy(c).agg(F.sum("n").alias("n"))
        r = ordering.running(per, [], [c], ["n"])
        return r.select(F.col(c).alias(f"_{c}"), (F.col("n_below") + (F.col("n") + 1) / 2).alias(f"r{c}"))
    j = d.join(ranks("x"), F.col("x") == F.col("_x")).join(ranks("y"), F.col("y") == F.col("_y"))
    w = F.col("n").cast("double")
    s = j.agg(F.sum(w).alias("n"), *[F.sum(w * e).alias(k) for k, e in {
        "sx": F.col("rx"), "sy": F.col("ry"), "sxx": F.col("rx") ** 2, "syy": F.col("ry") ** 2, "sxy": F.col("rx") * F.col("ry")}.items()])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    return s.select(n.cast("long").alias("n"), ratio(cov, F.sqrt((F.col("sxx") - F.col("sx") ** 2 / n) * (F.col("syy") - F.col("sy") ** 2 / n))).alias("rho"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))

    def pairs(d: DataFrame) -> DataFrame:
        return d.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2))
    sa = pairs(cells.groupBy(a).agg(F.sum("n").alias("n"))).scalar()
    sb = pairs(cells.groupBy(b).agg(F.sum("n").alias("n"))).scalar()
    s = cells.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("both"), F.sum("n").alias("N")).withColumns({"sa": sa, "sb": sb})
    total = F.col("N") * (F.col("N") - 1) / 2
    expected = F.col("sa") * F.col("sb") / total
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(top == expected, 1.0).otherwise(F.try_divide(F.col("both") - expected, top - expected))
    return s.select(F.col("N").cast("long").alias("n"), ari.alias("ari"))


def adjusted_rand_of_cells(cells: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, n, ari) from the contingency counts (group, a, b, n) of many pairs of labelings."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    side = lambda c, name: cells.groupBy(group, c).agg(F.sum("n").cast("double").alias("n")).groupBy(group).agg(two("n").alias(name))
    s = cells.groupBy(group).agg(two("n").alias("both"), F.sum("n").cast("double").alias("N")).join(side(a, "sa"), group).join(side(b, "sb"), group)
    total = F.col("N") * (F.col("N") - 1) / 2
    expected, top = F.try_divide(F.col("sa") * F.col("sb"), total), (F.col("sa") + F.col("sb")) / 2
    ari = F.when(top == expected, 1.0).otherwise(F.try_divide(F.col("both") - expected, top - expected))
    return s.select(group, F.col("N").cast("long").alias("n"), ari.alias("ari"))


def funnel_limits(df: DataFrame, k: str, n: str, z: float) -> DataFrame:
    """Pooled rate, its z limits per cohort size, and whether the rate falls outside."""
    pooled = df.agg(ratio(F.sum(k), F.sum(n))).scalar()
    d = df.withColumn("pooled", pooled)
    half = F.sqrt(F.col("pooled") * (1 - F.col("pooled")) / F.col(n)) * z
    return d.withColumns({"low": F.col("pooled") - half, "high": F.col("pooled") + half}).withColumn(
        "outside", (ratio(k, n) < F.col("low")) | (ratio(k, n) > F.col("high")))


def composite(df: DataFrame, zs: list[str], minimum: int) -> tuple[Column, Column]:
    """Mean of the available z-scores, NULL below the coverage minimum; and the coverage itself."""
    from ..functions.nulls import n_present, row_sum
    n = n_present(zs)
    return F.when(n >= minimum, row_sum(zs) / n), n
