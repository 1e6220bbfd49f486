"""Descriptive summaries: totals, distributions, coverage, trends and error tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import false_if_null, ratio
from . import ordering
from .lineage import cut


def stored_totals(df: DataFrame, level: str, total_code: str, value: str, also: Column | None = None) -> DataFrame:
    """Three sums of a file that stores totals beside details: total rows, detail rows, and the naive sum."""
    is_total = F.col(level).cast("string") == total_code
    if also is not None:
        is_total = is_total & also
    v = F.coalesce(F.col(value), F.lit(0))
    return df.agg(F.sum(F.when(is_total, v)).alias("grand_total"), F.sum(v).alias("naive_sum"),
                  F.sum(F.when(F.col(level).cast("string") != total_code, v)).alias("detail_sum"))


def entity_totals(df: DataFrame, entity: str, level: str, total_code: str, value: str) -> DataFrame:
    return df.filter(F.col(level).cast("string") == total_code).groupBy(entity).agg(F.sum(value).alias("total"))


def pivot_sum(df: DataFrame, keys: list[str], code: str, value: str, codes: list, prefix: str = "c") -> DataFrame:
    """Pivot with an explicit code list, as conditional sums (one pass, no distinct job)."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(code) == c, F.col(value))).alias(f"{prefix}{c}") for c in codes])


def crosstab_top(df: DataFrame, rows: str, columns: str, values: list, top: int) -> DataFrame:
    """Counts of the most frequent row classes by column value; ties by class name."""
    per = df.groupBy(rows).agg(F.count("*").alias("n_total"), *[F.count_if(F.col(columns) == v).alias(str(v)) for v in values])
    return per.filter(F.col(rows).isNotNull()).orderBy(F.desc("n_total"), rows).limit(top)


def describe(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """count, mean, sample sd and quartiles per group (rows with a missing group are left out)."""
    d = reduce(lambda a, g: a.filter(F.col(g).isNotNull()), groups, df)
    basic = d.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return basic.join(ordering.quantiles(d, groups, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), groups, "left")


def cluster_profile(df: DataFrame, cluster: str, features: list[str], public: Column, size: str, name: str) -> DataFrame:
    """Per cluster: rows, share public, medians of the features and the largest member."""
    basic = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(public.cast("double")).alias("share_public"),
                                    F.max_by(name, F.struct(F.col(size), F.col(name))).alias("largest_member"))
    med = ordering.multi_quantiles(df, [cluster], features, {"q": 0.5})
    wide = med.groupBy(cluster).agg(*[F.max(F.when(F.col("metric") == f, F.col("q"))).alias(f"median_{f}") for f in features])
    return basic.join(wide, cluster, "left")


def weighted_vs_simple(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Institution-weighted and student-weighted means, and their gap."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.avg(value).alias("simple_mean"),
                              ratio(F.sum(F.col(value) * F.col(weight)), F.sum(w)).alias("weighted_mean"))
    return g.withColumn("gap", F.col("weighted_mean") - F.col("simple_mean"))


def missing_share(df: DataFrame, groups: list[str], cols: list[str]) -> DataFrame:
    """Share missing of every column per group, one pass, long: (groups, column, n_missing, share)."""
    one = df.groupBy(*groups).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([*groups, "_n"], cols, "column", "n_missing").select(
        *groups, "column", "n_missing", ratio("n_missing", "_n").alias("share_missing"))


def flag_summary(df: DataFrame, flags: list[str]) -> DataFrame:
    """Counts and shares of every imputation flag code per column; a missing flag is its own code.

    Counting per (column, code) happens before the shuffle; the share is taken over the small result.
    """
    long = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias(c) for c in flags])
    n = long.unpivot([], flags, "column", "code").groupBy("column", "code").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return n.withColumn("share", ratio("n", total))


def definition_ratio(df: DataFrame, group: str, num: str, den: str) -> DataFrame:
    """Per group: rows with the ratio, its median and the share below 1."""
    d = df.withColumn("_r", ratio(num, den)).filter(F.col("_r").isNotNull() & F.col(group).isNotNull())
    basic = d.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col("_r") < 1).cast("double")).alias("share_below_1"))
    return basic.join(ordering.medians(d, [group], "_r", "median_ratio"), group)


def complete_totals(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Totals per period over entities that report every period."""
    from .panel import balanced
    return balanced(df, entity, time, value).groupBy(time).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def robust_location(df: DataFrame, value: str, trim: float = 0.99) -> DataFrame:
    """Mean, sd, median, scaled MAD and IQR for all rows and for rows at or below the trim quantile."""
    d = df.filter(F.col(value).isNotNull())
    top = cut(ordering.quantiles(d, [], value, {"top": trim})).select("top").scalar()
    both = d.select(F.col(value).cast("double").alias("_v"), F.explode(F.when(
        F.col(value) <= top, F.array(F.lit("all"), F.lit("trimmed"))).otherwise(F.array(F.lit("all")))).alias("sample"))
    basic = both.groupBy("sample").agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))
    q = cut(ordering.quantiles(both, ["sample"], "_v", {"median": 0.5, "q1": 0.25, "q3": 0.75}))
    dev = both.join(q.select("sample", "median"), "sample").select("sample", F.abs(F.col("_v") - F.col("median")).alias("_d"))
    mad = ordering.medians(dev, ["sample"], "_d", "mad")
    return (basic.join(q, "sample").join(mad, "sample")
            .select("sample", "mean", "sd", "median", (F.col("mad") * 1.4826).alias("mad"), (F.col("q3") - F.col("q1")).alias("iqr")))


def tail_mass(df: DataFrame, value: str) -> DataFrame:
    """Share of log10 values beyond three sd, and skewness raw and logged (positive values only)."""
    d = df.filter(F.col(value) > 0).select(F.col(value).cast("double").alias("_x"), F.log10(F.col(value).cast("double")).alias("_l"))
    s = d.agg(F.struct(F.avg("_l").alias("m"), F.stddev_samp("_l").alias("s"))).scalar()
    beyond = (F.abs(F.col("_l") - F.col("_s.m")) > 3 * F.col("_s.s")).cast("double")
    return d.withColumn("_s", s).agg(F.count("*").alias("n"), F.avg(beyond).alias("share_beyond_3sd"),
                                     F.skewness("_x").alias("skew_raw"), F.skewness("_l").alias("skew_log"))


def banded_rmse(df: DataFrame, band: str, truth: str, estimates: dict[str, str]) -> DataFrame:
    """RMSE of each estimate per band and overall, with the improvement of the second over the first."""
    both = df.filter(F.col(band).isNotNull()).select(band, truth, *estimates.values())
    aggs = [F.count("*").alias("n"), *[F.sqrt(F.avg(F.pow(F.col(c) - F.col(truth), 2))).alias(f"rmse_{k}") for k, c in estimates.items()]]
    by = both.groupBy(F.col(band).alias("band")).agg(*aggs)
    overall = df.agg(*aggs).select(F.lit("all").alias("band"), "n", *[f"rmse_{k}" for k in estimates])
    first, second = [f"rmse_{k}" for k in estimates][:2]
    return by.unionByName(overall).withColumn("improvement", 1 - ratio(second, first))


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """Rows per value of every facet from one scan: (facet, value, n)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in facets]).unpivot([], facets, "facet", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("n"))


def subgroup_gap(df: DataFrame, period: Column, num: tuple[str, str], den: tuple[str, str]) -> DataFrame:
    """Pooled rate gap between a subgroup and the others by period, with the normal 95% half width."""
    p = df.groupBy(period.alias("period")).agg(*[F.sum(c).alias(f"_{i}{j}") for i, pair in enumerate((num, den)) for j, c in enumerate(pair)])
    a, b = ratio("_00", "_10"), ratio("_01", "_11")
    var = ratio(a * (1 - a), "_10") + ratio(b * (1 - b), "_11")
    return p.select("period", a.alias("rate_sub"), b.alias("rate_other"), (a - b).alias("gap"), (F.sqrt(var) * 1.96).alias("half_width"))


def period_change(gaps: DataFrame, first: str, last: str) -> DataFrame:
    """Change of the gap between two periods, with the combined half width."""
    def of(p, c):
        return F.max(F.when(F.col("period") == p, F.col(c)))
    return gaps.agg((of(last, "gap") - of(first, "gap")).alias("change"),
                    F.sqrt(F.pow(of(first, "half_width"), 2) + F.pow(of(last, "half_width"), 2)).alias("half_width"))


def histogram(df: DataFrame, value: str, stack: str, bins: int = 18) -> DataFrame:
    """Equal-width bins up to the 99% lower-index pick; larger values fall into the last bin.

    Fewer than five values give no bins, as in the explorer.
    """
    d = df.filter(F.col(value).isNotNull()).select(stack, F.col(value).cast("double").alias("_v"))
    hi = ordering.picks(d, [], "_v", {"hi": 0.99}, of="n").select("hi").scalar()
    s = d.agg(F.struct(F.min("_v").alias("lo"), hi.alias("hi"), F.count("*").alias("n"))).scalar()
    span = F.col("_s.hi") - F.col("_s.lo")
    width = F.when(span == 0, 1.0).otherwise(span) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_s.lo")) / width)).cast("int")
    b = d.withColumn("_s", s).filter(F.col("_s.n") >= 5).select(stack, at.alias("bin"), (F.col("_s.lo") + at * width).alias("bin_low"))
    return b.groupBy("bin", "bin_low", stack).agg(F.count("*").alias("n"))


def linear_trend(df: DataFrame, time: str, value: str, ahead: int = 3) -> DataFrame:
    """Least-squares line through yearly totals, extended ``ahead`` periods: (period, fitted, actual).

    Input is one row per period, so the sequence of periods is short.
    """
    fit = df.agg(F.regr_slope(value, time).alias("slope"), F.regr_intercept(value, time).alias("intercept"),
                 F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = fit.select("slope", "intercept", F.col("_b").alias("last"), F.explode(F.sequence(F.col("_a"), F.col("_b") + ahead)).alias("period"))
    at_last = F.col("intercept") + F.col("slope") * F.col("last")
    out = grid.select("period", (F.col("intercept") + F.col("slope") * F.col("period")).alias("fitted"),
                      (F.col("period") > F.col("last")).alias("is_forecast"), ratio("slope", at_last).alias("growth_per_year"))
    return out.join(df.select(F.col(time).alias("period"), F.col(value).alias("actual")), "period", "left")


def share_in(df: DataFrame, cond: Column, name: str = "share") -> DataFrame:
    return df.agg(F.avg(false_if_null(cond).cast("double")).alias(name), F.count("*").alias("n"))


def pairwise_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of ids two lists have in common."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("n_both"))
