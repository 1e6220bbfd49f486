"""Ranks, running totals and exact quantiles for groups of any size.

A window over one group, or Spark's exact ``percentile``, puts a whole group into one task.
Here a third of all rows may share one group, or even one value:

1. rows are first counted per (group, value), so ties cost one row, and the counts are written
   once as a table in the shared folder; its row count is then known from the file footers;
2. the sorted (group, value) sequence is dealt into ranges of about ``BUCKET_ROWS`` rows, at least two, and
   written with the number of its range: the number then stays the same whatever is recomputed;
3. totals per (group, range) give each range its starting offset (a window over the ranges of a
   group), and the running sum inside a range is an ordinary, bounded window.

There is one path for every size. Nothing is collected, and groups need not fit anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

BUCKET_ROWS = 250_000


def bucket_count(rows: int) -> int:
    return rows // BUCKET_ROWS + 2


def _bucketed(base: DataFrame, keys: list[str]) -> DataFrame:
    """The written table with _bucket, the number of the row's range among the sorted keys."""
    ranges = base.repartitionByRange(bucket_count(base.count()), *keys)
    return cut(ranges.withColumn("_bucket", F.spark_partition_id()))


def running(counts: DataFrame, groups: list[str], order: list[str], measures: list[str]) -> DataFrame:
    """Exclusive running sums within each group.

    ``counts`` has one row per (groups, order). For every measure m two columns are added:
    ``m_below``, the sum over the rows strictly before this one, and ``m_total``, the group sum.
    """
    gs = groups or ["_all"]
    base = counts if groups else counts.withColumn("_all", F.lit(0))
    keyed = _bucketed(cut(base), gs + order)
    per_bucket = keyed.groupBy(*gs, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    before = W.partitionBy(*gs).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*gs)
    offsets = per_bucket.select(
        *[F.col(g).alias(f"_o_{g}") for g in gs], F.col("_bucket").alias("_o_bucket"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures])
    inside = W.partitionBy(*gs, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumns({f"_l_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    same = F.col("_bucket") == F.col("_o_bucket")
    for g in gs:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    out = local.join(offsets, same)
    out = out.withColumns({f"{m}_below": F.col(f"_l_{m}") + F.col(f"_o_{m}") for m in measures})
    return out.select(*counts.columns, *[f"{m}_below" for m in measures], *[f"{m}_total" for m in measures])


def exact_parts(value: Column | str, name: str) -> dict[str, Column]:
    """A double as two decimals, ``name_w`` (nearest whole number, below 10^28) and ``name_f`` (the rest, to 18 places).

    Sums of decimals are exact, so they do not depend on the order of rows and differences of running sums lose nothing.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    whole = v.cast("decimal(28,0)")
    return {f"{name}_w": whole, f"{name}_f": (v - whole.cast("double")).cast("decimal(26,18)")}


def comparable(df: DataFrame, value: Column | str, exact: bool) -> Column:
    """The value as double, NaN as NULL; with ``exact`` whole numbers and decimals keep their type."""
    v = F.col(value) if isinstance(value, str) else value
    if exact and df.select(v.alias("v")).dtypes[0][1].startswith(("tinyint", "smallint", "int", "bigint", "decimal")):
        return v
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


def value_counts(df: DataFrame, groups: list[str], value: Column | str, extra: dict[str, Column] | None = None, *, exact: bool = False) -> DataFrame:
    """Rows per (groups, value); rows with a missing value or group key are left out."""
    base = df.withColumn("_value", comparable(df, value, exact)).filter(F.col("_value").isNotNull())
    for g in groups:
        base = base.filter(F.col(g).isNotNull())
    aggs = [F.count("*").alias("n")] + [c.alias(k) for k, c in (extra or {}).items()]
    return base.groupBy(*groups, "_value").agg(*aggs)


def ranked_values(df: DataFrame, groups: list[str], value: Column | str, *, exact: bool = False) -> DataFrame:
    """Distinct values with n, n_below and n_total per group."""
    return running(value_counts(df, groups, value, exact=exact), groups, ["_value"], ["n"])


def values_at(ranked: DataFrame, groups: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (groups, position, ...) with the value at each 0-based position of its sorted group.

    ``ranked`` is a table of ``ranked_values``. Both are put in one order, a value where its first row stands; the largest value
    so far, in the range and in the ranges before it, is the one asked for.
    """
    others = [c for c in wanted.columns if c not in (*groups, "position")]
    of_values = ranked.select(*groups, F.col("n_below").alias("position"), F.lit(0).alias("_asked"), F.col("_value").alias("value"))
    asked = wanted.select(*groups, "position", F.lit(1).alias("_asked"), F.struct(*others).alias("_others"))
    keyed = _bucketed(cut(of_values.unionByName(asked, allowMissingColumns=True)), [*groups, "position", "_asked"])
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = keyed.groupBy(*groups, "_bucket").agg(F.max("value").alias("_top")).select(
        *[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_bucket").alias("_o_bucket"), F.max("_top").over(before).alias("_carried"))
    inside = W.partitionBy(*groups, "_bucket").orderBy("position", "_asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    same = F.col("_bucket") == F.col("_o_bucket")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    at = keyed.withColumn("_here", F.max("value").over(inside)).filter("_asked = 1").join(carried, same)
    return at.select(*groups, "position", F.coalesce("_here", "_carried").alias("value"), "_others.*")


def _order_statistic(index: Column) -> Column:
    """Aggregate: the value at a 0-based position of the sorted group."""
    hit = (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n"))
    return F.max(F.when(hit, F.col("_value")))


def quantile_aggs(probs: dict[str, float]) -> list[Column]:
    """Linear-interpolation quantiles as aggregates over ranked_values rows."""
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        low, high = _order_statistic(F.floor(pos)), _order_statistic(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * frac).alias(name))
    return aggs


def quantiles(df: DataFrame, groups: list[str], value: Column | str, probs: dict[str, float]) -> DataFrame:
    """Exact linear quantiles, one row per group: ``probs`` maps output name to probability."""
    return ranked_values(df, groups, value).groupBy(*groups).agg(*quantile_aggs(probs))


def medians(df: DataFrame, groups: list[str], value: Column | str, name: str = "median") -> DataFrame:
    return quantiles(df, groups, value, {name: 0.5})


def multi_quantiles(df: DataFrame, groups: list[str], cols: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns at once, long: (groups, metric, n, *probs). One shuffle chain for all."""
    long = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(groups, cols, "metric", "_v")
    return (ranked_values(long, [*groups, "metric"], "_v").groupBy(*groups, "metric")
            .agg(F.sum("n").alias("n"), *quantile_aggs(probs)))


def picks(df: DataFrame, groups: list[str], value: Column | str, probs: dict[str, float], *, of: str = "n-1") -> DataFrame:
    """Lower-index quantiles sorted[floor(q*(n-1))], or sorted[floor(q*n)] with ``of="n"``."""
    size = F.col("n_total") - (1 if of == "n-1" else 0)
    aggs = [_order_statistic(F.least(F.floor(F.lit(float(q)) * size), F.col("n_total") - 1)).alias(name)
            for name, q in probs.items()]
    return ranked_values(df, groups, value).groupBy(*groups).agg(*aggs)


def average_rank(df: DataFrame, groups: list[str], value: str, name: str = "rank", *, descending: bool = False) -> DataFrame:
    """Average rank (ties share the mean of their positions); missing values get a NULL rank."""
    r = ranked_values(df, groups, value, exact=True)
    below = F.col("n_total") - F.col("n_below") - F.col("n") if descending else F.col("n_below")
    table = r.select(*[F.col(g).alias(f"_r_{g}") for g in groups], F.col("_value"),
                     (below + (F.col("n") + 1) / 2).alias(name))
    on = comparable(df, value, True) == F.col("_value")
    for g in groups:
        on = on & (F.col(g) == F.col(f"_r_{g}"))
    return df.join(table, on, "left").drop("_value", *[f"_r_{g}" for g in groups])


def share_below(df: DataFrame, value: str, focal: Column) -> Column:
    """Aggregate: share of non-missing values strictly below a focal value."""
    return F.avg((F.col(value) < focal).cast("double"))


def row_positions(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """1-based position of every row under a unique order, without a whole-group window."""
    counts = df.groupBy(*groups, *order).agg(F.count("*").alias("n"))
    at = running(counts, groups, order, ["n"])
    return at.withColumn("position", F.col("n_below") + 1)


def quantile_bins(df: DataFrame, groups: list[str], value: str, q: int, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins 1..q (lowest value included), NULL for missing values."""
    edges = {f"_e{i}": i / q for i in range(1, q)}
    e = quantiles(df, groups, value, edges)
    on = F.lit(True)
    for g in groups:
        e = e.withColumnRenamed(g, f"_g_{g}")
        on = on & (F.col(g) == F.col(f"_g_{g}"))
    if groups:
        out = df.join(e, on, "left")
    else:
        s = e.select(F.struct(*edges).alias("s")).scalar()
        out = df.withColumn("_s", s).select("*", "_s.*").drop("_s")
    b = F.lit(1)
    for k in edges:
        b = b + (F.col(value) > F.col(k)).cast("int")
    return out.withColumn(name, b).drop(*edges, *[f"_g_{g}" for g in groups])
