"""Aggregates behind the interactive explorer: KPI blocks, board and finance panels, serving documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import change, ratio, ratio_nz
from . import ordering


def kpi_block(view: DataFrame, universe: DataFrame, size: str, metrics: list[str]) -> DataFrame:
    """Rows and size of a view with their share of the universe, and view medians against the universe.

    Long output (metric, value, universe_value, rel_diff, tone); below 1% relative difference is flat.
    """
    def medians(df):
        return ordering.multi_quantiles(df, [], metrics, {"value": 0.5}).select("metric", "value")

    def totals(df):
        one = df.agg(F.count("*").cast("double").alias("rows"), F.sum(F.coalesce(F.col(size), F.lit(0))).cast("double").alias("size"))
        return one.unpivot([], ["rows", "size"], "metric", "value")
    v = totals(view).unionByName(medians(view))
    u = totals(universe).unionByName(medians(universe)).withColumnRenamed("value", "universe_value")
    j = v.join(u, "metric", "left")
    share = F.col("metric").isin("rows", "size")
    rel = F.when(share, ratio("value", "universe_value")).otherwise(change("universe_value", "value"))
    tone = F.when(share | (F.abs(rel) < 0.01), "flat").when(rel > 0, "up").otherwise("down")
    return j.select("metric", "value", "universe_value", rel.alias("rel_diff"), tone.alias("tone"))


def level_rates(view: DataFrame, universe: DataFrame, level: str, rate: str) -> DataFrame:
    """Median rate per level in a view. A single-level view is compared with that level of the
    universe; a mixed view is reported per level without a comparison."""
    v = ordering.ranked_values(view, [level], rate).groupBy(level).agg(
        F.sum("n").alias("n"), *ordering.quantile_aggs({"view_median": 0.5}))
    u = ordering.medians(universe, [level], rate, "universe_median")
    n_levels = v.agg(F.count("*")).scalar()
    j = v.join(u, level, "left").withColumn("_levels", n_levels)
    rel = F.when(F.col("_levels") == 1, change("universe_median", "view_median"))
    tone = F.when(rel.isNull() | (F.abs(rel) < 0.01), "flat").when(rel > 0, "up").otherwise("down")
    return j.select(level, "n", "view_median", F.when(F.col("_levels") == 1, F.col("universe_median")).alias("universe_median"),
                    rel.alias("rel_diff"), tone.alias("tone"))


def scatter_extract(df: DataFrame, x: str, y: str, size: str, keep: list[str]) -> DataFrame:
    """Points with both coordinates, and the size relative to the 90th percentile (lower index)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ref = ordering.picks(d, [], size, {"ref": 0.9}).select("ref").scalar()
    return d.select(*keep, x, y, ratio(F.col(size), ref).alias("rel_size"))


def group_series(df: DataFrame, group: str, year: str, money: str, fte: str) -> DataFrame:
    """Yearly money and FTE per group; per-FTE counts only the money of members that report FTE."""
    g = df.groupBy(group, year).agg(F.sum(money).alias("money"), F.sum(fte).alias("fte"),
                                    F.sum(F.when(F.col(fte) > 0, F.col(money))).alias("_m"))
    return g.withColumn("per_fte", ratio_nz("_m", "fte")).drop("_m")


def group_change(series: DataFrame, group: str, year: str, value: str) -> DataFrame:
    """First and last year's value, their change, and the peak value and year."""
    v = F.when(F.col(value).isNotNull(), F.col(year))
    g = series.groupBy(group).agg(F.min_by(value, v).alias("first_value"), F.max_by(value, v).alias("last_value"),
                                  F.max(F.struct(F.col(value), (-F.col(year)).alias("y"))).alias("_p"))
    return g.select(group, "first_value", "last_value", change("first_value", "last_value").alias("change"),
                    F.col("_p")[value].alias("peak"), (-F.col("_p")["y"]).alias("peak_year"))


def unit_finance(df: DataFrame, unit: str, year: str, first: int, last: int, fte: str, parts: list[str], state: str,
                 net: str, discounts: str) -> DataFrame:
    """Per unit: last-year FTE, core revenue per FTE with its change, state share and discount rate."""
    core = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in parts])

    def at(y, e: Column):
        return F.sum(F.when(F.col(year) == y, e))
    g = df.filter(F.col(year).isin(first, last)).groupBy(unit).agg(
        at(last, F.col(fte)).alias("fte"), at(first, F.col(fte)).alias("_f0"), at(last, core).alias("core"), at(first, core).alias("_c0"),
        at(last, F.col(state)).alias("_s"), at(last, F.col(net)).alias("_n"), at(last, F.col(discounts)).alias("_d"))
    per, per0 = ratio_nz("core", "fte"), ratio_nz("_c0", "_f0")
    return g.select(unit, "fte", per.alias("core_per_fte"), change(per0, per).alias("core_change"), ratio("_s", "core").alias("state_share"),
                    F.when(F.col("_n") + F.col("_d") > 0, F.col("_d") / (F.col("_n") + F.col("_d"))).alias("discount_rate"))


def two_year_lines(df: DataFrame, entity: str, year: str, measures: list[str], first: int, last: int, *,
                   fte: str | None = None, minimum: float = 500_000.0) -> DataFrame:
    """Lines of two years side by side, total or per FTE, with change (NULL for a base not above zero).

    Lines below the minimum in both years are dropped; the minimum always applies to totals.
    """
    cols = [*measures, *([fte] if fte else [])]
    wide = df.filter(F.col(year).isin(first, last)).groupBy(entity).agg(*[
        F.sum(F.when(F.col(year) == y, F.col(c).cast("double"))).alias(f"{c}_{i}") for c in cols for i, y in enumerate((first, last))])
    rows = F.array(*[F.struct(F.lit(m).alias("line"), F.col(f"{m}_0").alias("t0"), F.col(f"{m}_1").alias("t1")) for m in measures])
    long = wide.select(entity, *([f"{fte}_0", f"{fte}_1"] if fte else []), F.inline(rows))
    long = long.filter(F.greatest(F.abs("t0"), F.abs("t1")) >= minimum)
    a, b = (ratio("t0", f"{fte}_0"), ratio("t1", f"{fte}_1")) if fte else (F.col("t0"), F.col("t1"))
    return long.select(entity, "line", a.alias("first"), b.alias("last"), F.when(a > 0, change(a, b)).alias("change"))


def serving_records(df: DataFrame, key: str, year: str, series: list[str], attributes: list[str]) -> DataFrame:
    """One record per entity: attributes and one year-ordered array per series, nulls kept.

    The array has one slot per panel year, so its length is bounded by the number of years.
    """
    years = df.select(year).distinct().agg(F.array_sort(F.collect_set(year))).scalar()
    at = df.groupBy(key).agg(*[F.any_value(a).alias(a) for a in attributes], *[
        F.map_from_entries(F.collect_list(F.struct(F.col(year), F.col(s)))).alias(f"_{s}") for s in series])
    out = at.withColumn("_years", years)

    def in_order(name: str) -> Column:
        return F.transform("_years", lambda y: F.col(f"_{name}")[y])
    return out.select(key, *attributes, *[in_order(s).alias(s) for s in series])


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON text per record; NULL fields are written, NaN cannot occur."""
    from ..functions.nulls import no_nan
    clean = no_nan(df)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("record"))


def long_series(df: DataFrame, key: str, years: str, series: list[str]) -> DataFrame:
    """Parallel arrays of a serving document back to long rows (key, year, series...)."""
    z = F.explode(F.arrays_zip(F.col(years).alias("year"), *[F.col(s) for s in series])).alias("z")
    return df.select(key, z).select(key, F.col("z.year"), *[F.col(f"z.{s}").alias(s) for s in series])
