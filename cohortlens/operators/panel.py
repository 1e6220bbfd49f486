"""Panel assembly: joins, crosswalks, lags, balancing and within-entity transforms.

An entity-year panel has one row per (entity, period). Windows by entity are therefore at most as
long as the list of periods; ``assert_unique`` guards that grain before a lag is taken. Statistics
over all rows of an entity or group are computed by aggregates joined back, never by a window
over an unbounded group, so that AQE can split a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import false_if_null
from . import ordering
from .guards import assert_unique, require
from .lineage import cut

KEYS = ["unitid", "survey_year"]


def build_panel(base: DataFrame, *tables: DataFrame | None, keys: list[str] = KEYS) -> DataFrame:
    """Left join feature tables one after another on the panel key; omitted tables are skipped."""
    return reduce(lambda a, b: a.join(b, keys, "left"), [t for t in tables if t is not None], base)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that refuses repeated keys on either side."""
    return assert_unique(left, keys, "left table").join(assert_unique(right, keys, "right table"), keys, "left")


def attach_attributes(df: DataFrame, attributes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Time-invariant attributes by entity id alone."""
    require(attributes, [key, *cols], "attribute table")
    return df.join(attributes.select(key, *cols), key, "left")


def apply_crosswalk(df: DataFrame, changes: DataFrame, entity: str = "unitid", year: str = "survey_year") -> DataFrame:
    """Remap an identifier to its successor for years up to the change; single hop.

    Several changes of one id: the first listed (lowest ordinal) that is still in the future applies.
    The changes of one id are folded into a sorted array of at most one entry per year, so this is
    one equi-join with no range predicate and no row multiplication.
    """
    require(changes, ["unitid_from", "unitid_to", "effective_year", "ordinal"], "crosswalk")
    per_year = changes.groupBy("unitid_from", "effective_year").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("unitid_to", "ordinal").alias("unitid_to"))
    per_id = per_year.groupBy("unitid_from").agg(F.array_sort(F.collect_list(
        F.struct("ordinal", "effective_year", "unitid_to"))).alias("_changes"))
    j = df.join(per_id, F.col(entity) == F.col("unitid_from"), "left")
    hit = F.get(F.filter("_changes", lambda c: F.col(year) <= c["effective_year"]), 0)["unitid_to"]
    return j.withColumn(entity, F.coalesce(hit, F.col(entity))).drop("unitid_from", "_changes")


def closed_entities(changes: DataFrame) -> DataFrame:
    """Changes onto itself with reason "closed": (unitid, closed_year)."""
    closed = changes.filter((F.col("unitid_from") == F.col("unitid_to")) & (F.lower("reason") == "closed"))
    return closed.select(F.col("unitid_from").alias("unitid"), F.col("effective_year").alias("closed_year"))


def compare_to_published(model: DataFrame, published: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Inner join of two sources of one value with absolute difference and tolerance flag."""
    require(model, [*keys, value], "model table")
    require(published, [*keys, value], "published table")
    j = model.select(*keys, F.col(value).alias(f"{value}_model")).join(
        published.select(*keys, F.col(value).alias(f"{value}_published")), keys)
    diff = F.abs(F.col(f"{value}_model") - F.col(f"{value}_published"))
    return j.withColumn("abs_diff", diff).withColumn("within_tolerance", false_if_null(diff <= tolerance))


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("n"), F.avg("abs_diff").alias("mean_abs_diff"),
                        F.avg(F.col("within_tolerance").cast("double")).alias("share_within"))


def agreement_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows whose two labels agree (missing never agrees)."""
    return df.agg(F.avg(false_if_null(F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.count("*").alias("n"))


def semi(df: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(allowed, keys, "left_semi")


def orphans(df: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """Rows whose non-missing identifier is absent from the universe."""
    return df.filter(F.col(key).isNotNull()).join(universe.select(key), key, "left_anti")


def attach_outcomes(records: DataFrame, outcomes: DataFrame, fte: str, values: list[str]) -> DataFrame:
    """Outcome values, family size and the anchor campus of each family.

    The anchor is the main campus with the most FTE (smallest id wins a tie), or among all members
    when the family has no main campus. Family facts are one aggregate per family joined back.
    """
    j = records.join(outcomes, "unitid", "left")
    order = F.struct(F.coalesce(F.col("main"), F.lit(False)).alias("m"), F.coalesce(F.col(fte), F.lit(0)).alias("f"),
                     (-F.col("unitid")).alias("i"))
    fam = (j.filter(F.col("family").isNotNull()).groupBy(F.col("family").alias("_family"))
           .agg(F.count("*").alias("shared"), F.max_by("unitid", order).alias("_anchor")))
    out = j.join(fam, F.col("family") == F.col("_family"), "left")
    return out.withColumn("anchor", F.col("unitid") == F.col("_anchor")).select(
        *records.columns, "family", *values, "shared", "anchor")


def attach_state_panel(records: DataFrame, residents: DataFrame, year: str, value: str, name: str) -> DataFrame:
    """Latest-year residents summed per unit, with the ordered campus list."""
    latest = residents.filter(F.col(year) == residents.agg(F.max(year)).scalar())
    per_unit = latest.groupBy("unitid").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("resident"),
                                            F.array_sort(F.collect_set(name)).alias("campuses"))
    return records.join(per_unit, "unitid", "left")


def assemble(base: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]], key: str = "unitid") -> DataFrame:
    """Wide record from many component tables by id; every part contributes the named columns."""
    return reduce(lambda a, p: a.join(p[0].select(key, *p[1]), key, "left"), parts.values(), base)


# --- windows ---------------------------------------------------------------------------------

def lags(df: DataFrame, entity: str, time: str, value: str, n: int) -> DataFrame:
    """Row lags 1..n per entity in time order (a gap in the years is not detected)."""
    w = W.partitionBy(entity).orderBy(time)
    return df.withColumns({f"{value}_lag{i}": F.lag(value, i).over(w) for i in range(1, n + 1)})


def rolling_prior_mean(df: DataFrame, entity: str, time: str, value: str, size: int = 3, name: str | None = None) -> DataFrame:
    """Mean of the previous rows, NULL unless all of them are present."""
    w = W.partitionBy(entity).orderBy(time).rowsBetween(-size, -1)
    mean = F.when(F.count(value).over(w) == size, F.avg(value).over(w))
    return df.withColumn(name or f"{value}_roll{size}", mean)


def within(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """Subtract entity means (fixed-effects transform): aggregate, then join back."""
    means = df.groupBy(F.col(entity).alias("_e")).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    j = df.join(means, F.col(entity).eqNullSafe(F.col("_e")))
    return j.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop("_e", *[f"_m_{c}" for c in cols])


def above_group_median(df: DataFrame, group: str, value: str, name: str = "above_median") -> DataFrame:
    """1 when strictly above the group median, else 0 (ties are not above)."""
    m = ordering.medians(df, [group], value, "_median").withColumnRenamed(group, "_g")
    return (df.join(m, F.col(group) == F.col("_g"), "left")
            .withColumn(name, false_if_null(F.col(value) > F.col("_median")).cast("int")).drop("_g", "_median"))


def balanced(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Entities with a non-missing value in every observed period."""
    seen = df.filter(F.col(value).isNotNull())
    n = seen.select(time).distinct().agg(F.count("*")).scalar()
    keep = (seen.select(entity, time).distinct().groupBy(entity).agg(F.count("*").alias("_n"))
            .filter(F.col("_n") == n).select(entity))
    return seen.join(keep, entity, "left_semi")


def trend_by_group(df: DataFrame, group: str, time: str, value: str, name: str) -> DataFrame:
    return df.groupBy(group, time).agg(F.avg(value).alias(name))


def stack_vintages(parts: dict[int, DataFrame], cols: list[str], key: str = "unitid", year: str = "year") -> DataFrame:
    """Yearly releases of one table to a long panel; refuses repeated (key, year)."""
    stacked = reduce(lambda a, b: a.unionByName(b),
                     [df.select(key, *cols).withColumn(year, F.lit(y)) for y, df in parts.items()])
    return assert_unique(stacked, [key, year], "vintages")


def robust_z(df: DataFrame, groups: list[str], cols: dict[str, int], min_mad: float = 1e-9, cap: float = 3.0) -> DataFrame:
    """Within-group (x - median) / (1.4826 MAD), oriented by +1/-1/0 (0 keeps the sign) and capped.

    Returns columns z_<col>; NULL for a group whose MAD is at or below ``min_mad``. All columns go
    through one long quantile pass for the medians and one for the MADs; each leaves a small table.
    """
    names = list(cols)
    med = cut(_wide(ordering.multi_quantiles(df, groups, names, {"q": 0.5}), groups, names, "q", "_med_"))
    j = _attach(df, med, groups)
    dev = j.select(*groups, *[F.abs(F.col(c) - F.col(f"_med_{c}")).alias(c) for c in names])
    mad = cut(_wide(ordering.multi_quantiles(dev, groups, names, {"q": 0.5}), groups, names, "q", "_mad_"))
    j = _attach(j, mad, groups)
    out = {}
    for c, sign in cols.items():
        scale = F.col(f"_mad_{c}") * 1.4826
        z = F.when(scale > min_mad, (F.col(c) - F.col(f"_med_{c}")) / scale) * (sign or 1)
        out[f"z_{c}"] = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-cap)), F.lit(cap)))
    return j.withColumns(out).drop(*[f"_med_{c}" for c in names], *[f"_mad_{c}" for c in names])


def _wide(long: DataFrame, groups: list[str], names: list[str], value: str, prefix: str) -> DataFrame:
    return long.groupBy(*groups).agg(*[F.max(F.when(F.col("metric") == c, F.col(value))).alias(f"{prefix}{c}") for c in names])


def _attach(df: DataFrame, stats: DataFrame, groups: list[str]) -> DataFrame:
    """Group statistics joined back (small by construction: AQE broadcasts it when it measures so)."""
    if groups:
        return df.join(stats, groups, "left")
    row = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("_row", row).select("*", "_row.*").drop("_row")


def top_n(df: DataFrame, by: Column, tie: str, n: int) -> DataFrame:
    return df.orderBy(by, tie).limit(n)


def top_n_per_group(df: DataFrame, group: str, by: Column, tie: str, n: int) -> DataFrame:
    """Top rows per group; Spark's group limit keeps n rows per map partition before the shuffle."""
    w = W.partitionBy(group).orderBy(by, tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
