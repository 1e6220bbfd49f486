"""Peer groups: rule-based bands, nearest neighbours, and benchmarks against them.

A peer list is always asked for one focal entity, whose single row is read first; every later
step is a filter with literals that reaches the scan. Where every entity needs its peer summary,
prefix sums replace the list, so no pair of entities is ever formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import change, ratio
from . import ordering
from .guards import require


def focal_row(df: DataFrame, cond: Column, what: str) -> dict:
    rows = df.filter(cond).limit(1).collect()
    if not rows:
        raise ValueError(f"{what} not found")
    return rows[0].asDict()


def rule_peers(panel: DataFrame, target: int, year: int, group_cols: list[str], size: str = "total_enrollment",
               tolerance: float = 0.25, *, missing_ok: bool = False) -> DataFrame:
    """Others of the same year and groups whose size is within +/- tolerance of the target's.

    A target without a row in that year raises; with ``missing_ok`` it has no peers.
    """
    require(panel, [*group_cols, "unitid", "survey_year", size], "panel")
    own = (F.col("unitid") == target) & (F.col("survey_year") == year)
    if missing_ok and panel.filter(own).isEmpty():
        return panel.limit(0)
    at = focal_row(panel, own, f"unitid {target} in {year}")
    conds = [F.col("survey_year") == year, F.col("unitid") != target,
             F.col(size).between(at[size] * (1 - tolerance), at[size] * (1 + tolerance))]
    conds += [F.col(c) == at[c] for c in group_cols]
    return panel.filter(reduce(lambda a, b: a & b, conds))


def peer_band_summary(df: DataFrame, groups: list[str], entity: str, size: str, value: str, tolerance: float = 0.25) -> DataFrame:
    """Number of rule-based peers and their mean value for every entity, self excluded.

    Each entity asks two prefix-sum questions (below its band, up to the end of its band); the
    questions are rows in the same ordering as the data, so the job is one distributed running sum. Values are summed as
    decimals: a peer mean is the same in any order of rows, whatever large values stand elsewhere in the group.
    """
    d = df.select(*groups, entity, F.col(size).cast("double").alias("_x"), F.col(value).cast("double").alias("_v"))
    d = d.filter(F.col("_x").isNotNull() & F.col("_v").isNotNull())
    marks = F.array(
        F.struct((F.col("_x") * (1 - tolerance)).alias("x"), F.lit(0).alias("kind"), F.lit(0).alias("n")),
        F.struct(F.col("_x").alias("x"), F.lit(1).alias("kind"), F.lit(1).alias("n")),
        F.struct((F.col("_x") * (1 + tolerance)).alias("x"), F.lit(2).alias("kind"), F.lit(0).alias("n")))
    parts = ordering.exact_parts("_v", "s")
    events = d.withColumns({f"_{k}": c for k, c in parts.items()}).select(*groups, entity, *[f"_{k}" for k in parts], F.inline(marks))
    events = events.withColumns({k: F.when(F.col("kind") == 1, F.col(f"_{k}")).otherwise(F.lit(0).cast("decimal(1,0)")) for k in parts})
    r = ordering.running(events, groups, ["x", "kind", entity], ["n", *parts])

    def at(kind, c):
        return F.max(F.when(F.col("kind") == kind, F.col(c)))
    n = at(2, "n_below") - at(0, "n_below") - 1
    s = sum(((at(2, f"{k}_below") - at(0, f"{k}_below") - F.max(f"_{k}")).cast("double") for k in parts), F.lit(0.0))
    return r.groupBy(*groups, entity).agg(n.alias("n_peers"), F.when(n > 0, s / n).alias("peer_mean"))


# Match tiers in order, widening from control + level + family to level alone.
TIERS = (("control", "level", "family"), ("control", "level"), ("level",))
TIER_LABELS = ("same control, level and family", "same control and level", "same level")


def nearest_peers(df: DataFrame, target: int, features: list[str], log_feature: str, k: int = 8, entity: str = "unitid",
                  tiers: tuple[tuple[str, ...], ...] = TIERS, labels: tuple[str, ...] = TIER_LABELS) -> DataFrame:
    """The k nearest comparable entities by Euclidean distance over pool z-scores.

    The pool is the narrowest tier with at least k members (else the widest, with a NULL scope);
    pool mean and sd leave the target out, and a zero or undefined sd counts as 1. One aggregate
    sizes every tier and takes its statistics; a second job is a top-k.
    """
    x = {f: (F.log10(F.greatest(F.lit(1.0), F.col(f).cast("double"))) if f == log_feature else F.col(f).cast("double")) for f in features}
    usable = df.dropna(subset=features).withColumns({f"_x_{f}": e for f, e in x.items()})
    at = focal_row(usable, F.col(entity) == target, f"{entity} {target} with every peer feature")
    others = usable.filter(F.col(entity) != target)
    tests = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(at[c])) for c in tier]) for tier in tiers]
    aggs = []
    for i, test in enumerate(tests):
        aggs.append(F.count_if(test).alias(f"n{i}"))
        for j, f in enumerate(features):
            aggs += [F.avg(F.when(test, F.col(f"_x_{f}"))).alias(f"m{i}_{j}"),
                     F.stddev_samp(F.when(test, F.col(f"_x_{f}"))).alias(f"s{i}_{j}")]
    stats = others.agg(*aggs).collect()[0]
    tier = next((i for i in range(len(tiers)) if stats[f"n{i}"] >= k), None)
    scope, use = (labels[tier], tier) if tier is not None else (None, len(tiers) - 1)
    terms = []
    for j, f in enumerate(features):
        sd = stats[f"s{use}_{j}"]
        sd = sd if sd and sd == sd else 1.0
        terms.append(F.pow((F.col(f"_x_{f}") - F.lit(at[f"_x_{f}"])) / F.lit(sd), 2))
    dist = F.sqrt(reduce(lambda a, b: a + b, terms))
    return (others.filter(tests[use]).withColumn("distance", dist).withColumn("scope", F.lit(scope))
            .withColumn("pool_size", F.lit(stats[f"n{use}"])).drop(*[f"_x_{f}" for f in features])
            .orderBy("distance", entity).limit(k))


def peer_series(df: DataFrame, peers: DataFrame, entity: str, time: str, value: str, target: int) -> DataFrame:
    """The focal series beside the peer median of every period."""
    members = df.join(peers.select(entity), entity, "left_semi")
    med = ordering.medians(members, [time], value, "peer_median")
    own = df.filter(F.col(entity) == target).select(time, F.col(value).alias("own"))
    return own.join(med, time, "left").withColumn("rel_diff", change("peer_median", "own"))


def benchmark(df: DataFrame, peers: DataFrame, entity: str, target: int, metrics: list[str]) -> DataFrame:
    """Focal value, peer median, relative difference and reporting peers for several metrics."""
    members = df.join(peers.select(entity), entity, "left_semi")
    med = ordering.multi_quantiles(members, [], metrics, {"peer_median": 0.5})
    own = (df.filter(F.col(entity) == target).select(*[F.col(m).cast("double").alias(m) for m in metrics])
           .unpivot([], metrics, "metric", "own"))
    return own.join(med, "metric", "left").withColumn("rel_diff", change("peer_median", "own"))


def linkage_share(released: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Share of released rows that match exactly one reference row on the quasi-identifiers.

    NULL matches NULL. Both sides are reduced to class sizes first, so equal rows never pair up.
    """
    rel = released.groupBy(*keys).agg(F.count("*").alias("n_released"))
    ref = reference.groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys]).agg(F.count("*").alias("n_reference"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    j = rel.join(ref, on, "left")
    linked = F.sum(F.when(F.col("n_reference") == 1, F.col("n_released")).otherwise(0))
    return j.agg(F.sum("n_released").alias("n_rows"), linked.alias("n_linked"),
                 ratio(linked, F.sum("n_released")).alias("linked_share"))
