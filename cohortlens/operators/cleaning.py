"""Row-level cleaning, universe predicates, feature transforms and held-out values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import clip, col, false_if_null, log10_pos, number
from .guards import require


def split_flags(df: DataFrame, keys: list[str], cols: list[str], prefix: str = "X") -> tuple[DataFrame, DataFrame]:
    """Separate measured values from their imputation flags (flag column = prefix + name)."""
    flags = [f"{prefix}{c}" for c in cols if f"{prefix}{c}" in df.columns]
    return df.select(*keys, *cols), df.select(*keys, *flags)


# Peer features, their source columns and transforms.
PEER_FEATURES = {
    "log_enroll": ("ENROLL_FALL", "log10"),
    "stu_fac_ratio": ("STUFACR", "none"),
    "tuition_share": ("TUITION_SHARE", "clip01"),
    "instr_exp_share": ("INSTR_EXP_SHARE", "clip01"),
    "log_exp_per_fte": ("EXP_PER_FTE", "log10"),
    "instr_fte_share": ("INSTR_FTE_SHARE", "clip01"),
    "tenure_density": ("TENURE_DENSITY", "clip01"),
    "log_avg_salary": ("SALTOTL", "log10"),
    "pct_online": ("PCTE12DEEXC", "none"),
    "pct_pell": ("UPGRNTP", "none"),
}


def transform_feature(c: Column | str, how: str) -> Column:
    if how == "log10":
        return log10_pos(c)
    return clip(number(c), 0.0, 1.0) if how == "clip01" else number(c)


def peer_features(df: DataFrame, spec: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Transformed features; rows with any missing feature are dropped, never imputed."""
    require(df, [c for c, _ in spec.values()], "feature source")
    wide = df.select(*keys, *[transform_feature(c, how).alias(name) for name, (c, how) in spec.items()])
    return wide.dropna(subset=list(spec))


def feature_coverage(df: DataFrame, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """Per feature: source column, missing rows and share missing (3 places), in one aggregate."""
    wide = df.select(*[transform_feature(c, how).alias(name) for name, (c, how) in spec.items()])
    one = wide.agg(F.count("*").alias("_n"), *[F.count_if(F.col(n).isNull()).alias(n) for n in spec])
    long = one.unpivot(["_n"], list(spec), "feature", "missing")
    source = F.create_map(*[x for n, (c, _) in spec.items() for x in (F.lit(n), F.lit(c))])
    return long.select("feature", source[F.col("feature")].alias("source"), "missing",
                       F.bround(F.try_divide(F.col("missing"), F.col("_n")), 3).alias("share_missing"))


def universe_flag(df: DataFrame, active: Column, sector: str, low: int = 1, high: int = 9) -> DataFrame:
    """Analysis universe: active and sector within [low, high], with the first exclusion reason."""
    reason = (F.when(~false_if_null(active), "inactive")
              .when(F.col(sector).isNull(), "sector missing")
              .when(~F.col(sector).between(low, high), "sector outside range"))
    return df.withColumn("exclusion", reason).withColumn("in_universe", F.col("exclusion").isNull())


def exclusion_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("exclusion", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def dashboard_universe(df: DataFrame, degree_granting: Column, latest_fte: str) -> DataFrame:
    return df.filter(degree_granting & (F.col(latest_fte) > 0))


def facet_filter(df: DataFrame, *, text: str | None = None, text_cols: tuple[str, ...] = (),
                 within: dict[str, list] | None = None, minimum: dict[str, float] | None = None,
                 present: tuple[str, ...] = ()) -> DataFrame:
    """Conjunction of optional facets, each one pushed to the scan where it can be."""
    conds: list[Column] = []
    if text:
        hay = F.lower(F.concat_ws(" ", *text_cols))
        conds.append(hay.contains(text.lower()))
    conds += [F.col(c).isin(*vals) for c, vals in (within or {}).items()]
    conds += [F.col(c) >= v for c, v in (minimum or {}).items()]
    conds += [F.col(c).isNotNull() for c in present]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def floor_encode(df: DataFrame, c: str) -> DataFrame:
    """Structural missing: fill with the lowest reported value and keep an indicator."""
    low = df.agg(F.min(c)).scalar()
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int"), c: F.coalesce(F.col(c), low)})


def hold_small_cohorts(df: DataFrame, rates: dict[str, str], minimum: int = 30) -> DataFrame:
    """Move a rate whose cohort is below the minimum to <rate>_held with a note."""
    out = {}
    for rate, n in rates.items():
        small = false_if_null((F.col(n) < minimum) & F.col(rate).isNotNull())
        out[f"{rate}_held"] = F.when(small, F.col(rate))
        out[f"{rate}_note"] = F.when(small, F.format_string("cohort of %d is below %d", F.col(n), F.lit(minimum)))
        out[rate] = F.when(~small, F.col(rate))
    return df.withColumns(out)


def hold_family(df: DataFrame, values: list[str], family: str, anchor: str, shared: str, name: str) -> DataFrame:
    """Keep a shared family value on its anchor only; the others hold it, naming the anchor."""
    anchors = (df.filter(F.col(anchor) & (F.col(shared) > 1)).groupBy(F.col(family).alias("_fam"))
               .agg(F.max(name).alias("_anchor_name")))
    j = df.join(anchors, F.col(family) == F.col("_fam"), "left")
    held = false_if_null((F.col(shared) > 1) & ~F.col(anchor))
    out = {}
    for v in values:
        out[f"{v}_held"] = F.when(held, F.col(v))
        out[f"{v}_note"] = F.when(held & F.col(v).isNotNull(),
                                  F.format_string("shared by %d, counted under %s", F.col(shared), F.col("_anchor_name")))
        out[v] = F.when(~held, F.col(v))
    return j.withColumns(out).drop("_fam", "_anchor_name")


def equity_flag(gap: Column | str, threshold: float) -> Column:
    """A gap above the threshold; a missing gap is not flagged."""
    return false_if_null(col(gap) > threshold)


def split_by_year(df: DataFrame, year: str, last_train: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(year) <= last_train), df.filter(F.col(year) > last_train)
