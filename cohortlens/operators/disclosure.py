"""Small-cell suppression, k-anonymity and keyed pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
import os
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import false_if_null, number
from . import peers
from .guards import require


def flag_small(df: DataFrame, count: str, minimum: int = 10) -> DataFrame:
    """Flag cells below the minimum; a zero is flagged too, a missing count is not."""
    return df.withColumn("is_small_cell", false_if_null(F.col(count) < minimum))


def mask_small(df: DataFrame, count: str, values: list[str], minimum: int = 10) -> DataFrame:
    flagged = flag_small(df, count, minimum)
    return flagged.withColumns({v: F.when(~F.col("is_small_cell"), F.col(v)) for v in values})


def suppression_rate(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.avg(F.col("is_small_cell").cast("double")).alias("suppression_rate"), F.count("*").alias("n_cells"))


def suppress(df: DataFrame, counts: list[str], tie_break: list[str], *, threshold: int = 10, groups: list[str] | None = None) -> DataFrame:
    """Primary and complementary suppression.

    Primary: 0 < n < threshold is blanked, a true zero stays. Complementary: in a group with exactly
    one blank, the smallest other non-missing cell (a zero qualifies; ties by ``tie_break``) is blanked
    too. Per group one aggregate finds the number of blanks and the cell to blank; it is joined back,
    so a group of any size is never gathered in one task. Adds <count>_blank, <count>_unprotected
    (group keeps a single blank because it has no other cell) and _suppressed.
    """
    require(df, [*counts, *(groups or []), *tie_break], "suppression input")
    out = df.withColumns({f"{c}_blank": false_if_null((number(c) > 0) & (number(c) < threshold)) for c in counts})
    if groups:
        aggs = []
        for c in counts:
            blank = F.col(f"{c}_blank")
            cell = F.struct(number(c).alias("v"), *tie_break)
            aggs += [F.count_if(blank).alias(f"_n_{c}"), F.min(F.when(~blank & number(c).isNotNull(), cell)).alias(f"_c_{c}")]
        per = df_groups(out, groups, aggs)
        on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups])
        out = out.join(per, on)
        extra = {}
        for c in counts:
            single = F.col(f"_n_{c}") == 1
            chosen = false_if_null(F.struct(number(c).alias("v"), *tie_break) == F.col(f"_c_{c}"))
            extra[f"{c}_unprotected"] = single & F.col(f"_c_{c}").isNull()
            extra[f"{c}_blank"] = F.col(f"{c}_blank") | (single & chosen)
        out = out.withColumns(extra).drop(*[f"_g_{g}" for g in groups], *[f"_{k}_{c}" for k in "nc" for c in counts])
    else:
        out = out.withColumns({f"{c}_unprotected": F.lit(False) for c in counts})
    any_blank = reduce(lambda a, b: a | b, [F.col(f"{c}_blank") for c in counts])
    return out.withColumns({"_suppressed": any_blank, **{c: F.when(~F.col(f"{c}_blank"), F.col(c)) for c in counts}})


def df_groups(df: DataFrame, groups: list[str], aggs: list) -> DataFrame:
    return df.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(*aggs)


def suppression_audit(suppressed: DataFrame, counts: list[str], threshold: int) -> DataFrame:
    """Blanked cells and unprotected groups per column, from one aggregate.

    An unprotected group has one cell, so its flag is counted on the blank cell itself.
    """
    one = suppressed.agg(*[F.struct(F.count_if(F.col(f"{c}_blank")).alias("n"), F.count_if(
        F.col(f"{c}_unprotected") & F.col(f"{c}_blank")).alias("u")).alias(c) for c in counts])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["n"].alias("n_suppressed"), F.lit(threshold).alias("threshold"),
                              F.col(c)["u"].alias("groups_needing_total_suppressed")) for c in counts])
    return one.select(F.inline(rows))


def recoverable(suppressed: DataFrame, count: str, groups: list[str]) -> DataFrame:
    """Groups of several cells with exactly one blank: the blank follows by subtraction."""
    g = suppressed.groupBy(*groups).agg(F.count("*").alias("n_cells"), F.count_if(F.col(f"{count}_blank")).alias("n_blank"))
    return g.filter("n_cells > 1 and n_blank = 1")


def k_anonymity(df: DataFrame, quasi: list[str]) -> DataFrame:
    """Equivalence classes (NULL is a value) with their size; a class of one is at risk."""
    require(df, quasi, "release")
    c = df.groupBy(*quasi).agg(F.count("*").alias("class_size"))
    return c.withColumns({"k": F.col("class_size"), "at_risk": F.col("class_size") == 1})


def reidentification(df: DataFrame, reference: DataFrame, key_sets: dict[str, list[str]], small: int = 5) -> DataFrame:
    """Per key set: smallest class, rows in classes below ``small`` and the linked share."""
    parts = []
    for name, keys in key_sets.items():
        c = k_anonymity(df, keys).agg(F.min("class_size").alias("min_k"), F.coalesce(F.sum(
            F.when(F.col("class_size") < small, F.col("class_size"))), F.lit(0)).alias("rows_small"))
        link = peers.linkage_share(df, reference, keys).select("linked_share").scalar()
        parts.append(c.select(F.lit(name).alias("key_set"), "min_k", "rows_small", link.alias("linked_share")))
    return reduce(lambda a, b: a.unionByName(b), parts)


PLACEHOLDER_SALTS = {"", "salt", "changeme"}


def pseudonyms(ids: DataFrame, col: str, salt: str | None = None, prefix: str = "INST", env: str = "PSEUDONYM_SALT") -> DataFrame:
    """Distinct ids with their keyed pseudonym: prefix and 12 hex digits of HMAC-SHA256.

    The key travels inside the pickled task, never in a plan or event log. The result is the
    crosswalk: keep it away from anything that is released.
    """
    salt = salt if salt is not None else os.environ.get(env, "")
    if salt in PLACEHOLDER_SALTS:
        raise ValueError("refusing to pseudonymise with a placeholder salt")
    key = salt.encode()

    @F.pandas_udf("string")
    def token(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else
                     f"{prefix}_{hmac.new(key, str(int(v)).encode(), hashlib.sha256).hexdigest()[:12]}")

    d = ids.select(col).filter(F.col(col).isNotNull()).distinct()
    return d.withColumn("pseudonym", token(F.col(col)))


def pseudonymise(df: DataFrame, col: str, salt: str | None = None, prefix: str = "INST") -> DataFrame:
    """Replace an identifier by its pseudonym: one hash per distinct id, joined back."""
    return df.join(pseudonyms(df, col, salt, prefix), col, "left").drop(col)


def public_layer(df: DataFrame, id_col: str, keep: list[str], coarse: dict, salt: str | None = None) -> DataFrame:
    """Release layer: pseudonym, kept columns and coarsened quasi-identifiers only."""
    return pseudonymise(df.select(id_col, *keep, *[e.alias(n) for n, e in coarse.items()]), id_col, salt)
