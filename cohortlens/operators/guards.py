"""Checks that refuse wrong inputs. These are the only eager steps beside model fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, cols, name: str = "table") -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts (NULL keys included)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """Raise when a key repeats; returns df so that it can be chained.

    The check is one aggregate whose limit stops after the first offender.
    """
    require(df, keys, name)
    if repeated_keys(df, keys).limit(1).count():
        raise ValueError(f"{name} is not one row per {tuple(keys)}")
    return df


def assert_empty(df: DataFrame, message: str) -> None:
    bad = df.limit(3).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")
