"""All registered queries; importing the family modules fills the registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry

FAMILIES = ("clean", "derived", "joined", "windowed", "checked", "disclosed", "aggregated", "inferred", "funded", "modelled", "served", "landed")


for _f in FAMILIES:
    importlib.import_module(f"cohortlens.plans.{_f}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: registry.bind(fn) for name, fn in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["t24_focal_scorecard"](spark, folder)
