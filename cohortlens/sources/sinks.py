"""Writers: panels, curated tables with sidecars, schema locks, serving documents and extracts."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import no_nan
from ..operators.guards import assert_unique


def save_panel(df: DataFrame, path: str, year: str = "survey_year", mode: str = "overwrite") -> None:
    """Parquet partitioned by year; rows of one year are spread by the entity, not piled into one task."""
    df.write.mode(mode).partitionBy(year).parquet(path)


def write_curated(df: DataFrame, root: str, name: str, *, period: str, grain: list[str], notes: str = "", provenance: DataFrame | None = None) -> None:
    """Table plus a one-row JSON sidecar; the grain is asserted first."""
    assert_unique(df, grain, name)
    no_nan(df).write.mode("overwrite").parquet(f"{root}/{name}")
    spark = df.sparkSession
    written = spark.read.parquet(f"{root}/{name}")
    files = provenance.select("path", "bytes", "sha256") if provenance is not None else None
    meta = written.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("name"), F.lit(period).alias("period"), F.array(*[F.lit(g) for g in grain]).alias("grain"), "rows",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.lit(notes).alias("notes"))
    if files is not None:
        meta = meta.withColumn("provenance", files.agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256")))).scalar())
    meta.coalesce(1).write.mode("overwrite").json(f"{root}/{name}.meta")


def _stored_signature(spark: SparkSession, path: str) -> list[str] | None:
    try:
        rows = spark.read.schema("position int, name string").json(path).orderBy("position").collect()
    except AnalysisException:
        return None
    return [r["name"] for r in rows]


def lock_schema(df: DataFrame, path: str, *, strict: bool = False) -> DataFrame:
    """Compare column names with the stored signature: (status, added, removed).

    The first call stores the signature ("created"); later calls report "unchanged" or "changed", and
    raise when strict. Only column names reach the driver.
    """
    spark, names = df.sparkSession, list(df.columns)
    old = _stored_signature(spark, path)
    if old is None:
        spark.createDataFrame(list(enumerate(names)), "position int, name string").coalesce(1).write.mode("overwrite").json(path)
        status, added, removed = "created", [], []
    else:
        added, removed = sorted(set(names) - set(old)), sorted(set(old) - set(names))
        status = "changed" if added or removed else "unchanged"
        if strict and status == "changed":
            raise ValueError(f"schema changed: added {added}, removed {removed}")
    return spark.createDataFrame([(status, added, removed)], "status string, added array<string>, removed array<string>")


def save_report(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_serving(records: DataFrame, meta: dict, path: str) -> None:
    """Serving document as a meta row and one JSON line per record; NaN never reaches the file."""
    spark = records.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    clean = no_nan(records)
    clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/records")


def read_serving(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, dict]:
    reader = spark.read.schema(schema) if schema else spark.read
    meta = json.loads(spark.read.text(f"{path}/meta").limit(1).collect()[0][0])
    return reader.json(f"{path}/records"), meta


def export_extract(df: DataFrame, key: list[str], restored: list[str], year: str, value: str, years: list[int]) -> DataFrame:
    """Extract with held-out values restored and one column per trend year."""
    out: dict[str, Column] = {c: F.coalesce(F.col(c), F.col(f"{c}_held")) for c in restored}
    d = df.withColumns(out)
    return d.groupBy(*key).agg(*[F.max(c).alias(c) for c in restored],
                               *[F.max(F.when(F.col(year) == y, F.col(value))).alias(f"{value}_{y}") for y in years])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def column_dictionary(df: DataFrame) -> DataFrame:
    """(column, type, non_missing) from one aggregate."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = one.unpivot([], df.columns, "column", "non_missing")
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return long.select("column", types[F.col("column")].alias("type"), "non_missing")
