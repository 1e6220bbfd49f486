"""From raw documents to token ids: toxic documents go, shared lines go, near copies go, test items go, ids come.

Each stage takes (spark, docs, sf_dir) with docs as its predecessor left them, and all but the last return the columns
of ``documents``. Extra columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.decontaminate import drop_contaminated
from cohortlens.llm.jaccard_join import drop_near_copies
from cohortlens.llm.line_dedup import dedup_lines
from cohortlens.llm.merge_replay import encode
from cohortlens.llm.toxicity import drop_toxic, train
from cohortlens.operators.lineage import cut


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network trained on the labelled rows rejects go; all others stay as they are."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the one with the largest doc_id; n_chars follows the text."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return drop_near_copies(docs)


def remove_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a benchmark item, edited or not, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): ids as little-endian unsigned 32-bit integers; round_trip says that they decode to the text."""
    ids = encode(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text"), "text"), and_decode=True)
    return ids.select("doc_id", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("_text")).alias("round_trip"))


STAGES = [("toxicity", remove_toxic), ("line_dedup", remove_lines), ("near_copies", remove_near_copies), ("decontamination", remove_test_items), ("byte_bpe", to_ids)]

# Toxicity is a trained network and the alignment a dynamic programme: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
