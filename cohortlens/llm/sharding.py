"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text are a group. A group with more than 1/(``FINE`` * shards) of all bytes, tokens or rows is split into pieces
by doc_id, so that no group is too large to place; there are at most 3 * ``FINE`` * shards such groups. Smaller groups
fall whole into one of ``CELLS`` * shards cells by the hash of their text; while there are fewer groups than cells, most cells
hold one. The pieces and cells, whose number does not grow with the table, are the items: largest first, each goes to
the shard where the dot product of its (bytes, tokens, rows) with the shard's residual capacity is highest, both as
shares of the table.

Only a narrow table of sizes and hashes is shuffled, the texts never.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut

FINE, CELLS = 4, 256
SLOT_ROWS = 4096
DIMENSIONS = ["size", "tokens", "rows"]


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of shares), largest item first; ties go to the smaller shard."""
    residual = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(1), kind="stable"):
        s = int(np.argmax(residual @ items[i]))
        residual[s] -= items[i]
        out[i] = s
    return out


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    size is the text's UTF-8 bytes (null: none) plus 8; tokens are runs of characters other than blanks. The law is
    ``bytes``: sizes of shards are near equal (and so are tokens and rows); grown_shard is null. slot numbers a shard's
    rows from 0 without gaps. Null and empty texts are two groups with crc32 0; repeated rows are rows of their own; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    base = cut(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.regexp_count("text", F.lit("\\S+")), F.lit(0)).cast("long").alias("tokens"), F.lit(1).cast("long").alias("rows"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(-1)).otherwise(F.xxhash64("text")).alias("key")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMENSIONS]
    total = np.maximum(np.array(base.agg(*sums).first(), float), 1)

    share = F.greatest(*[F.col(c) / float(t) for c, t in zip(DIMENSIONS, total, strict=True)]) * (FINE * shards)
    large = cut(base.groupBy("key").agg(*sums).filter(share > 1).select(F.col("key").alias("_key"), F.ceil(share).alias("pieces")))
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("pieces"))
    # an item is known by the group's hash and piece, or by -1 and its cell
    units = (base.join(F.broadcast(large), F.col("key") == F.col("_key"), "left")
             .withColumns({"a": F.when(F.col("_key").isNotNull(), F.col("key")).otherwise(F.pmod("key", F.lit(CELLS * shards))),
                           "b": F.coalesce(piece, F.lit(-1))}).drop("_key", "pieces"))
    items = units.groupBy("a", "b").agg(*sums).orderBy("a", "b").toArrow()  # bounded: see above
    where = place(np.stack([items.column(c).to_numpy() for c in DIMENSIONS], axis=1) / total, shards)
    placed = spark.createDataFrame(items.select(["a", "b"]).append_column("shard", [where.astype(np.int32)]).rename_columns(["_a", "_b", "shard"]))
    dealt = units.join(F.broadcast(placed), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))

    buckets = max(1, -(-int(total[2]) // (SLOT_ROWS * shards)))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    first = counts.select(F.col("shard").alias("_s"), F.col("bucket").alias("_k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (dealt.withColumn("nth", F.row_number().over(inside)).join(first, (F.col("shard") == F.col("_s")) & (F.col("bucket") == F.col("_k")))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
