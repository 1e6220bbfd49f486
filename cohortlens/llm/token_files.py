"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Texts are dealt out by ranges of doc_id and sorted, then encoded, so that file by file and row by row the ids stand in
ascending doc_id order. A row holds doc_id, its file's number, the ids before it in the file, and its ids. ORC writes
integers in runs, keeps minima and maxima of doc_id for every ``STRIDE`` rows and a Bloom filter beside them; readers split at
stripes, and a filter on doc_id skips the stripes and strides that cannot hold it.

Texts are cut into units (``units``), each encoded by the tokenizers library once while a task remembers it, and gathered; a
text that holds one of the tokenizer's added tokens is encoded whole.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.operators.lineage import cut, run_dir

from .blocks import text_blocks
from .pretokens import ragged
from .units import UnitIds, counted, cut_units

VOCABULARY = "byte_bpe_50k.json"
END = 2
STRIPE_BYTES, STRIDE = 16 << 20, 1000
SCHEMA = "doc_id bigint, part int, before bigint, n_tokens bigint, ids array<int>"


def added_tokens(tokenizer: str) -> list[str]:
    return [t["content"] for t in json.loads(tokenizer).get("added_tokens", [])]


def chunk_encoder(tokenizer: Tokenizer):
    """The library over many strings at once, as ``UnitIds`` asks for it."""
    return lambda texts: counted([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def id_bytes(tokenizer: Tokenizer) -> np.ndarray:
    """The number of bytes that each id stands for: a byte-level vocabulary writes a letter a byte. 0 for added tokens."""
    out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    return out


def encoded(docs: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """Rows of ``SCHEMA`` for sorted ``docs`` (doc_id, text); tokenizer is the library's JSON."""
    special = F.lit(False)
    for token in added_tokens(tokenizer):
        special = special | F.contains("text", F.lit(token))
    rows = docs.select("doc_id", F.when(special, F.col("text")).alias("_whole"), F.when(special, F.lit("")).otherwise(F.col("text")).alias("text"))
    source = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        known, part, before = Tokenizer.from_str(source.value), TaskContext.get().partitionId(), 0
        remembered = UnitIds([chunk_encoder(known)], [id_bytes(known)])
        tail = np.array([] if end is None else [end], np.int64)
        for block, raw, at in text_blocks(batches):
            start, solid = cut_units(raw, at, fine=True)
            value, out = np.zeros(0, np.int32), np.zeros(len(at), np.int64)
            if len(start):
                place = remembered(raw, start, solid)
                value, unit_end = ragged(remembered.ids[0], remembered.at[0], place)
                out = unit_end[np.searchsorted(start, at)]
            whole = block.column(1)
            if whole.null_count < len(whole):
                lists = [value[a:b] if t is None else np.array(known.encode(t, add_special_tokens=False).ids, np.int32) for a, b, t in zip(out[:-1], out[1:], whole.to_pylist(), strict=True)]
                value, out = np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])]
            n = np.diff(out) + len(tail)
            final = np.r_[0, np.cumsum(n)]
            joined = np.empty(final[-1], np.int32)
            if len(tail):
                joined[final[1:] - 1] = tail[0]
                body = np.ones(final[-1], bool)
                body[final[1:] - 1] = False
                joined[body] = value
            else:
                joined[:] = value
            yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(before + final[:-1]), pa.array(n),
                                              pa.ListArray.from_arrays(pa.array(final.astype(np.int32)), pa.array(joined))], ["doc_id", "part", "before", "n_tokens", "ids"])
            before += int(final[-1])

    return rows.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END) -> None:
    """Encode ``docs`` (doc_id, text) and write the files to ``path``, which must not exist.

    Null and empty texts have the end id alone. Rows that repeat a doc_id stand side by side, by the hash of their
    text; a null doc_id comes first. ``tokenizer`` is the path of a byte-level vocabulary whose pattern ends a match before a
    space that follows no white space.
    """
    with open(tokenizer or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        source = f.read()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    (encoded(ordered, source, end).write.option("compression", "zstd").option("orc.stripe.size", str(STRIPE_BYTES))
     .option("orc.row.index.stride", str(STRIDE)).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: start is the number of ids of all rows before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    offset = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    # a row a file, written: Spark sees how small it is and leaves the ids where they are
    return rows.join(cut(offset), F.col("part") == F.col("_part")).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents: stripes and strides that cannot hold them are not read."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            at = column.offsets.to_numpy()
            raw = column.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def fresh_path(spark: SparkSession) -> str:
    return f"{run_dir(spark)}/tokens-{uuid.uuid4().hex}"
