"""Pre-tokens: the pieces that a byte-level tokenizer's pattern cuts a text into, before any merge.

The pattern runs in Spark (``regexp_extract_all``) and the pieces reach Python as Arrow lists. A task numbers the
distinct pieces of a few megabytes of text and gives each its ids once; texts are then gathered from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = 1 << 19  # at a time


def pretokens(text: Column, pattern: str) -> Column:
    """All matches in order; null counts as empty. (?U) gives \\s its Unicode meaning, as the libraries do."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def with_pretokens(docs: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """Columns ``keep`` and, last, the pre-tokens under a name that none of them has."""
    name = "_pieces"
    while name in {c.lower() for c in keep}:
        name += "_"
    return docs.select(*keep, pretokens(F.col("text"), pattern).alias(name))


def piece_blocks(batches: Iterator[pa.RecordBatch], limit: int = PIECES) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """(rows, distinct pieces, number of each piece in text order, n+1 offsets of the rows) for slices with at
    most ``limit`` pieces, or one row."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        at = column.offsets.to_numpy().astype(np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1), batch.num_rows)
            coded = column.values.slice(at[lo], at[hi] - at[lo]).dictionary_encode()
            yield batch.slice(lo, hi - lo), coded.dictionary, coded.indices.to_numpy(), at[lo: hi + 1] - at[lo]
            lo = hi
        del column, batch
        pa.default_memory_pool().release_unused()  # the worker lives on


def ragged(values: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``pick`` of a ragged array (values, offsets), side by side, and the offsets of the result."""
    length = at[pick + 1] - at[pick]
    out = np.r_[0, np.cumsum(length)]
    index = np.arange(out[-1]) + np.repeat(at[pick] - out[:-1], length)
    return values[index], out
