"""Text columns as byte blocks: words and their hashes with numpy, inside Arrow tasks.

A task sees its rows as Arrow batches. ``text_blocks`` hands them on in blocks of a few megabytes (a longer
text is a block of its own), and ``words`` finds every word of a block with whole-array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ U64(salt * 0xD6E8FEB86659FD93 % (1 << 64))).astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; a null row is an empty span."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (or one row): (rows, bytes, offsets from 0)."""
    for batch in batches:
        raw, at = spans(batch.column(batch.schema.get_field_index(column)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
            lo = hi
        del raw, batch
        pa.default_memory_pool().release_unused()  # the worker lives on


def table(keep: str, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, folded byte) for each byte value. keep: 'blank' splits at [\\x20\\x09-\\x0D] only, 'alnum' keeps
    ASCII letters, digits and all bytes of other characters, 'letters' is the same without digits."""
    values = np.arange(256)
    upper = (values >= 65) & (values <= 90)
    letters = upper | ((values >= 97) & (values <= 122)) | (values >= 128)
    if keep == "blank":
        word = ~((values == 32) | ((values >= 9) & (values <= 13)))
    elif keep == "alnum":
        word = letters | ((values >= 48) & (values <= 57))
    else:
        word = letters
    return word, np.where(upper & lower, values + 32, values).astype(np.uint8)


class Words:
    """Word positions and hashes of byte blocks. One object serves a task and keeps its power tables.

    ``latin`` also folds the capitals of the Latin-1 letters (two bytes, first C3).
    """

    def __init__(self, keep: str, latin: bool = False):
        self.word, self.fold = table(keep)
        self.latin = latin
        self.up = self.down = np.ones(1, U64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 2)
            for name, base in (("up", BASE), ("down", INVERSE)):
                p = np.full(n, base, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U64))

    def folded(self, raw: np.ndarray) -> np.ndarray:
        b = self.fold[raw]
        if self.latin and len(b):
            capital = (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
            capital[1:] &= b[:-1] == 0xC3
            capital[0] = False
            b = np.where(capital, b + 0x20, b).astype(np.uint8)
        return b

    def __call__(self, raw: np.ndarray, at: np.ndarray):
        """(document index, start, end, prefix sums, folded bytes) of the words, in text order."""
        n = len(raw)
        b = self.folded(raw)
        inside = self.word[b]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        heads = at[:-1]
        before[heads[heads < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        tails = at[1:] - 1
        after[tails[tails >= 0]] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        doc = np.searchsorted(at, start, "right") - 1
        self.powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((b.astype(U64) + U64(1)) * self.up[:n], out=sums[1:])
        return doc, start, end, sums, b

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hashes of the byte ranges [start, end): equal bytes, equal hash, wherever they stand."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U64), salt)


def grouped_order(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Indices that sort by (group, value); groups are small integers."""
    first = np.argsort(value)
    g = group[first]
    return first[np.argsort(g.astype(np.uint16) if len(g) == 0 or g.max() < 65536 else g, kind="stable")]
