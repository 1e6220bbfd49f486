"""Byte-level BPE by merge replay over a corpus of words.

A task's distinct pre-tokens lie side by side as one row of symbols with links to their neighbours. An inverted index
keeps, for each merge rank, the positions whose symbol and its right neighbour form that merge. The ranks are
replayed in order: each takes all its positions in all words at once, and only the two neighbours of a merged
place get a new pair and a new entry in the index. A word's ids are found once, however often it stands in the task's
texts.

A vocabulary's ranks may let a merge create a pair of lower rank; a word where that happens leaves the replay
and is merged by itself, lowest rank first and leftmost first, which is the definition.

Every task is its own corpus of at most ``pretokens.PIECES`` pieces: no text or word is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .blocks import spans
from .pretokens import piece_blocks, ragged, with_pretokens

NONE = np.iinfo(np.int32).max
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Vocabulary:
    """The tokens of a rank file as arrays: bytes by id, the id of each byte, and all pairs that form a token."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.at = np.r_[0, np.cumsum([len(t) for t in by_id])]
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[t[:i]] * size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.size = size
        self.pair, self.rank = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)

    @classmethod
    def of(cls, arrays: dict) -> Vocabulary:
        """The same from its arrays: those are what a broadcast carries."""
        self = cls.__new__(cls)
        self.__dict__.update(arrays)
        return self

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of symbols merges to, NONE where it is no token."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NONE)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def alone(vocabulary: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """One word by the definition: the lowest rank, leftmost, again and again."""
    s = symbols.copy()
    while len(s) > 1:
        r = vocabulary.merged(s[:-1], s[1:])
        i = int(r.argmin())
        if r[i] == NONE:
            break
        s = np.r_[s[:i], r[i], s[i + 2:]]
    return s


def replay(vocabulary: Vocabulary, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the words whose bytes are raw[at[i]:at[i+1]]."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), at.copy()
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    token = vocabulary.of_byte[raw]
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = at[:-1] < at[1:]
    left[at[:-1][filled]] = -1
    right[at[1:][filled] - 1] = n
    rank = np.full(n, NONE, np.int32)  # of the pair that starts here
    inner = np.flatnonzero(right < n)
    rank[inner] = vocabulary.merged(token[inner], token[inner + 1])
    alive = np.ones(n, bool)
    odd = np.zeros(len(at) - 1, bool)

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[int] = []

    def enter(places: np.ndarray) -> None:
        if not len(places):
            return
        r = rank[places]
        order = np.argsort(r, kind="stable")
        places, r = places[order], r[order]
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        for value, lo, hi in zip(r[head].tolist(), head.tolist(), np.r_[head[1:], len(r)].tolist(), strict=True):
            if value not in index:
                heapq.heappush(queue, value)
            index[value].append(places[lo:hi])

    enter(inner[rank[inner] != NONE])
    while queue:
        now = heapq.heappop(queue)
        places = np.concatenate(index.pop(now))
        places = np.unique(places[(rank[places] == now) & alive[places]]) if len(places) > 1 else places[(rank[places] == now) & alive[places]]
        if not len(places):
            continue
        after = right[places]
        if len(places) > 1 and (after[:-1] == places[1:]).any():  # a run like aaaa: every second place of it
            chained = np.r_[False, after[:-1] == places[1:]]
            start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
            places = places[(np.arange(len(places)) - start) % 2 == 0]
            after = right[places]
        beyond = right[after]
        token[places] = now
        right[places] = beyond
        alive[after] = False
        rank[after] = NONE
        tail = beyond < n
        left[beyond[tail]] = places[tail]
        rank[places] = NONE
        rank[places[tail]] = vocabulary.merged(token[places[tail]], token[beyond[tail]])
        before = left[places]
        before = before[before >= 0]
        rank[before] = vocabulary.merged(token[before], token[right[before]])
        touched = np.unique(np.concatenate([before, places[tail]]))
        touched = touched[rank[touched] != NONE]
        low = touched[rank[touched] < now]
        if len(low):  # out of order: these words are merged alone
            odd[word[low]] = True
        enter(touched[~odd[word[touched]]])
    kept = np.flatnonzero(alive)
    count = np.bincount(word[kept], minlength=len(at) - 1)
    ids, out = token[kept], np.r_[0, np.cumsum(count)]
    if odd.any():
        parts = [alone(vocabulary, vocabulary.of_byte[raw[at[i]: at[i + 1]]]) if odd[i] else ids[out[i]: out[i + 1]] for i in range(len(odd))]
        ids, out = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
    return ids, out


def decoded_rows(known: Vocabulary, ids: np.ndarray, row_at: np.ndarray) -> pa.Array:
    """The bytes that each row's ids stand for; a few rows at a time."""
    parts = []
    for lo in range(0, len(row_at) - 1, 256):
        at = row_at[lo: lo + 257]
        text, end = ragged(known.bytes, known.at, ids[at[0]: at[-1]].astype(np.int64))
        part = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(end[at - at[0]]), pa.py_buffer(text)])
        parts.append(part.cast(pa.binary()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, and_decode: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, plus n_tokens and ids (little-endian unsigned 32-bit, binary).

    Each match of ``pattern`` is encoded separately with the ranks of the file; special tokens are ordinary text. A null
    or empty text has no ids. Columns named n_tokens or ids are replaced. ``and_decode`` adds ``decoded`` as ``decode`` does, in
    the same pass: a task then holds one Python worker, not two.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(read_ranks(path or public_tokenizers.path(VOCABULARY)))))
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", *(["decoded"] if and_decode else []))]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        known = Vocabulary.of(vocabulary.value)
        for rows, pieces, number, at in piece_blocks(batches):
            raw, piece_at = spans(pieces)
            ids, ids_at = replay(known, raw[piece_at[0]: piece_at[-1]], piece_at - piece_at[0])
            value, end = ragged(ids.astype("<u4"), ids_at, number)
            row_at = end[at]
            back = [decoded_rows(known, value, row_at)] if and_decode else []
            packed = pa.Array.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer(row_at * 4), pa.py_buffer(value)])
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(np.diff(row_at)), packed.cast(pa.binary()), *back], [*rows.schema.names[:-1], "n_tokens", "ids", *["decoded"][: len(back)]])

    return with_pretokens(docs, pattern, *keep).mapInArrow(run, f"{fields}, n_tokens bigint, ids binary" + (", decoded binary" if and_decode else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes its ids stand for, as binary column ``decoded``; null ids give null."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(vars(Vocabulary(read_ranks(path or public_tokenizers.path(VOCABULARY)))))
    keep = [c for c in encoded.columns if c != "decoded"]
    place = keep.index("ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema.fields)

    def run(batches):
        known = Vocabulary.of(vocabulary.value)
        for batch in batches:
            raw, at = spans(batch.column(place))
            ids = np.frombuffer(raw[at[0]: at[-1]].tobytes(), "<u4")
            column = decoded_rows(known, ids, (at - at[0]) // 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "decoded"])

    return encoded.select(*keep).mapInArrow(run, f"{fields}, decoded binary")
