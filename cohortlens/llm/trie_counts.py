"""Token counts under a unigram model: one dynamic programme over a trie of the distinct pre-tokens.

A token's probability follows Zipf's law in the rank of a public vocabulary, p(r) = 1 / (Z * (r + 2)); no model is trained. The best
segmentation of a pre-token minimises the sum of weights, 4096 * round(65536 * -ln p) + 1: whole numbers, so that sums are exact
and equal probabilities go to fewer tokens; what is still equal goes to the shorter last token.

The distinct pre-tokens of a block are inserted in a trie, all at once and level by level. A node's best forward
score needs its ancestors' scores and the tokens that end at it, so it is found once, whatever the number of pre-tokens
through it; the count at a pre-token's last node is its token count. Texts add up the counts of their pre-tokens. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import BASE, U64, mix, spans
from .merge_replay import read_ranks
from .pretokens import piece_blocks, with_pretokens

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG = 128  # bytes; longer pre-tokens share no prefixes worth a level of their own
BITS = 1 << 22


def weights(ranks: dict[bytes, int]) -> dict[bytes, int]:
    z = float(np.sum(1 / (np.array(sorted(ranks.values())) + 2.0)))
    return {t: 4096 * round(65536 * float(np.log(z * (r + 2)))) + 1 for t, r in ranks.items()}


def token_table(weight: dict[bytes, int]) -> dict:
    """Hashes (sorted) and weights of the tokens, a bitmap of the hashes, and the tokens' lengths."""
    hashes = np.zeros(len(weight), np.uint64)
    for i, token in enumerate(weight):
        h = 0
        for b in token:
            h = (h * BASE + b + 1) % (1 << 64)
        hashes[i] = h
    hashes = mix(hashes)
    order = np.argsort(hashes)
    bitmap = np.zeros(BITS, bool)
    bitmap[(hashes & U64(BITS - 1)).astype(np.int64)] = True
    return {"hash": hashes[order], "weight": np.array(list(weight.values()), np.int64)[order], "bitmap": np.packbits(bitmap, bitorder="little"), "longest": max(map(len, weight))}


def found(table: dict, h: np.ndarray) -> np.ndarray:
    """The weight of the token with each hash, -1 where there is none."""
    h = mix(h)
    out = np.full(len(h), -1, np.int64)
    slot = (h & U64(BITS - 1)).astype(np.int64)
    maybe = np.flatnonzero((table["bitmap"][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
    at = np.minimum(np.searchsorted(table["hash"], h[maybe]), len(table["hash"]) - 1)
    hit = table["hash"][at] == h[maybe]
    out[maybe[hit]] = table["weight"][at[hit]]
    return out


def singly(word: bytes, weight: dict[bytes, int], longest: int) -> tuple[int, int]:
    """(weight, tokens) of one pre-token by the definition."""
    best, count = [0], [0]
    for end in range(1, len(word) + 1):
        low, n = None, 0
        for k in range(1, min(end, longest) + 1):
            w = weight.get(word[end - k: end])
            if w is not None and (low is None or best[end - k] + w < low):
                low, n = best[end - k] + w, count[end - k] + 1
        best.append(low)
        count.append(n)
    return best[-1], count[-1]


def terminal_counts(raw: np.ndarray, at: np.ndarray, table: dict, weight: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(weight, tokens) of the pre-tokens raw[at[i]:at[i+1]], through their trie."""
    length = np.diff(at)
    cost, count = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for i in np.flatnonzero(length > LONG):
        cost[i], count[i] = singly(raw[at[i]: at[i + 1]].tobytes(), weight, table["longest"])
    active = np.flatnonzero((length > 0) & (length <= LONG))
    node = np.zeros(len(active), np.int64)  # in the level above
    # per level: parent in the level above, prefix hash, best weight, tokens
    parent, prefix = [np.zeros(1, np.int64)], [np.zeros(1, U64)]
    best, tokens = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    power = np.cumprod(np.r_[U64(1), np.full(LONG, BASE, U64)], dtype=U64)
    depth = 0
    while len(active):
        depth += 1
        key = node * 256 + raw[at[active] + depth - 1]
        unique, node = np.unique(key, return_inverse=True)
        up = unique >> 8
        h = prefix[-1][up] * U64(BASE) + (unique & 255).astype(U64) + U64(1)
        low, n = np.full(len(unique), np.iinfo(np.int64).max), np.zeros(len(unique), np.int64)
        above = up
        for k in range(1, min(depth, table["longest"]) + 1):
            level = depth - k
            w = found(table, h - prefix[level][above] * power[k])
            hit = np.flatnonzero(w >= 0)
            total = best[level][above[hit]] + w[hit]
            better = total < low[hit]
            hit = hit[better]
            low[hit], n[hit] = total[better], tokens[level][above[hit]] + 1
            above = parent[level][above]
        parent.append(up), prefix.append(h), best.append(low), tokens.append(n)
        ends = length[active] == depth
        cost[active[ends]], count[active[ends]] = low[node[ends]], n[node[ends]]
        active, node = active[~ends], node[~ends]
    return cost, count


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, weight) for every row: counts of the whole text and the summed weight of its segmentation.

    Null and empty texts have zeros; repeated rows get equal results; other columns are ignored. The vocabulary is a rank
    file that holds every single byte.
    """
    weight = weights(read_ranks(path or public_tokenizers.path(VOCABULARY)))
    shared = docs.sparkSession.sparkContext.broadcast((token_table(weight), weight))

    def run(batches):
        table, by_token = shared.value
        for rows, pieces, number, at in piece_blocks(batches):
            raw, piece_at = spans(pieces)
            cost, count = terminal_counts(raw[piece_at[0]: piece_at[-1]], piece_at - piece_at[0], table, by_token)
            totals = [np.r_[0, np.cumsum(x[number])] for x in (count, cost)]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(np.diff(at)), *[pa.array(np.diff(t[at])) for t in totals]],
                                             ["doc_id", "n_pretokens", "n_tokens", "weight"])

    return with_pretokens(docs, pattern, "doc_id").mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint, weight bigint")
