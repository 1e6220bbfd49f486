"""Language identification with a linear-chain conditional random field over words.

Words are runs of letters. Each has features: its beginnings and ends of 1 to 3 bytes, its byte pairs and triples,
and itself as a lexicon entry; all are rows of one hashed table with a weight per language. Rows that never occurred in training
weigh nothing, so the lexicon holds training words only. Learned transitions tie neighbouring words together. A chain is a
line of text, or at most ``CHAIN`` words of a longer line; forward-backward gives each word a probability per language, so the
words of code-switched text are labelled one by one. A text's language has the largest mean probability over its words.

Fitting runs on the driver over a bounded sample: of each language ``per_lang`` rows, those with the smallest hashed
text, among texts of at most ``fit_bytes`` bytes. Half of the training chains are spliced from chains of two languages, so
that transitions learn to switch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import U64, Words, text_blocks
from .toxicity import held_out

ROWS = 1 << 17
CHAIN = 64
UNKNOWN = "und"
BLOCK = 2 << 20


def features(words: Words, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, table row) of all features, in word order."""
    done = []
    for lo in range(0, len(start), 16384):  # bounded temporaries
        s, e = start[lo: lo + 16384], end[lo: lo + 16384]
        length, index = e - s, np.arange(len(s))
        who, row = [index], [words.hashes(sums, s, e, 70)]
        for n in (1, 2, 3):
            w = np.flatnonzero(length >= n)
            who += [w, w]
            row += [words.hashes(sums, s[w], s[w] + n, 70 + n), words.hashes(sums, e[w] - n, e[w], 80 + n)]
        for n in (2, 3):
            many = np.maximum(length - n + 1, 0)
            w = np.repeat(index, many)
            at = s[w] + np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)
            who.append(w)
            row.append(words.hashes(sums, at, at + n, 90 + n))
        who, row = np.concatenate(who), np.concatenate(row)
        order = np.argsort(who, kind="stable")
        done.append(((who[order] + lo).astype(np.int32), (row[order] & U64(ROWS - 1)).astype(np.int32)))
    return tuple(np.concatenate([d[i] for d in done] or [np.zeros(0, np.int32)]) for i in (0, 1))


class Chains:
    """The words of a block of texts: distinct words with features, and the chains over the word sequence."""

    def __init__(self, words: Words, raw: np.ndarray, at: np.ndarray):
        self.doc, start, end, sums, b = words(raw, at)
        _, first, self.word = np.unique(words.hashes(sums, start, end), return_index=True, return_inverse=True)
        self.distinct = len(first)
        self.who, self.row = features(words, sums, start[first], end[first])
        n = len(start)
        line = np.cumsum(raw == 10)[start] if n else start
        new = np.ones(n, bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (line[1:] != line[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else start
        new |= (np.arange(n) - head) % CHAIN == 0
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.begin, n])
        letter = ((b | 32) >= 97) & ((b | 32) <= 122)
        self.ascii_letters = np.diff(np.r_[0, np.cumsum(letter)][at])

    def laid_out(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions x chains) places in the word sequence, and the mask of filled ones."""
        place = np.arange(int(self.size[some].max()))[:, None]
        mask = place < self.size[some]
        return np.minimum(self.begin[some] + place, len(self.word) - 1), mask


class Field:
    """Weights: emit (table row x label), move (label x label), first (label)."""

    def __init__(self, emit, move, first):
        self.emit, self.move, self.first = emit, move, first

    def potentials(self, chains: Chains) -> np.ndarray:
        """exp of each distinct word's feature scores, scaled to a largest of 1."""
        head = np.searchsorted(chains.who, np.arange(chains.distinct + 1))
        out = np.empty((chains.distinct, self.emit.shape[1]), np.float32)
        for lo in range(0, chains.distinct, 1 << 15):
            hi = min(chains.distinct, lo + (1 << 15))
            out[lo:hi] = np.add.reduceat(self.emit[chains.row[head[lo]: head[hi]]], head[lo:hi] - head[lo])
        return np.exp(np.maximum(out - out.max(1, keepdims=True), -30))

    def forward_backward(self, e: np.ndarray, mask: np.ndarray, pairs: bool = False):
        """Marginals (positions x chains x labels); with ``pairs`` also the summed pair marginals."""
        a = np.exp(self.move)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        alpha[0] = e[0] * np.exp(self.first)
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for t in range(1, len(e)):
            alpha[t] = (alpha[t - 1] @ a) * e[t]
            alpha[t] /= alpha[t].sum(1, keepdims=True)
        for t in range(len(e) - 2, -1, -1):
            b = (e[t + 1] * beta[t + 1]) @ a.T
            beta[t] = np.where(mask[t + 1][:, None], b / b.sum(1, keepdims=True), 1)
        both = alpha * beta
        both /= both.sum(2, keepdims=True)
        if not pairs:
            return both
        total = np.zeros_like(a)
        for t in range(1, len(e)):
            right = e[t] * beta[t]
            z = ((alpha[t - 1] @ a) * right).sum(1)
            ok = mask[t]
            total += (alpha[t - 1][ok] / z[ok][:, None]).T @ right[ok] * a
        return both, total

    def word_probabilities(self, chains: Chains) -> np.ndarray:
        """Each word's probability per label, in text order."""
        out = np.empty((len(chains.word), self.emit.shape[1]), np.float32)
        e = self.potentials(chains)
        order = np.argsort(chains.size, kind="stable")
        for lo in range(0, len(order), 4096):  # chains of like length together
            place, mask = chains.laid_out(order[lo: lo + 4096])
            out[place[mask]] = self.forward_backward(e[chains.word[place]], mask)[mask]
        return out


def fit(texts: list[str], langs: list[str], epochs: int = 6, batch: int = 256, rate: float = 0.5, seed: int = 7) -> tuple[list[str], Field]:
    """(labels, field) from whole texts of one language each."""
    labels = sorted(set(langs))
    n = max(1, len(labels))
    field = Field(np.zeros((ROWS, n), np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32))
    raw = [t.encode() for t in texts]
    chains = Chains(Words("letters", latin=True), np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64))
    if len(labels) < 2 or not len(chains.word):
        return labels, field
    y_doc = np.array([labels.index(x) for x in langs])
    head = np.searchsorted(chains.who, np.arange(chains.distinct + 1))
    r = np.random.default_rng(seed)
    seen = [np.full_like(w, 1e-3) for w in (field.emit, field.move, field.first)]
    for _ in range(epochs):
        order = r.permutation(len(chains.begin))
        for lo in range(0, len(order), batch):
            some = order[lo: lo + batch]
            place, mask = chains.laid_out(some)
            word, y = chains.word[place], y_doc[chains.doc[place]]
            half = len(some) // 2  # these go on with the next chain after their middle
            if half > 1:
                middle = (chains.size[some[:half]] // 2)[None, :]
                after = np.arange(len(place))[:, None] >= middle
                word[:, :half], y[:, :half] = (np.where(after & np.roll(mask[:, :half], 1, 1), np.roll(v[:, :half], 1, 1), v[:, :half]) for v in (word, y))
            used, at = np.unique(word, return_inverse=True)
            many = head[used + 1] - head[used]
            rows = chains.row[np.repeat(head[used] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            owner = np.repeat(np.arange(len(used)), many)
            score = np.stack([np.bincount(owner, field.emit[rows, j], minlength=len(used)) for j in range(n)], axis=1)
            e = np.exp(np.maximum(score - score.max(1, keepdims=True), -30)).astype(np.float32)[at.reshape(word.shape)]
            p, pair = field.forward_backward(e, mask, pairs=True)
            gold = np.eye(n, dtype=np.float32)[y]
            miss = (gold - p) * mask[:, :, None]
            by_word = np.stack([np.bincount(at.ravel(), miss[:, :, j].ravel(), minlength=len(used)) for j in range(n)], axis=1)
            touched, back = np.unique(rows, return_inverse=True)
            g_emit = np.stack([np.bincount(back, by_word[owner, j], minlength=len(touched)) for j in range(n)], axis=1)
            ok = mask[1:]
            g_move = np.zeros((n, n))
            np.add.at(g_move, (y[:-1][ok], y[1:][ok]), 1)
            for w, s, g, at_rows in ((field.emit, seen[0], g_emit / len(some), touched), (field.move, seen[1], (g_move - pair) / len(some), slice(None)),
                                     (field.first, seen[2], miss[0].sum(0) / len(some), slice(None))):
                s[at_rows] += g * g
                w[at_rows] += (rate * g / np.sqrt(s[at_rows])).astype(np.float32) - 1e-4 * w[at_rows]
    return labels, field


def train(docs: DataFrame, per_lang: int = 300, fit_bytes: int = 6_000) -> tuple[list[str], Field]:
    """Learn from rows with text and lang outside the held-out quarter; copies count once. At most ``per_lang`` rows a language."""
    rows = (docs.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.octet_length("text").alias("b"))
            .filter(F.col("lang").isNotNull() & (F.col("b") <= fit_bytes) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).groupBy("lang", "h").agg(F.min("doc_id").alias("_doc")))
    first = Window.partitionBy("lang").orderBy("h", "_doc")
    chosen = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_lang).select("_doc", "h", F.col("lang").alias("_lang"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("h"))).select("h", "text", "_lang").collect()
    sample = sorted({tuple(r) for r in sample})
    return fit([r[1] for r in sample], [r[2] for r in sample])


def label_languages(docs: DataFrame, labels: list[str], field: Field, words: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; with ``words`` also labels array<string>, one for each word.

    score is the mean word probability of the predicted language; ties go to the first label in order. A null text or
    one without letters is ``und`` with score 0, and so is every text if no language was learned.
    """
    weights = docs.sparkSession.sparkContext.broadcast((field.emit, field.move, field.first))
    names = np.array([*labels, UNKNOWN], object)

    def run(batches):
        model, split = Field(*weights.value), Words("letters", latin=True)
        for rows, raw, at in text_blocks(batches, limit=BLOCK):
            chains = Chains(split, raw, at)
            n = rows.num_rows
            count = np.bincount(chains.doc, minlength=n)
            mean, p = np.zeros((n, max(1, len(labels)))), None
            if len(chains.word) and labels:
                p = model.word_probabilities(chains)
                mean = np.stack([np.bincount(chains.doc, p[:, j], minlength=n) for j in range(len(labels))], axis=1) / np.maximum(count, 1)[:, None]
            known = (chains.ascii_letters > 0) & bool(labels)
            for i in np.flatnonzero(~known & (count > 0) & bool(labels)):  # letters beyond ASCII, if any
                known[i] = any(c.isalpha() for c in raw[at[i]: at[i + 1]].tobytes().decode("utf-8", "replace"))
            best = np.where(known, mean.argmax(1), len(labels))
            score = np.where(known, np.minimum(mean.max(1), 1.0), 0.0)
            out = [rows.column(0).cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score)]
            if words:
                each = names[p.argmax(1)] if p is not None else np.full(len(chains.word), UNKNOWN, object)
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(each, pa.string())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "labels"][: len(out)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double" + (", labels array<string>" if words else ""))
