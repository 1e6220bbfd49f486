"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two learned vectors side by side: the mean of its character n-gram vectors (n-grams of 3 to 5 bytes
and the word's beginnings and ends) and the vector of the word itself, both from hashed tables. Two gated recurrent
layers read a window of words in both directions, attention weighs the positions, and a logistic unit scores the
window. Windows of 64 words begin every 32 words; all of a text are scored, and the text's score is the largest.

Fitting runs on the driver over a bounded sample of labelled rows: ``per_class`` toxic rows and twice as many others, those
with the smallest hashed text, among texts of at most ``fit_bytes`` bytes. Labels are known for whole texts only, so each
epoch scores all windows of the sample and learns from the highest window of each text. Scoring runs in Arrow tasks
over every row, with the weights as one broadcast of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import U64, Words, mix, text_blocks

WINDOW, STRIDE = 64, 32  # words: any 33 neighbours stand together in a window
CHARS, WORDS_ = 1 << 17, 1 << 16  # rows of the hashed tables
WIDTH, HIDDEN = 6, 8  # of each table; of each direction
THRESHOLD = 0.3
BLOCK = 2 << 20
SUB = 2048  # windows at a time


def pieces(words: Words, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, table row) of all character n-grams of the words, in word order."""
    done = [_pieces(words, sums, start[lo: lo + 8192], end[lo: lo + 8192], lo) for lo in range(0, len(start), 8192)]  # bounded temporaries
    return tuple(np.concatenate([d[i] for d in done] or [np.zeros(0, np.int32)]) for i in (0, 1))


def _pieces(words: Words, sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    length = end - start
    who, row = [], []
    index = np.arange(len(start))
    for n in (3, 4, 5):
        count = np.maximum(length - n + 1, 0)
        w = np.repeat(index, count)
        lo = start[w] + np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        who.append(w)
        row.append(words.hashes(sums, lo, lo + n, n))
    for n in (2, 3, 4, 5, 6):
        w = np.flatnonzero(length >= n)
        who += [w, w]
        row += [words.hashes(sums, start[w], start[w] + n, 20 + n), words.hashes(sums, end[w] - n, end[w], 40 + n)]
    w = np.flatnonzero(length < 2)
    who.append(w)
    row.append(words.hashes(sums, start[w], end[w], 60))
    who, row = np.concatenate(who), np.concatenate(row)
    order = np.argsort(who, kind="stable")
    return (who[order] + base).astype(np.int32), (row[order] & U64(CHARS - 1)).astype(np.int32)


class Some:
    """Some windows of a block, with only the words in them."""

    def __init__(self, block: Block, windows: np.ndarray):
        index, self.mask = block.picked(windows)
        used, at = np.unique(index, return_inverse=True)
        self.index, self.word_row = at.reshape(index.shape), block.word_row[used]
        head = np.searchsorted(block.piece_word, np.r_[used, used + 1])
        lo, many = head[: len(used)], head[len(used):] - head[: len(used)]
        self.piece_word = np.repeat(np.arange(len(used)), many)
        self.piece_row = block.piece_row[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]


class Block:
    """A block of texts: its distinct words with their table rows, and the windows over its word sequence."""

    def __init__(self, words: Words, raw: np.ndarray, at: np.ndarray):
        doc, start, end, sums, _ = words(raw, at)
        h = words.hashes(sums, start, end)
        _, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.word_row = (h[first] & U64(WORDS_ - 1)).astype(np.int64)
        self.piece_word, self.piece_row = pieces(words, sums, start[first], end[first])
        n_docs = len(at) - 1
        count = np.bincount(doc, minlength=n_docs)
        base = np.cumsum(count) - count
        # a window every STRIDE words while it brings words that the one before did not reach; every text has one
        windows = np.maximum(1, 1 + -(-(count - WINDOW) // STRIDE))
        self.owner = np.repeat(np.arange(n_docs), windows)
        nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.begin = base[self.owner] + nth * STRIDE
        self.size = np.clip(count[self.owner] - nth * STRIDE, 0, WINDOW)
        self.head = np.cumsum(windows) - windows

    def picked(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions x windows) distinct-word indices, and the mask of filled places."""
        place = np.arange(WINDOW)[:, None]
        mask = place < self.size[windows]
        if not len(self.word):
            return np.zeros(mask.shape, np.int64), mask
        return self.word[np.minimum(self.begin[windows] + place, len(self.word) - 1)], mask


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights and their use. Gates of a direction: update, reset, candidate."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        def f(*s, scale=0.1):
            return (r.standard_normal(s) * scale).astype(np.float32)
        w = {"chars": f(CHARS, WIDTH), "words": f(WORDS_, WIDTH), "attend": f(2 * HIDDEN), "out": f(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            w |= {f"x{d}": f(2 * WIDTH, 3 * HIDDEN, scale=0.4), f"h{d}": f(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(w)

    def inputs(self, block: Block) -> np.ndarray:
        """The input vector of each distinct word."""
        n = len(block.word_row)
        out = np.zeros((n, 2 * WIDTH), np.float32)
        if n:
            head = np.searchsorted(block.piece_word, np.arange(n))
            many = np.bincount(block.piece_word, minlength=n)[:, None]
            for lo in range(0, n, 1 << 15):  # bounded temporaries
                hi = min(n, lo + (1 << 15))
                end = head[hi] if hi < n else len(block.piece_row)
                out[lo:hi, :WIDTH] = np.add.reduceat(self.w["chars"][block.piece_row[head[lo]: end]], head[lo:hi] - head[lo]) / many[lo:hi]
            out[:, WIDTH:] = self.w["words"][block.word_row]
        return out

    def direction(self, d: str, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Hidden states (positions x windows x HIDDEN); with ``keep`` also the gates, for learning."""
        t_all = range(len(index)) if d == "f" else range(len(index) - 1, -1, -1)
        h = np.zeros((index.shape[1], HIDDEN), np.float32)
        u, states, gates = self.w[f"h{d}"], np.empty((*index.shape, HIDDEN), np.float32), {}
        for t in t_all:
            g, a = x[index[t]], h @ u
            zr = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])))
            c = np.tanh(g[:, 2 * HIDDEN:] + zr[:, HIDDEN:] * a[:, 2 * HIDDEN:])
            if keep:
                gates[t] = (h, a[:, 2 * HIDDEN:], zr, c)
            h = h + zr[:, :HIDDEN] * (c - h) * mask[t][:, None]
            states[t] = h
        return (states, gates) if keep else states

    def projected(self, block: Block) -> dict[str, np.ndarray]:
        x = self.inputs(block)
        return {d: x @ self.w[f"x{d}"] + self.w[f"c{d}"] for d in "fb"} if len(x) else {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        e = np.where(mask, states @ self.w["attend"], -1e9)
        a = np.exp(e - e.max(0)) * mask
        a = a / np.maximum(a.sum(0), 1e-9)
        return a, (a[:, :, None] * states).sum(0)

    def window_logits(self, block: Block) -> np.ndarray:
        x = self.projected(block)
        out = np.empty(len(block.owner), np.float32)
        order = np.argsort(-block.size, kind="stable")  # full windows together, short ones together
        for lo in range(0, len(order), SUB):
            some = order[lo: lo + SUB]
            index, mask = block.picked(some)
            top = max(1, int(block.size[some[0]]))
            index, mask = index[:top], mask[:top]
            states = np.concatenate([self.direction(d, x[d], index, mask) for d in "fb"], axis=2)
            out[some] = self.pooled(states, mask)[1] @ self.w["out"] + self.w["bias"]
        return out

    def scores(self, block: Block) -> np.ndarray:
        return sigmoid(np.maximum.reduceat(self.window_logits(block), block.head).astype(np.float64))

    def gradients(self, block: Block, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over the windows; tables as (rows, values)."""
        w, n = self.w, len(windows)
        block = Some(block, windows)
        x, index, mask = self.inputs(block), block.index, block.mask
        proj = {d: x @ w[f"x{d}"] + w[f"c{d}"] for d in "fb"}
        run = {d: self.direction(d, proj[d], index, mask, keep=True) for d in "fb"}
        states = np.concatenate([run[d][0] for d in "fb"], axis=2)
        a, pool = self.pooled(states, mask)
        err = (sigmoid(pool @ w["out"] + w["bias"]) - y).astype(np.float32) / n
        g = {"out": pool.T @ err, "bias": np.array([err.sum()], np.float32)}
        dpool = err[:, None] * w["out"]
        da = (states * dpool).sum(2)
        de = a * (da - (a * da).sum(0))
        g["attend"] = np.einsum("tbh,tb->h", states, de)
        dstates = a[:, :, None] * dpool + de[:, :, None] * w["attend"]
        dproj = {}
        for k, d in enumerate("fb"):
            ds = dstates[:, :, k * HIDDEN: (k + 1) * HIDDEN]
            gates, u, dh = run[d][1], w[f"h{d}"], np.zeros((n, HIDDEN), np.float32)
            du, dx = np.zeros_like(u), np.zeros((*index.shape, 3 * HIDDEN), np.float32)
            for t in (range(len(index) - 1, -1, -1) if d == "f" else range(len(index))):
                h, ac, zr, c = gates[t]
                m = mask[t][:, None]
                total = dh + ds[t]
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                dz = total * (c - h) * m * z * (1 - z)
                dc = total * z * m * (1 - c * c)
                dr = dc * ac * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dc], axis=1)
                inner = np.concatenate([dz, dr, dc * r], axis=1)
                du += h.T @ inner
                dh = total * (1 - z * m) + inner @ u.T
            g[f"h{d}"] = du
            flat = index.ravel()
            dproj[d] = np.stack([np.bincount(flat, dx[:, :, j].ravel(), minlength=len(x)) for j in range(3 * HIDDEN)], axis=1)
            g[f"x{d}"], g[f"c{d}"] = x.T @ dproj[d], dproj[d].sum(0)
        dword = sum(dproj[d] @ w[f"x{d}"].T for d in "fb")
        g["words"] = (block.word_row, dword[:, WIDTH:])
        many = np.bincount(block.piece_word, minlength=len(x))
        g["chars"] = (block.piece_row, (dword[:, :WIDTH] / many[:, None])[block.piece_word])
        return g


def fit(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """A network from whole texts and 0/1 labels. One class or no rows: a network that scores every text alike."""
    net, words = Network.fresh(seed), Words("alnum", latin=True)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.w = {k: np.zeros_like(v) for k, v in net.w.items()}
        net.w["bias"][:] = 4.0 if len(y) and y[0] else -4.0
        return net
    raw = [t.encode() for t in texts]
    block = Block(words, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    start_from_odds(net, block, y)
    memory = {k: np.full_like(v, 1e-6) for k, v in net.w.items()}
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        logits = net.window_logits(block)
        best = np.array([h + np.argmax(logits[h: t]) for h, t in zip(block.head, [*block.head[1:], len(logits)], strict=True)])
        order = r.permutation(len(y))
        for lo in range(0, len(order), batch):
            some = order[lo: lo + batch]
            for k, v in net.gradients(block, best[some], y[some]).items():
                if isinstance(v, tuple):
                    rows, at = np.unique(v[0], return_inverse=True)
                    v = np.stack([np.bincount(at, v[1][:, j]) for j in range(v[1].shape[1])], axis=1) if len(rows) else np.zeros((0, WIDTH))
                else:
                    rows = slice(None)
                memory[k][rows] = memory[k][rows] * 0.95 + v * v * 0.05
                net.w[k][rows] -= (rate * (0.3 if k in ("chars", "words") else 1) * v / (np.sqrt(memory[k][rows]) + 1e-4)).astype(np.float32)
    return net


def start_from_odds(net: Network, block: Block, y: np.ndarray) -> None:
    """Start the first coordinate of every table row from how much oftener its texts are labelled 1 than 0."""
    head = np.searchsorted(block.piece_word, np.arange(len(block.word_row) + 1))
    seen = {"words": np.zeros((2, WORDS_)), "chars": np.zeros((2, CHARS))}
    for d in range(len(y)):
        some = np.flatnonzero(block.owner == d)
        used = np.unique(np.concatenate([block.word[block.begin[w]: block.begin[w] + block.size[w]] for w in some]))
        seen["words"][int(y[d])][np.unique(block.word_row[used])] += 1
        rows = [block.piece_row[head[w]: head[w + 1]] for w in used]
        if rows:
            seen["chars"][int(y[d])][np.unique(np.concatenate(rows))] += 1
    for name, (none, one) in seen.items():
        odds = np.log((one + 0.5) / (y.sum() + 1)) - np.log((none + 0.5) / ((1 - y).sum() + 1))
        doubt = 2 * np.sqrt(1 / (one + 0.5) + 1 / (none + 0.5))  # only what two standard errors leave
        net.w[name][:, 0] = np.sign(odds) * np.maximum(np.abs(odds) - doubt, 0)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, fit_bytes: int) -> DataFrame:
    """(text, toxic): the bounded sample, chosen by hashed text; rows of equal text count once."""
    from pyspark.sql import Window
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = (docs.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("b")).filter((F.col("b") <= fit_bytes) & ~held_out(F.col("doc_id")))
            .join(known, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")))
    first = Window.partitionBy("toxic").orderBy("h", "doc_id")
    chosen = rows.withColumn("r", F.row_number().over(first)).filter((F.col("r") <= 2 * per_class) & (F.col("r") <= per_class * (2 - F.col("toxic")))).select(F.col("doc_id").alias("_doc"), "h", "toxic")
    # at most 3 * per_class rows of 20 bytes
    return docs.select("doc_id", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("h"))).select("text", "toxic", "h")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000, fit_bytes: int = 8_000) -> Network:
    """Learn from labelled rows outside the held-out quarter; see ``training_rows`` for the bound."""
    rows = sorted({(r.h, r.text, r.toxic) for r in training_rows(docs, labels, per_class, fit_bytes).collect()})
    texts, known = [r[1] for r in rows], [int(r[2]) for r in rows]
    del rows
    return fit(texts, known)


def score_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score, predicted) for every row: score in 0 to 1 from the whole text, predicted = score >= 0.3.

    A null, empty or wordless text has one empty window, so it gets the network's base score. Repeated rows get equal
    scores. Only the text is read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(net.w)

    def run(batches):
        model, words = Network(weights.value), Words("alnum", latin=True)
        for rows, raw, at in text_blocks(batches, limit=BLOCK):
            s = model.scores(Block(words, raw, at))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` whose text the network does not reject; all columns stay as they are."""
    weights = docs.sparkSession.sparkContext.broadcast(net.w)

    def run(batches):
        model, words = Network(weights.value), Words("alnum", latin=True)
        for rows, raw, at in text_blocks(batches, limit=BLOCK):
            yield rows.filter(pa.array(model.scores(Block(words, raw, at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
