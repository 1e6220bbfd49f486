"""Cross-tokenizer alignment: all documents of a batch advance in lockstep, one NumPy step at a time.

Tokenizer A is a byte-level vocabulary on space + text, B a piece vocabulary that puts the space itself. Both cut the same
bytes. A state vector holds one A and one B pointer for every document of the batch; a step emits a link for each pair, a
cut where both tokens end together, moves the pointers whose token ends first (both, at a cut), and drops the documents
that are done. A document longer than ``LANE`` bytes has several places in the vector, each beginning where the one before ends.

Counts of id pairs are corpus-wide. A batch numbers its distinct pairs, the numbers of a document's links are written as steps
between sorted neighbours, and the pairs go out once a batch with their counts. The summed counts come back to the batches
that hold the pair, again once a batch, and meet the documents there: links themselves are never shuffled one by one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut

from .blocks import spans, text_blocks
from .pretokens import ragged
from .units import UnitIds, counted, cut_units, spaced

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
LANE = 1024
BATCH_LINKS = 3_000_000
MARK = "▁"
SCHEMA = ("batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps binary, jumps binary, "
          "pairs array<long>, counts array<long>")


class Tokenizers:
    """Both vocabularies: encoders for UnitIds, and each id's bytes."""

    def __init__(self, ranks: str, pieces: str, pattern: str = public_tokenizers.PATTERN):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        by_id = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            by_id[rank] = token
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        spelt = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if piece.lstrip(MARK).count(MARK):
                raise ValueError(f"piece {i} has white space inside: units would not be independent")
            spelt.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.bytes = [self.flat(by_id), self.flat(spelt)]
        self.widths = [np.diff(at) for _, at in self.bytes]

    @staticmethod
    def flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(tokens), np.uint8), np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int64)

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return counted([self.a.encode_ordinary(t) for t in texts])

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # texts begin with the space that the vocabulary adds, but not to an empty text
        alone = [self.b.piece_to_id(MARK)]
        return counted([alone if t == " " else ids for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)])

    def tokens(self, remembered: UnitIds, raw: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B and their offsets by text; texts whose bytes a vocabulary cannot give back have none."""
        text, text_at = spaced(raw, at)
        start, solid = cut_units(text, text_at)
        place = remembered(text, start, solid)
        first = np.searchsorted(start, text_at)  # the first unit of each text
        bad = at[1:] == at[:-1]
        ids, offsets = [], []
        for k, (spelt, spelt_at) in enumerate(self.bytes):
            value, end = ragged(remembered.ids[k], remembered.at[k], place)
            offsets.append(end[first])
            ids.append(value)
            same = np.add.reduceat(np.r_[self.widths[k][value], 0], np.minimum(offsets[k][:-1], len(value))) if len(at) > 1 else np.zeros(0, np.int64)
            same = np.where(offsets[k][1:] > offsets[k][:-1], same, 0)
            odd = same != np.diff(text_at)
            if not odd.any():
                back, _ = ragged(spelt, spelt_at, value)
                if not np.array_equal(back, text):
                    wrong = np.flatnonzero(back != text)
                    odd[np.searchsorted(text_at, wrong, "right") - 1] = True
            else:
                for i in np.flatnonzero(~odd):
                    back, _ = ragged(spelt, spelt_at, value[offsets[k][i]: offsets[k][i + 1]])
                    odd[i] = not np.array_equal(back, text[text_at[i]: text_at[i + 1]])
            bad |= odd
        for k in (0, 1):
            count = np.diff(offsets[k])
            ids[k] = ids[k][~np.repeat(bad, count)]
            offsets[k] = np.r_[0, np.cumsum(np.where(bad, 0, count))]
        return ids, offsets


def lanes(end_a: np.ndarray, end_b: np.ndarray, doc_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the places of the state vector begin, A and B pointer, and the byte at or beyond which each is done."""
    length = np.diff(doc_at)
    many = -(-length // size)
    doc = np.repeat(np.arange(len(length)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = doc_at[doc] + nth * size
    stop = np.minimum(begin + size, doc_at[doc + 1])
    # the pair under way at a later place's first byte belongs to the place before
    later = nth > 0
    p = begin[later]
    begin[later] = np.minimum(end_a[np.searchsorted(end_a, p)], end_b[np.searchsorted(end_b, p)])
    busy = begin < stop
    begin, stop = begin[busy], stop[busy]
    return np.searchsorted(end_a, begin, "right"), np.searchsorted(end_b, begin, "right"), stop


def lockstep(end_a: np.ndarray, end_b: np.ndarray, doc_at: np.ndarray, size: int = LANE) -> tuple[np.ndarray, ...]:
    """Links (A index, B index) and cuts (A index, B index) of documents whose tokens end at the given bytes.

    doc_at are the documents' byte offsets; both tokenizers end at each. Links and cuts come in step order.
    """
    a, b, stop = lanes(end_a, end_b, doc_at, size)
    out: tuple[list[np.ndarray], ...] = ([], [], [], [])
    while len(a):
        ea, eb = end_a[a], end_b[b]
        out[0].append(a), out[1].append(b)
        both = ea == eb
        out[2].append(a[both]), out[3].append(b[both])
        a, b = a + (ea <= eb), b + (eb <= ea)
        going = np.minimum(ea, eb) < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


class Spelling:
    """Ids as decimal text with one separator after each: rows of a fixed-width table."""

    def __init__(self, ids: int):
        text = [f"{i}{s}".encode() for s in ",|;" for i in range(ids)]
        self.n = ids
        self.length = np.array([len(t) for t in text], np.int64)
        self.rows = np.zeros((len(text), self.length.max()), np.uint8)
        for i, t in enumerate(text):
            self.rows[i, : len(t)] = np.frombuffer(t, np.uint8)

    def __call__(self, ids: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, end of each id's text); separator is 0 for a comma, 1 for a bar, 2 for a semicolon."""
        pick = ids + separator * self.n
        length = self.length[pick]
        rows = self.rows[pick]
        return rows[np.arange(rows.shape[1]) < length[:, None]], np.cumsum(length)


def group_digests(spell: Spelling, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
    """sha256 of each document's groups ``a1,a2|b1;...``; '' for documents without tokens. The cuts are sorted."""
    out = np.empty(len(a) + len(b), np.int64)
    separator = np.zeros(len(out), np.int64)
    before_a, before_b = np.diff(np.r_[-1, cut_a]), np.diff(np.r_[-1, cut_b])  # tokens a group
    lead_a = np.cumsum(before_a) - before_a
    lead_b = np.cumsum(before_b) - before_b
    place_a = np.arange(len(a)) + np.repeat(lead_b, before_a)
    place_b = np.arange(len(b)) + np.repeat(lead_a + before_a, before_b)
    out[place_a], out[place_b] = a, b
    separator[place_a[cut_a]] = 1
    separator[place_b[cut_b]] = 2
    text, end = spell(out, separator)
    raw, end = memoryview(text), np.r_[0, end]
    at = a_at + b_at
    # the last separator of a document is not part of it
    return [hashlib.sha256(raw[end[lo]: end[hi] - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def packed(number: np.ndarray, doc: np.ndarray, n: int) -> tuple[list[bytes], list[bytes]]:
    """Each document's sorted pair numbers as steps of one byte; 255 stands for the next of its jumps (four bytes each)."""
    key = np.sort((doc.astype(np.int64) << 32) | number)
    owner, value = key >> 32, key & 0xFFFFFFFF
    step = np.diff(value, prepend=0)
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(key) else np.zeros(0, np.int64)
    step[head] = value[head]
    far = step >= 255
    small, large = np.minimum(step, 255).astype(np.uint8), step[far].astype("<u4")
    at = np.searchsorted(owner, np.arange(n + 1))
    jump = np.r_[0, np.cumsum(far)][at]
    return ([small[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)],
            [large[lo:hi].tobytes() for lo, hi in zip(jump[:-1], jump[1:], strict=True)])


def aligned(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """Rows of ``SCHEMA``: a row a document, and a row a batch with its distinct pairs (A id * 65536 + B id) and their counts."""
    paths = ranks or public_tokenizers.path(RANKS), pieces or public_tokenizers.path(PIECES)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        both = Tokenizers(*paths)
        spell = Spelling(max(map(len, both.widths)))
        remembered = UnitIds([both.encode_a, both.encode_b], both.widths)
        part, batch = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []  # documents of the open batch: their columns, pair codes and owners

        def flush():
            codes = np.concatenate([h[1] for h in held])
            known, number, count = np.unique(codes, return_inverse=True, return_counts=True)
            often = np.argsort(-count, kind="stable")  # frequent pairs get small numbers
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            number, at = rank[number], 0
            for columns, own, doc in held:
                steps, jumps = packed(number[at: at + len(own)], doc, len(columns[0]))
                at += len(own)
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part + batch)), *columns, pa.array(steps, pa.binary()), pa.array(jumps, pa.binary()),
                                                  pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names)
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (known[often], count[often])]
            nothing = [pa.nulls(1, t) for t in (*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([part + batch]), *nothing, *lists], names)

        links = 0
        for rows, raw, at in text_blocks(batches):
            (a, b), (a_at, b_at) = both.tokens(remembered, raw, at)
            end_a, end_b = np.cumsum(both.widths[0][a]), np.cumsum(both.widths[1][b])
            doc_at = np.r_[0, end_a][a_at]
            link_a, link_b, cut_a, cut_b = lockstep(end_a, end_b, doc_at)
            cut_a, cut_b = np.sort(cut_a), np.sort(cut_b)
            digests = group_digests(spell, a, b, a_at, b_at, cut_a, cut_b)
            doc = np.searchsorted(a_at, link_a, "right") - 1
            n = rows.num_rows
            groups = np.diff(np.searchsorted(cut_a, a_at))
            columns = [rows.column(0).cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (np.diff(a_at), np.diff(b_at), groups, np.bincount(doc, minlength=n))), pa.array(digests)]
            held.append((columns, (a[link_a].astype(np.int64) << 16) | b[link_b], doc))
            links += len(link_a)
            if links >= BATCH_LINKS:
                yield from flush()
                held, links, batch = [], 0, batch + 1
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) from ``aligned`` rows: corpus-wide links of the pair, and whether no pair of its B id has more."""
    each = rows.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    total = cut(each.groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(0xFFFF)
    most = total.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    return total.join(most, b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def align(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs`` (doc_id, text).

    Special tokens' strings are plain text. A text that is null or empty, or whose bytes one of the vocabularies cannot give back
    (one that holds the piece vocabulary's own mark for a space), has no tokens: zeros and ''. Repeated rows each get their
    own row and count each; a null doc_id is kept; other columns are ignored. ranks and pieces are paths.
    """
    rows = cut(aligned(docs, ranks, pieces))
    asked = rows.filter("pairs is not null").select(F.col("batch").alias("_batch"), F.posexplode("pairs").alias("at", "pair"))
    found = asked.join(pair_counts(rows), "pair").select("_batch", "at", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n"))
    texts = rows.filter("pairs is null").select("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "jumps")

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        n = np.zeros(found.num_rows, np.int64)  # negative where the pair is its B id's best
        n[found.column("at").to_numpy()] = found.column("n").to_numpy()
        sums = []
        for name, batch in (("steps", texts), ("jumps", texts)):
            column = batch.column(name).combine_chunks()
            raw, at = spans(column)
            sums.append((np.ascontiguousarray(raw[at[0]: at[-1]]), at - at[0]))
        (step, at), (jump, _) = sums
        step = step.astype(np.int64)
        step[step == 255] = jump.view("<u4")
        value = np.cumsum(step)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        value -= np.r_[0, value][at[:-1]][owner]
        hit = n[value]
        best = np.bincount(owner, hit < 0, len(at) - 1).astype(np.int64)
        whole = np.r_[0, np.cumsum(np.abs(hit))]
        out = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return pa.table([*out.columns, pa.array(best), pa.array(whole[at[1:]] - whole[at[:-1]]), texts.column("groups_sha256")],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return texts.groupBy("batch").cogroup(found.groupBy("_batch")).applyInArrow(
        score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
