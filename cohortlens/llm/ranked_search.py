"""Ranked lexical search: term-at-a-time with a limited set of accumulators, over blocks of postings.

1. One pass over the documents keeps, per document, its length and the items' terms it holds with their counts. Only terms of
   the items travel; a term is recognised by its hash and then compared byte by byte.
2. Corpus figures (documents, lengths, document frequencies) are aggregates over that table.
3. Every task turns its documents into postings lists, a block at a time, and takes each item's terms rarest first. A term's
   postings add to the accumulators of their documents. Once at least k accumulators exist (with those that earlier blocks of the
   task have left) and the terms still to come cannot together reach the kth partial score, no more are created: the
   others only update those there are, exactly. A task hands on each item's k best, and a ranked window ends it.

Items come in groups of a bounded number of terms, each with a pass of its own, so that what a task holds of them is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut

from .blocks import Words, text_blocks
from .pretokens import ragged

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 50
ITEM_TERMS = 1_000_000  # of a group of items, as far as one item does not have more
POSTINGS = 2_000_000  # of a block


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct. Items without terms have no row; rows that share an item_id are one item."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(F.array_distinct(words)).alias("term")).distinct()


class Terms:
    """Terms as bytes and sorted hashes; ``find`` gives the number of each word that is one of them, or -1."""

    def __init__(self, terms: list[bytes]):
        raw, at = np.frombuffer(b"".join(terms), np.uint8), np.r_[0, np.cumsum([len(t) for t in terms])].astype(np.int64)
        words = Words("alnum")
        _, start, end, sums, _ = words(raw, at)  # a term is one word
        h = words.hashes(sums, start, end)
        if len(np.unique(h)) < len(h):
            raise ValueError("two terms of the items have one hash")
        self.raw, self.at = raw, at
        self.order = np.argsort(h)
        self.hash = h[self.order]

    def find(self, h: np.ndarray, folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        term = np.where(self.hash[place] == h, self.order[place], -1)
        hit = np.flatnonzero(term >= 0)
        length = end[hit] - start[hit]
        same = length == np.diff(self.at)[term[hit]]
        term[hit[~same]] = -1
        hit, length = hit[same], length[same]
        if len(hit):
            mine, at = ragged(self.raw, self.at, term[hit])
            theirs = folded[np.arange(at[-1]) + np.repeat(start[hit] - at[:-1], length)]
            differ = np.add.reduceat(mine != theirs, at[:-1])
            term[hit[differ > 0]] = -1
        return term


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with at least one term of any kind: n is their number with repeats; terms are
    the numbers of the items' terms that it holds, counts how often."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        words, table = Words("alnum"), Terms(known.value)
        for rows, raw, at in text_blocks(batches):
            doc, start, end, sums, folded = words(raw, at)
            n = np.bincount(doc, minlength=rows.num_rows)
            term = table.find(words.hashes(sums, start, end), folded, start, end)
            hit = term >= 0
            key, count = np.unique(doc[hit] * len(table.hash) + term[hit], return_counts=True)
            offset = np.searchsorted(key, np.arange(rows.num_rows + 1) * len(table.hash)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offset), pa.array(x.astype(np.int32))) for x in (key % len(table.hash), count)]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)


class Best:
    """The k best (score, doc_id) of each item so far; rows of one score by ascending doc_id, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, bool)] * items

    def floor(self, i: int) -> int:
        """The kth best score, 0 while there are fewer."""
        return int(self.score[i][-1]) if len(self.score[i]) == self.k else 0

    def add(self, i: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.r_[self.score[i], score], np.r_[self.doc[i], doc], np.r_[self.null[i], null]
        if len(score) > self.k:  # all that tie with the kth stay for the order
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc, null = score[keep], doc[keep], null[keep]
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score[i], self.doc[i], self.null[i] = score[order], doc[order], null[order]


def search_block(best: Best, items: list[np.ndarray], frequency: np.ndarray, weight: np.ndarray, doc: np.ndarray, null: np.ndarray, m: np.ndarray,
                 owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
    """Term at a time over one block: postings (owner, term, count), owner numbering the block's documents."""
    impact = weight[term] * (1_000_000_000 * count // (1000 * count + 20 * m[owner]))
    order = np.argsort(term, kind="stable")
    owner, impact, term = owner[order], impact[order], term[order]
    lo = np.searchsorted(term, np.arange(len(weight) + 1))
    most = np.zeros(len(weight), np.int64)
    head = np.flatnonzero(np.diff(lo))
    if len(head):
        most[head] = np.maximum.reduceat(impact, lo[head])
    total = np.zeros(len(doc), np.int64)
    for i, terms in enumerate(items):
        terms = terms[lo[terms + 1] > lo[terms]]
        terms = terms[np.lexsort((terms, frequency[terms]))]  # rarest first
        rest = np.cumsum(most[terms][::-1])[::-1]  # a bound on what a term and those after it can add
        floor, creating = best.floor(i), True
        alive = np.zeros(0, np.int64)
        for t, bound in zip(terms.tolist(), rest.tolist(), strict=True):
            if creating:
                if len(alive) >= best.k:
                    partial = total[alive]
                    floor = max(floor, int(np.partition(partial, len(partial) - best.k)[len(partial) - best.k]))
                creating = bound >= floor
            where, add = owner[lo[t]: lo[t + 1]], impact[lo[t]: lo[t + 1]]
            if creating:
                fresh = where[(total[where] == 0) & (add > 0)]
                alive = np.concatenate([alive, fresh])
            else:
                there = total[where] > 0
                where, add = where[there], add[there]
            total[where] += add
        best.add(i, total[alive], doc[alive], null[alive])
        total[alive] = 0


def best_of_tasks(rows: DataFrame, items: list[np.ndarray], frequency: np.ndarray, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): every task's k best documents of each item with a score above 0."""
    sent = rows.sparkSession.sparkContext.broadcast((items, frequency, weight))

    def run(batches):
        items, frequency, weight = sent.value
        best = Best(len(items), k)
        for batch in batches:
            at = batch.column(2).offsets.to_numpy().astype(np.int64)
            low = 0
            while low < batch.num_rows:
                high = min(max(low + 1, int(np.searchsorted(at, at[low] + POSTINGS, "right")) - 1), batch.num_rows)
                part = batch.slice(low, high - low)
                n = part.column(1).to_numpy()
                # 50 n N may pass 64 bits in a corpus of any size, its quotient does not
                m = 50 + np.array([50 * int(x) * documents // length for x in n.tolist()], np.int64)
                ids = part.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                here = slice(at[low], at[high])
                search_block(best, items, frequency, weight, ids.fill_null(0).to_numpy(), null, m, np.repeat(np.arange(high - low), np.diff(at[low: high + 1])),
                             batch.column(2).values.to_numpy()[here].astype(np.int64), batch.column(3).values.to_numpy()[here].astype(np.int64))
                low = high
        item = np.repeat(np.arange(len(items)), [len(s) for s in best.score])
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(best.doc), mask=np.concatenate(best.null)), pa.array(np.concatenate(best.score))], ["item", "doc_id", "score"])

    return rows.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, doc_id long, score long")


def groups_of(terms: DataFrame) -> list[DataFrame]:
    """The items in groups of about ``ITEM_TERMS`` rows of ``terms``; a single item stays whole."""
    many = -(-terms.count() // ITEM_TERMS)
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(many, 1)))
    return [terms if many == 1 else terms.filter(part == i) for i in range(many)]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, all if fewer.

    docs (doc_id, text), items (item_id, text). Terms are the matches of ``TERM``, A-Z lower-cased. Equal scores go by ascending
    doc_id, a null one last. Every row of ``docs`` is a document, repeated ids and rows too; rows of ``items`` that share an
    item_id (null is one) are one item with the terms of all. Null texts have no terms; empty tables give no rows. Other columns
    are ignored.
    """
    found = None
    for group in groups_of(cut(item_terms(items))):
        pairs = group.select("item_id", "term").toArrow()  # one group of items: bounded
        ids, term = pairs.column("item_id").combine_chunks().dictionary_encode("encode"), pairs.column("term").combine_chunks().dictionary_encode()
        number, owner = term.indices.to_numpy(), ids.indices.to_numpy()
        by_item = np.lexsort((number, owner))
        each = np.split(number[by_item].astype(np.int64), np.flatnonzero(np.diff(owner[by_item])) + 1)
        rows = cut(postings(docs, [t.encode() for t in term.dictionary.to_pylist()]))
        documents, length = rows.agg(F.count("*"), F.sum("n")).first()
        held = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        frequency = np.zeros(len(term.dictionary), np.int64)
        frequency[held.column("t").to_numpy()] = held.column("df").to_numpy()
        top = best_of_tasks(rows, each, frequency, weights(documents, frequency), documents, length or 1, k)
        names = docs.sparkSession.createDataFrame(pa.table({"item": np.arange(len(each)), "item_id": ids.dictionary}))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = cut(top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
