import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ranked_search
from cohortlens.llm.ranked_search import Best, rank_documents, search_block
from cohortlens.llm.registered import ORACLES, QUERIES

from .conftest import ascii_lower, prose


def words(text):
    return re.findall(ranked_search.TERM, ascii_lower(text or ""))


def brute(docs, items, k):
    docs = [(d, Counter(words(t))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def result(docs, items, k):
    return sorted(map(tuple, rank_documents(docs, items, k).collect()), key=str)


ITEMS = [(1, "The the THE common word"), (2, "zebra"), (3, None), (4, ""), (5, " \n-- "), (None, "one two"), (7, "日本語 é x1 1x_y"), (7, "three"), (8, prose(5, 40)), (9, prose(5, 300)), (10, "absent nowhere")]


@pytest.mark.parametrize("k,block", [(50, 2_000_000), (3, 200), (1, 1)])
def test_against_brute_force(spark, odd, monkeypatch, k, block):
    monkeypatch.setattr(ranked_search, "POSTINGS", block)
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    docs += [(1000 + i, "the common word " * (i % 4) + prose(i % 40, 10 + 7 * i)) for i in range(120)] + [(5000 + i, "tie here zebra") for i in range(70)] + [(5000, "tie here zebra")] * 2
    random.Random(3).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(df, items, k) == brute(docs, ITEMS, k)


def test_items_in_groups(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = result(documents, items, 5)
    assert want == brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()], 5)
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", 150)
    assert result(documents.repartition(3), items, 5) == want


def test_no_accumulator_is_created_once_the_rest_cannot_reach_the_kth(monkeypatch):
    """One rare term in three documents, one common term in all: with k = 3 the common term only updates."""
    touched = []

    class Watched(Best):
        def add(self, i, score, doc, null):
            touched.append(sorted(doc.tolist()))
            super().add(i, score, doc, null)

    owner, term = np.r_[[3, 5, 7], np.arange(10)], np.r_[[0, 0, 0], np.full(10, 1)]
    best = Watched(1, 3)
    search_block(best, [np.array([0, 1])], np.array([3, 10]), np.array([5000, 10]), np.arange(10), np.zeros(10, bool), np.full(10, 100), owner, term, np.ones(13, np.int64))
    assert touched == [[3, 5, 7]] and best.doc[0].tolist() == [3, 5, 7]
    one = 1_000_000_000 // 3000
    assert best.score[0].tolist() == [5010 * one] * 3
    # a second block of the same task cannot reach the kth score of the first with the common term alone
    search_block(best, [np.array([0, 1])], np.array([3, 10]), np.array([5000, 10]), np.arange(10, 20), np.zeros(10, bool), np.full(10, 100), np.arange(10), np.full(10, 1), np.ones(10, np.int64))
    assert touched[1] == []


def test_terms_are_compared_byte_by_byte():
    terms = [b"abc", b"abd", "日本".encode(), b"x"]
    table = ranked_search.Terms(terms)
    raw = np.frombuffer(b" ".join([*terms, b"zzz"]), np.uint8)
    w = ranked_search.Words("alnum")
    _, start, end, sums, folded = w(raw, np.array([0, len(raw)]))
    h = w.hashes(sums, start, end)
    assert table.find(h, folded, start, end).tolist() == [0, 1, 2, 3, -1]
    h[4] = h[0]  # another word with the same hash
    assert table.find(h, folded, start, end).tolist() == [0, 1, 2, 3, -1]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
        want = sorted(con.execute(ORACLES["op13_ranked_search"]).fetchall())
    assert sorted(map(tuple, QUERIES["op13_ranked_search"](spark, folder).collect())) == want


def test_empty_tables_and_clashing_columns(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "item", "score", "doc_id")})
    assert rank_documents(odd.withColumns({c: F.lit("x") for c in ("n", "terms", "counts")}), items).columns == ["item_id", "rank", "doc_id", "score"]
    assert rank_documents(odd, items.limit(0)).count() == 0 and rank_documents(odd.limit(0), items).count() == 0
