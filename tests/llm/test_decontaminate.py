import random

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm.decontaminate import align, contaminated, drop_contaminated, padded

from .conftest import prose


def plain_score(a, b):
    """Smith-Waterman by the recurrence: match 2, mismatch -1, gap -1."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_recurrence():
    r = random.Random(4)
    a = [[r.randint(2, 6) for _ in range(r.randint(1, 14))] for _ in range(60)]
    b = [[r.randint(2, 6) for _ in range(r.randint(1, 30))] for _ in range(60)]
    best, _, _ = align(padded([np.array(x, np.uint32) for x in a], 0), padded([np.array(x, np.uint32) for x in b], 1))
    assert best.tolist() == [plain_score(x, y) for x, y in zip(a, b, strict=True)]


def test_copies_and_edits(spark):
    items = [(1, prose(901, 40).capitalize()), (2, prose(902, 15)), (3, prose(903, 55)), (4, "two words"), (5, None), (6, prose(906, 200)), (None, prose(907, 30))]
    w = items[2][1].split()
    edited = " ".join(x for i, x in enumerate(w) if i % 9 != 4)  # words left out
    swapped = " ".join("other" if i % 7 == 3 else x for i, x in enumerate(items[0][1].split()))
    docs = [(10, f"{prose(1, 80)}\n{items[0][1].upper()}, {prose(2, 30)}"), (11, f"{prose(3, 20)} {edited} {prose(4, 500)}"), (12, swapped), (13, items[1][1]), (14, prose(5, 3000)),
            (15, " ".join(["the"] * 500)), (16, None), (17, ""), (18, items[5][1] + " " + items[1][1]), (13, items[1][1]), (19, " ".join(items[2][1].split()[:8]) + " " + prose(6, 50)), (None, items[1][1])]
    docs += [(100 + i, f"{prose(3000 + i, 25)} {items[2][1]}") for i in range(40)]  # one item in most documents
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(d.repartition(3), i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 1), (11, 3), (12, 1), (13, 2), (18, 6), (18, 2), (None, 2), *((100 + k, 3) for k in range(40))}
    at = {(r.doc_id, r.item_id): r for r in got}
    assert (at[10, 1].word_start, at[10, 1].word_end, at[10, 1].ratio) == (80, 120, 1.0) and at[11, 3].ratio < 1
    kept = {r.doc_id for r in drop_contaminated(d, i).collect()}
    assert kept == {14, 15, 16, 17, 19}


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert contaminated(odd, items).count() == 0 and drop_contaminated(odd, items).count() == odd.count()
    assert contaminated(odd, items.limit(0)).count() == 0 and contaminated(odd.limit(0), items).count() == 0
    assert drop_contaminated(odd, items).columns == odd.columns


def test_every_item_is_found_in_the_documents(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    want = {(d.doc_id, i) for d in documents.collect() for i, t in texts.items() if t in d.text}
    assert want <= {(r.doc_id, r.item_id) for r in contaminated(documents, items).collect()}


def test_items_of_three_words_and_texts_that_share_an_id(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (3, prose(903, 40)), (3, prose(904, 12)), (3, prose(904, 12)), (4, "alpha beta")], "item_id long, text string")
    docs = [(10, "Alpha, beta gamma!"), (11, prose(1, 30) + " alpha beta gamma " + prose(2, 300)), (12, prose(904, 12)), (13, prose(903, 40)), (14, "alpha beta delta gamma"), (15, prose(5, 200)), (16, "alpha beta")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_bad", F.lit(1))
    got = {(r.doc_id, r.item_id, r.ratio) for r in contaminated(df, items).collect()}
    assert got == {(10, 1, 1.0), (11, 1, 1.0), (12, 3, 1.0), (13, 3, 1.0)}
    kept = drop_contaminated(df, items)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {14, 15, 16}


def test_edited_copies_by_edit_rate(spark):
    """Random words replaced, left out or put in: all copies with up to one edit in ten words are found, nearly all with one in five."""
    r = random.Random(6)
    texts = {i: prose(700 + i, 30 + 3 * i, vocabulary=900) for i in range(12)}
    docs, doc = [], 0
    for rate in (0.0, 0.05, 0.1, 0.2):
        for i, t in texts.items():
            words = []
            for w in t.split():
                x = r.random()
                words += [w] if x > rate else [["other"], [], [w, "more"]][r.randrange(3)]
            docs.append((doc, f"{prose(9000 + doc, 60)} {' '.join(words)} {prose(9500 + doc, 60)}", i, rate))
            doc += 1
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    found = {(x.doc_id, x.item_id) for x in contaminated(df, spark.createDataFrame(list(texts.items()), "item_id long, text string")).collect()}
    share = {rate: sum((d, i) in found for d, _, i, q in docs if q == rate) / len(texts) for rate in (0.0, 0.05, 0.1, 0.2)}
    assert share[0.0] == share[0.05] == share[0.1] == 1 and share[0.2] >= 0.9, share
    assert all((d, i) in {(x[0], x[2]) for x in docs} for d, i in found)
