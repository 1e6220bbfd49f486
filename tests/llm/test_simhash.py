import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import simhash
from cohortlens.llm.simhash import cuts, drop_similar, forest, near_links, simhash_classes
from cohortlens.llm.components import components

from .conftest import ascii_lower, prose
from .test_jaccard_join import edited


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root, least = classes(fps), {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root, strict=True)), key=str)


def result(df):
    return sorted(map(tuple, simhash_classes(df).collect()), key=str)


def texts():
    rows = []
    for g in range(10):
        base = prose(g, [1, 2, 3, 5, 20, 60, 150, 300, 500, 900][g])
        rows += [base, base.upper(), base.replace(" ", "\n\t ")] + [edited(base, k, 100 * g + k) for k in (1, 1, 2, 3)]
    hot = prose(55, 400)
    return list(enumerate(rows + [edited(hot, 1, 2000 + i) for i in range(80)] + [hot] * 20))


def test_against_brute_force(spark):
    rows = texts()
    random.Random(1).shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_crowded_buckets_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    rows = texts()
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


@pytest.mark.parametrize("bucket", [2, 256])
def test_a_dense_group_beyond_the_bucket_size(spark, monkeypatch, bucket):
    """Fingerprints within a few bits of one another, all in shared buckets, and strangers."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(40), r.randrange(0, 5))) for _ in range(700)} | {r.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((x.a ^ x.b) & ((1 << 64) - 1)).bit_count() <= 2 for x in links.collect())
    root = {x.node: x.root for x in components(links).collect()}
    want = {}
    for f, c in zip(signed, classes(fps), strict=True):
        want.setdefault(c, []).append(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, by_root(signed, root).values()))


def by_root(nodes, root):
    out = {}
    for n in nodes:
        out.setdefault(root.get(n, n), []).append(n)
    return out


def test_cuts_hold_every_close_pair():
    first = cuts(0, 16)
    assert len(first) == 6 and all(m.bit_count() == 32 for m in first)
    for a, b in combinations(range(64), 2):
        change = 1 << a | 1 << b
        kept = [m for m in first if not m & change]
        assert kept and all(any(not c & change and any(not d & change for d in cuts(c, 4)) for c in cuts(m, 8)) for m in kept)
    assert all(d.bit_count() == 56 for m in first[:1] for c in cuts(m, 8) for d in cuts(c, 4))


def test_forest_is_shorter_than_the_members():
    r = random.Random(2)
    fp = np.array([r.getrandbits(64) & 0xFFF for _ in range(300)], np.uint64)
    fp = np.unique(fp)
    child, parent = forest(fp)
    assert len(child) < len(fp) and len(set(child.tolist())) == len(child) and (np.bitwise_count(child ^ parent) <= 2).all()


def test_documents_and_odd_rows(documents, odd):
    assert result(documents) == brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert simhash_classes(odd.limit(0)).count() == 0


def test_stage_keeps_one_of_each_class(spark):
    rows = [(1, "a b c d e f", 5), (2, "A b c d e f", 6), (3, "", 7), (4, None, 8), (None, None, 9), (6, "zz y", 1), (6, "zz y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long").withColumn("fp", F.lit(1))
    out = drop_similar(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r._id) for r in out.collect()), key=str) == sorted([(1, 5), (3, 7), (None, 9), (6, 1), (6, 2)], key=str)
