import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import sharding, topk_search


def brute(rows, every, k):
    v = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in dict(reversed(v)).items():
        if q % every == 0:
            top = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in v if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(top, 1)]
    return sorted(out)


@pytest.mark.parametrize("bins,rows,queries", [(4096, 4096, 1024), (4, 7, 3)])
def test_top_k(spark, monkeypatch, bins, rows, queries):
    for name, value in (("BINS", bins), ("ROWS", rows), ("QUERIES", queries)):
        monkeypatch.setattr(topk_search, name, value)
    r = random.Random(5)
    data = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    data += [(100 + i, data[10][1]) for i in range(30)]  # ties at the kth score
    data += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [math.nan] * 6), (204, [math.inf] * 6), (205, [0.5, 0.5]), (210, [0.25, 0.5]), (None, [0.1] * 6), (220, [0.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    data = [(x.vec_id, x.embedding) for x in df.collect()]
    got = topk_search.top_k(df.repartition(4), F.col("vec_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(data, 10, 5)


@pytest.mark.parametrize("size", [1e3, 2.0**21, 2.0**23])
def test_top_k_of_large_components(spark, size):
    """Scores on both sides of 2**53, with neighbours that float64 could not tell apart."""
    r = random.Random(7)
    data = [(i, [float(round(r.uniform(-size, size) / 2)) / 256 + size / 512, size / 4, 1.0 / 256]) for i in range(40)]
    data += [(50 + i, [*data[10][1][:2], (i % 3) / 256]) for i in range(12)]  # scores one apart
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df.repartition(4), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(data, 10, 5)


@pytest.mark.parametrize("size", [1e12, 1e300])
def test_scores_beyond_int64_are_refused(spark, size):
    df = spark.createDataFrame([(0, [size]), (1, [size])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="smaller scale"):
        topk_search.top_k(df, F.col("vec_id") == 0)


def test_top_k_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk_search.top_k(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_shards(spark, odd):
    r = random.Random(2)
    rows = [(i, "common text " * 30) for i in range(3000)]  # a third of all rows
    rows += [(3000 + i, f"text {r.randrange(2500)} " + "x" * r.randrange(300)) for i in range(6000)] + [(9001, "long " * 9000), (9002, None), (9003, ""), (9002, None)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows) and {x.law for x in got} == {"bytes"}
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, size, n = defaultdict(list), Counter(), Counter()
    where = defaultdict(set)
    for x in got:
        slots[x.shard].append(x.slot)
        size[x.shard] += x.size
        n[x.shard] += 1
        where[x.text_crc32].add(x.shard)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.05 * min(size.values()) and max(n.values()) < 1.2 * min(n.values())
    whole = Counter(zlib.crc32((t or "").encode()) for _, t in rows)
    assert all(len(s) == 1 for c, s in where.items() if whole[c] < 50)
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(odd.limit(0)).count() == 0


def test_place_follows_the_dot_product():
    items = np.array([[0.5, 0.1, 0.1], [0.1, 0.5, 0.1], [0.4, 0.1, 0.1]])
    assert sharding.place(items, 2).tolist() == [0, 1, 1]
