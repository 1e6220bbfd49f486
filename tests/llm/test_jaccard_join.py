import random
import re

import numpy as np
import pytest

from cohortlens.llm import jaccard_join
from cohortlens.llm.components import components
from cohortlens.llm.jaccard_join import Bands, drop_near_copies, similarity_classes

from .conftest import ascii_lower, prose


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def result(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(df, **kw).collect()), key=str)


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def texts():
    rows = []
    for g in range(14):  # groups around the limit, of many sizes
        base = prose(g, [6, 9, 12, 18, 25, 40, 60, 90, 130, 200, 300, 500, 800, 1200][g])
        rows += [base, base.upper()] + [edited(base, k, 100 * g + k) for k in (1, 1, 2, 3, 5, max(1, len(base.split()) // 50), max(1, len(base.split()) // 40))]
    passage = prose(77, 60)
    rows += [f"{prose(1000 + i, 30)} {passage}" for i in range(40)]  # unrelated texts that share a passage
    hot = prose(55, 150)
    rows += [edited(hot, 2 + i % 5, 2000 + i) for i in range(60)]  # one large group of near copies
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = texts()
    random.Random(1).shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_large_buckets_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 5)
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    rows = texts()
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def hashes_of(words):
    return np.sort(np.array(words, np.uint64)).tobytes()


def test_pruned_bucket_over_many_partitions(spark, monkeypatch):
    """One bucket of two members that are left of many, over more partitions than there are pairs of tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", 2)
    members = spark.createDataFrame([(s, 2 * s + i, 2 * s + i) for s in range(12) for i in range(2)], "sign long, node long, root long")
    nodes = spark.createDataFrame([(n, 10, bytes(8)) for n in range(24)], "node long, n_shingles long, sketch binary")
    sets = spark.createDataFrame([(n, hashes_of(range(n // 2, n // 2 + 10))) for n in range(24)], "node long, shingles binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = sorted(tuple(r) for r in jaccard_join.links_across(members, nodes, sets, 80).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(2 * s, 2 * s + 1) for s in range(12)]


@pytest.mark.parametrize("weight", [4 << 20, 200])
def test_tiles_give_a_forest_that_joins_what_pairs_would(spark, monkeypatch, weight):
    """Sets on a line, each linked with its neighbours only, and one large component: few rows leave the tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", weight)
    sets = {n: range(3 * n, 3 * n + 20) for n in range(60)}
    root = {n: (0 if n < 25 else n) for n in sets}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    links = [tuple(r) for r in jaccard_join.links_across(
        frame([(5, n, root[n]) for n in sets], "sign long, node long, root long"), frame([(n, 20, bytes(8)) for n in sets], "node long, n_shingles long, sketch binary"),
        frame([(n, hashes_of(list(s))) for n, s in sets.items()], "node long, shingles binary"), 70).collect()]
    assert all(len(set(sets[a]) & set(sets[b])) * 100 >= 70 * len(set(sets[a]) | set(sets[b])) and root[a] != root[b] for a, b in links)
    parent = dict(root)
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in links:
        parent[find(root[a])] = find(root[b])
    assert len({find(r) for r in root.values()}) == 1 and len(set(links)) < 60


def test_only_members_that_meet_carry_their_sets(spark):
    """A crowded bucket of strangers and two near copies: the sets of two members travel to the tiles, not those of all."""
    sketch = np.random.default_rng(3).integers(0, 1 << 62, 300)
    sketch[1] = sketch[0] ^ 1
    members = spark.createDataFrame([(7, n, n) for n in range(300)], "sign long, node long, root long")
    nodes = spark.createDataFrame([(n, 40, sketch[n].tobytes()) for n in range(300)], "node long, n_shingles long, sketch binary")
    rows = jaccard_join.tiled(members.join(nodes, "node"))
    met = jaccard_join.meeting(rows, 80)
    assert rows.count() >= 300 and sorted(r.node for r in met.collect()) == [0, 1]
    sets = spark.createDataFrame([(n, hashes_of([*range(39), 40 + n])) for n in range(300)], "node long, shingles binary")
    assert [tuple(r) for r in jaccard_join.links_across(members, nodes, sets, 80).collect()] == [(0, 1)]
    assert jaccard_join.links_across(members.filter("node > 1"), nodes, sets, 80).count() == 0


def test_signatures_have_48_bits():
    value = np.sort(np.random.default_rng(4).integers(0, 1 << 63, 500).astype(np.uint64))
    _, sign = jaccard_join.block_rows(np.zeros(500, np.int64), value, np.array([500]), Bands(80), np.zeros(0, np.uint64))
    assert len(np.unique(sign)) == len(sign) > 200 and sign.max() < 1 << 48


def test_a_group_of_near_copies_below_the_limit(spark, monkeypatch):
    """Copies with so many edits that most pairs stay below the limit: few rows go through, and none is lost."""
    monkeypatch.setattr(jaccard_join, "TILE", 64)
    hot = prose(55, 150)
    rows = [(i, edited(hot, 2 + i % 4, 3000 + i)) for i in range(420)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_documents(documents):
    assert result(documents) == brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.filter("doc_id is not null and doc_id <> 3").collect()]
    assert result(odd.filter("doc_id is not null and doc_id <> 3")) == brute(rows)
    assert similarity_classes(odd).count() == odd.count()


def test_empty_and_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similarity_classes(empty).count() == 0 and drop_near_copies(empty).count() == 0
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, None), (5, None), (6, "a b"), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(df).collect()) == [1, 3, 4, 5, 6]


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_bands_bound_every_pair(percent):
    b = Bands(percent)
    for a in range(1, 300):
        for c in range(a, a * 100 // percent + 1):
            limit = (a + c) * (100 - percent) // (100 + percent)
            band = int(b.of(np.array([a]))[0])
            own = int(b.of(np.array([c]))[0])
            assert b.bound[band] >= limit and own - band in (0, 1) and (limit == 0 or b.blocks[band] > limit) and b.partner[band] >= c


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(30)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
