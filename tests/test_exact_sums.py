"""Running sums that do not depend on the order of rows, and all pairs of groups from one ordering pass."""

import random
from itertools import combinations

import pytest

from cohortlens.operators import inference, ordering, peers


@pytest.mark.parametrize("buckets", [250_000, 2])
def test_peer_means_are_exact_in_any_order(spark, monkeypatch, buckets):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", buckets)
    rows = [("g", 1, 100.0, 1e16), ("g", 2, 101.0, 1.0), ("g", 3, 102.0, -1e16), ("g", 4, 103.0, 0.25), ("g", 5, 900.0, 3e20), ("g", 6, 901.0, 2.5), ("g", 7, 2000.0, -7.125), ("h", 8, 100.0, None), ("h", 9, None, 3.0)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "grp string, id long, size double, v double").repartition(3)
        got = {r.id: (r.n_peers, r.peer_mean) for r in peers.peer_band_summary(df, ["grp"], "id", "size", "v").collect()}
        seen.add(tuple(sorted(got.items())))
    assert len(seen) == 1
    want = {1: (3, (1.25 - 1e16) / 3), 2: (3, 0.25 / 3), 3: (3, (1e16 + 1.25) / 3), 4: (3, 1 / 3), 5: (1, 2.5), 6: (1, 3e20), 7: (0, None)}
    assert set(got) == set(want) and all(got[k][0] == n and (got[k][1] == m if m is None else got[k][1] == pytest.approx(m, rel=1e-15)) for k, (n, m) in want.items())


def test_all_pairs_equal_the_pairs(spark):
    r = random.Random(3)
    labels = list("abcdef")
    rows = [(r.choice(labels[:5] + ["other"]), r.choice([None, *range(12)])) for _ in range(300)] + [("e", 5)] * 40
    got = {(x.a, x.b): x for x in inference.rank_comparisons(spark.createDataFrame(rows, "g string, v long").repartition(4), "g", "v", labels).collect()}
    assert set(got) == set(combinations(labels, 2))
    for (a, b), x in got.items():
        va, vb = ([v for g, v in rows if g == name and v is not None] for name in (a, b))
        u = sum((p > q) + (p == q) / 2 for p in va for q in vb)
        assert (x.n_a, x.n_b, x.u) == (len(va), len(vb), u)
        if not vb:
            assert x.cliffs_delta is None and x.z is None
            continue
        n = len(va) + len(vb)
        ties = sum(t**3 - t for t in ((va + vb).count(v) for v in set(va + vb)))
        sd = (len(va) * len(vb) / 12 * (n + 1 - ties / (n * (n - 1)))) ** 0.5
        assert x.cliffs_delta == pytest.approx(2 * u / (len(va) * len(vb)) - 1) and x.z == pytest.approx(max(abs(u - len(va) * len(vb) / 2) - 0.5, 0) / sd)
