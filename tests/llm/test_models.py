import random

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import language_crf as L
from cohortlens.llm import toxicity as X

from .conftest import prose


def test_network_gradients():
    texts = [prose(i, n) for i, n in enumerate((3, 70, 130))]
    raw = [t.encode() for t in texts]
    block = X.Block(X.Words("alnum", latin=True), np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    net = X.Network.fresh(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    windows, y = np.arange(len(block.owner)), np.arange(len(block.owner)) % 2

    def loss():
        z = net.window_logits(block).astype(float)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = net.gradients(block, windows, y.astype(np.float32))
    r = np.random.default_rng(0)
    for name in ("xf", "hf", "hb", "cb", "attend", "out", "bias"):
        at = tuple(r.integers(0, n) for n in net.w[name].shape)
        old, step = net.w[name][at], 1e-2
        net.w[name][at] = old + step
        up = loss()
        net.w[name][at] = old - step
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at]), name


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        raw = ("w " * n).encode()
        b = X.Block(X.Words("alnum"), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        covered = {k for s, m in zip(b.begin, b.size, strict=True) for k in range(s, s + m)}
        assert covered == set(range(n)) and len(b.owner) == max(1, 1 + -(-(n - 64) // 32))
        assert all(any(s <= k and k + 33 <= s + m for s, m in zip(b.begin, b.size, strict=True)) for k in range(n - 32))


def test_toxicity_held_out_and_odd_rows(spark, odd):
    r = random.Random(9)
    texts = []
    for i in range(700):
        w = prose(i, r.randint(3, 400)).split()
        toxic = i % 4 == 0
        for _ in range(1 + len(w) // 100 if toxic else 0):
            w[r.randrange(len(w))] = "zorq" + r.choice(["a", "el", "ix", "oma"])
        texts.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    net = X.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = X.score_toxicity(df.drop("toxic"), net).join(df, "doc_id").filter(X.held_out(F.col("doc_id"))).collect()
    assert np.mean([g.predicted == g.toxic for g in got]) > 0.97 and all((g.score >= 0.3) == g.predicted for g in got)
    scored = X.score_toxicity(odd, net)
    assert scored.count() == odd.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert X.score_toxicity(odd.limit(0), net).count() == 0 and X.drop_toxic(odd, net).columns == odd.columns
    nothing = X.train(df.limit(0).drop("toxic"), df.limit(0).select("doc_id", "toxic"))
    assert X.score_toxicity(odd, nothing).filter("predicted = 1").count() == 0


def test_language_field(spark, odd, documents):
    labels, field = L.train(documents)
    got = L.label_languages(documents, labels, field).join(documents.select("doc_id", "lang"), "doc_id").filter(L.held_out(F.col("doc_id"))).collect()
    assert np.mean([g.lang == g.lang_pred for g in got]) > 0.9
    strange = L.label_languages(odd, labels, field, words=True).collect()
    assert len(strange) == odd.count() and all(0 <= g.score <= 1 and g.lang_pred in [*labels, "und"] for g in strange)
    text = {r.doc_id: r.text for r in odd.collect()}
    assert all((g.lang_pred == "und") == (not any(c.isalpha() for c in text[g.doc_id] or "")) for g in strange if g.doc_id not in (3, None))
    assert L.label_languages(odd.limit(0), labels, field).count() == 0
    none = L.train(documents.limit(0))
    assert {g.lang_pred for g in L.label_languages(odd, *none).collect()} == {"und"}


def test_code_switched_words(spark, documents):
    labels, field = L.train(documents)
    parts = {r.lang: " ".join(r.text.split()[:12]) for r in documents.orderBy("doc_id").collect()}
    a, b = parts["en"], parts["de"]
    row = L.label_languages(spark.createDataFrame([(1, f"{a} {b}".replace("\n", " "))], "doc_id long, text string"), labels, field, words=True).first()
    half = len(row.labels) // 2
    assert row.labels[: half - 3].count("en") > 0.8 * (half - 3) and row.labels[half + 4:].count("de") > 0.7 * (half - 4)


def test_forward_backward_equals_enumeration():
    import itertools
    r = np.random.default_rng(2)
    f = L.Field(np.zeros((1, 3), np.float32), r.standard_normal((3, 3)), r.standard_normal(3))
    e = np.exp(r.standard_normal((4, 1, 3)))
    p, pair = f.forward_backward(e, np.ones((4, 1), bool), pairs=True)
    want, two = np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(f.first[path[0]] + sum(f.move[a, b] for a, b in itertools.pairwise(path))) * np.prod([e[t, 0, s] for t, s in enumerate(path)])
        for t, s in enumerate(path):
            want[t, s] += w
        for a, b in itertools.pairwise(path):
            two[a, b] += w
    z = want[0].sum()
    assert np.allclose(p[:, 0], want / z) and np.allclose(pair, two / z)
