import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import alignment, units
from cohortlens.llm.alignment import align, lockstep

from .conftest import prose

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def token_bytes():
    known = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(byte_letters())}
    a = {i: bytes(letters[c] for c in t) for t, i in known.get_vocab(with_added_tokens=False).items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    b = {i: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in range(pieces.get_piece_size()) for p in [pieces.id_to_piece(i)]}
    return known, pieces, a, b


def byte_letters():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


def ends(tokens):
    return np.cumsum([len(t) for t in tokens]).tolist()


def brute(rows):
    known, pieces, a_bytes, b_bytes = token_bytes()
    docs, total = [], Counter()
    for doc, text in rows:
        if not text:
            docs.append((doc, [], [], [], []))
            continue
        a, b = known.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        whole = (" " + text).encode()
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            docs.append((doc, [], [], [], []))
            continue
        ea, eb = ends([a_bytes[i] for i in a]), ends([b_bytes[i] for i in b])
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links, lo = [], 0
        for i in range(len(a)):
            while eb[lo] <= sa[i]:
                lo += 1
            j = lo
            while j < len(b) and sb[j] < ea[i]:
                links.append((a[i], b[j]))
                j += 1
        docs.append((doc, a, b, links, sorted(set(ea) & set(eb))))
        docs[-1] += (ea, eb)
        total.update(links)
    best = Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    out = []
    for doc, a, b, links, cuts, *both in docs:
        digest = ""
        if a:
            parts, lo = [], 0
            for c in cuts:
                parts.append(",".join(str(i) for i, e in zip(a, both[0], strict=True) if lo < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, both[1], strict=True) if lo < e <= c))
                lo = c
            digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
        out.append((doc, len(a), len(b), len(cuts), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), digest))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in align(df).select(*COLUMNS).collect()), key=str)


EXTRA = ["▁ mark", "a ▁b c", "x</s> <s><0x41> <unk>", "tail ", " head", "  two  spaces   ", "a  b　 c  d\u0085 e", "é è\x00 \x1f \x7f z", "  é é x", "ź ́ a", " ", "   ", "a b" * 300]


def test_against_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.text is None or len(r.text) < 4000]
    rows += [(200 + i, t) for i, t in enumerate(EXTRA)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_documents_in_small_batches(documents, monkeypatch):
    some = documents.select("doc_id", "text").filter(F.length("text") < 4000)
    want = brute([(r.doc_id, r.text) for r in some.collect()])
    monkeypatch.setattr(alignment, "BATCH_LINKS", 900)
    monkeypatch.setattr(alignment, "LANE", 37)
    assert result(some.repartition(3)) == want


def test_counts_do_not_depend_on_memory(documents, monkeypatch):
    want = result(documents.select("doc_id", "text"))
    monkeypatch.setattr(units.UnitIds.__init__, "__defaults__", (5,))
    monkeypatch.setattr(units, "CHUNK", 3)
    assert result(documents.repartition(5)) == want


def test_clashing_columns_and_no_rows(spark, odd):
    names = ["pairs", "batch", "n_a", "steps"]
    assert align(odd.withColumns({c: F.lit("x") for c in names})).columns == COLUMNS
    assert align(odd).count() == odd.count()
    assert align(odd.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in align(nothing).collect()))) == sorted(map(str, [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_lockstep_meets_every_overlap(size):
    r = random.Random(size)
    for _ in range(30):
        doc_at, a, b = [0], [], []
        for _ in range(r.randrange(1, 6)):
            n = r.choice([0, 1, 3, 20, 60])
            for out in (a, b):
                if n:
                    out += sorted({doc_at[-1] + x for x in r.sample(range(1, n), r.randrange(0, n))} | {doc_at[-1] + n})
            doc_at.append(doc_at[-1] + n)
        la, lb, ca, cb = lockstep(np.array(a, np.int64), np.array(b, np.int64), np.array(doc_at), size)
        start = lambda e, i: e[i - 1] if i else 0
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if start(a, i) < b[j] and start(b, j) < a[i]}
        assert sorted(zip(la.tolist(), lb.tolist(), strict=True)) == sorted(want)
        assert sorted((a[i], b[j]) for i, j in zip(ca.tolist(), cb.tolist(), strict=True)) == [(x, x) for x in sorted(set(a) & set(b))]


def test_units_join_to_the_text_and_cut_after_solid_characters_only():
    texts = ["a b  c", "a  b", "　 x é y", "", "tab\t z", prose(3, 50)]
    raw, at = units.spaced(np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in texts])])
    start, solid = units.cut_units(raw, at)
    parts = [bytes(raw[a:b]).decode() for a, b in zip(start, np.r_[start[1:], len(raw)], strict=True)]
    assert "".join(parts) == "".join(" " + t for t in texts)
    assert parts[:6] == [" a", " b", "  c", " a  b", " 　 x", " é"] and " tab\t z" in parts
    assert all((ok > 0) == (not p[-1].isspace()) or p[-1] > "\x7f" for p, ok in zip(parts, solid, strict=True))
    start, _ = units.cut_units(*(np.frombuffer(b"it's (a)b, c.\n\nd, e1;f", np.uint8), np.array([0, 22])), fine=True)
    assert start.tolist() == [0, 4, 7, 9, 10, 12, 13, 16, 17]
