import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import merge_replay, pretokens, trie_counts
from cohortlens.llm.token_files import checksums, fresh_path, lookup, read_tokens, write_tokens


@pytest.fixture(scope="module")
def all_rows(odd, documents):
    return odd.select("doc_id", "text").unionByName(documents.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))


def test_bpe_equals_tiktoken(odd, all_rows):
    ranks = merge_replay.read_ranks(P.path(merge_replay.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) if r.doc_id is not None else (-1, library.encode_ordinary(r.text), r.text.encode()) for r in all_rows.collect())
    got = merge_replay.decode(merge_replay.encode(all_rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == want
    both = merge_replay.encode(all_rows, and_decode=True).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))
    assert merge_replay.encode(odd).columns == ["doc_id", "lang", "source", "node", "n_tokens", "ids"]


def test_replay_leaves_rank_order_when_the_vocabulary_does():
    single = {bytes([i]): 100 + i for i in range(256)}
    vocabulary = merge_replay.Vocabulary({**single, b"bc": 400, b"abc": 1, b"abcd": 0, b"aa": 5, b"aaaa": 2})
    words = [b"abcd", b"abcabcd", b"aaaaaaa", b"aabcaaaabc", b"", b"zabcz"]
    raw, at = np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum([len(w) for w in words])]
    ids, out = merge_replay.replay(vocabulary, raw, at)
    for i, w in enumerate(words):
        assert ids[out[i]:out[i + 1]].tolist() == merge_replay.alone(vocabulary, vocabulary.of_byte[np.frombuffer(w, np.uint8)]).tolist()


def test_small_blocks_give_the_same(all_rows, monkeypatch):
    want = sorted(map(str, merge_replay.encode(all_rows).collect()))
    monkeypatch.setattr(pretokens.piece_blocks, "__defaults__", (50,))
    assert sorted(map(str, merge_replay.encode(all_rows).collect())) == want


def test_token_files(spark, all_rows):
    path = fresh_path(spark)
    rows = all_rows.filter("doc_id is not null and doc_id <> 3")
    write_tokens(rows.repartition(3), path)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in checksums(read_tokens(spark, path)).collect())
    library, start, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    one = lookup(spark, path, [1005])
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()
    assert [r.n_tokens for r in one.collect()] == [w[2] for w in want if w[0] == 1005]
    empty = fresh_path(spark)
    write_tokens(rows.limit(0), empty)
    assert read_tokens(spark, empty).count() == 0


def test_unigram_counts_equal_the_definition(all_rows):
    weight = trie_counts.weights(merge_replay.read_ranks(P.path(trie_counts.VOCABULARY)))
    longest, pattern = max(map(len, weight)), regex.compile(P.PATTERN)
    memo = {}

    def whole(text):
        parts = pattern.findall(text or "")
        for p in parts:
            if p not in memo:
                memo[p] = trie_counts.singly(p.encode(), weight, longest)
        return len(parts), sum(memo[p][1] for p in parts), sum(memo[p][0] for p in parts)

    want = sorted(str((r.doc_id, *whole(r.text))) for r in all_rows.collect())
    assert sorted(str(tuple(r)) for r in trie_counts.count_tokens(all_rows).collect()) == want
    assert trie_counts.count_tokens(all_rows.limit(0)).count() == 0


def test_zipf_weights_prefer_fewer_tokens():
    weight = {b"a": 11, b"b": 11, b"ab": 21, b"c": 5, b"abc": 27}
    assert trie_counts.singly(b"ab", weight, 3) == (21, 1) and trie_counts.singly(b"abc", weight, 3) == (26, 2)


def test_a_column_named_like_the_pre_tokens(odd):
    named = odd.withColumnRenamed("node", "_pieces")
    got = merge_replay.encode(named, and_decode=True)
    assert got.columns[:4] == ["doc_id", "lang", "source", "_pieces"]
    plain = merge_replay.encode(odd, and_decode=True)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, plain.collect())))
