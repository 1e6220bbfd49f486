import hashlib

import corpus_pipeline
import duckdb
import numpy as np

from cohortlens.llm import registered
from cohortlens.operators.lineage import cut

from .test_jaccard_join import brute as similar
from .test_line_dedup import brute as deduped

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "byte_bpe"]
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    states = [source]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        states.append(cut(stage(spark, states[-1], FOLDER)))
        assert states[-1].columns == source.columns
    texts = [{r.doc_id: r.text for r in s.collect()} for s in states]
    toxic = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 0").collect()}
    gone = set(texts[0]) - set(texts[1])
    assert len(gone & toxic) <= 2 and all(texts[1][i] == texts[0][i] for i in texts[1])
    want = {i: h for i, _, _, h in deduped(list(texts[1].items()))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts[2].items()} == want
    assert set(texts[3]) == {i for i, _, c in similar(list(texts[2].items())) if i == c}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not [i for i, t in texts[4].items() if any(x in t for x in items)]
    final = corpus_pipeline.STAGES[-1][1](spark, states[-1], FOLDER).collect()
    assert {r.doc_id for r in final} == set(texts[4]) and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in final)
    assert sum(r.n_tokens for r in final) == sum(len(np.frombuffer(r.ids, "<u4")) for r in final)


def test_registered_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    for name, sql in registered.ORACLES.items():
        df = registered.QUERIES[name](spark, FOLDER)
        cur = con.execute(sql)
        at = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall()), name
    assert {n.split("_")[0] for n in registered.QUERIES} == {f"op{i}" for i in range(1, 14)}
