"""The queries of the text operators, each over its whole table, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@registered("op3_line_dedup", """
with lines as (
  select doc_id, generate_subscripts(parts, 1) pos, unnest(parts) line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) parts from documents)),
keyed as (
  select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
hot as (select k, max(doc_id) keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select doc_id, count(*)::bigint n_lines, count(*) filter (where keeper <> doc_id)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where keeper is null or keeper = doc_id), '')) kept_sha256
from keyed left join hot using (k) group by doc_id""")
def op3(spark, folder):
    from .line_dedup import dedup_lines
    out = dedup_lines(read(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@registered("op10_jaccard_join")
def op10(spark, folder):
    from .jaccard_join import similarity_classes
    return similarity_classes(read(spark, folder, "documents"))


@registered("op9_toxicity")
def op9(spark, folder):
    from .toxicity import held_out, score_toxicity, train
    docs = read(spark, folder, "documents")
    scored = score_toxicity(docs, train(docs, read(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@registered("op2_decontaminate")
def op2(spark, folder):
    from .decontaminate import contaminated
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@registered("op4_byte_bpe")
def op4(spark, folder):
    from .merge_replay import encode
    ids = encode(read(spark, folder, "documents").select("doc_id", "text"), and_decode=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@registered("op8_topk_search", """
with sound as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id query_id, c.vec_id vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score
  from sound q join sound c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from scored) where rank <= 5""")
def op8(spark, folder):
    from .topk_search import top_k
    return top_k(read(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


@registered("op1_sharding")
def op1(spark, folder):
    from .sharding import shard
    return shard(read(spark, folder, "documents"))


@registered("op5_token_files")
def op5(spark, folder):
    from .token_files import checksums, fresh_path, read_tokens, write_tokens
    path = fresh_path(spark)
    write_tokens(read(spark, folder, "documents"), path)
    return checksums(read_tokens(spark, path))


@registered("op6_language_crf")
def op6(spark, folder):
    from .language_crf import label_languages, train
    from .toxicity import held_out
    docs = read(spark, folder, "documents")
    return label_languages(docs, *train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@registered("op7_token_counts")
def op7(spark, folder):
    from .trie_counts import count_tokens
    return count_tokens(read(spark, folder, "documents"))


@registered("op11_alignment")
def op11(spark, folder):
    from .alignment import align
    return align(read(spark, folder, "documents"))


@registered("op12_simhash")
def op12(spark, folder):
    from .simhash import simhash_classes
    return simhash_classes(read(spark, folder, "documents"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@registered("op13_ranked_search", f"""
with d as (select row_number() over () rid, doc_id, {_TERMS} w from documents),
sizes as (select rid, doc_id, len(w) n from d where len(w) > 0),
corpus as (select count(*) nd, sum(n)::bigint l from sizes),
q as (select distinct item_id, unnest({_TERMS}) term from benchmark),
p as (select rid, term, count(*) tf from (select rid, unnest(w) term from d) where term in (select term from q) group by rid, term),
weights as (select term, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)))::bigint w from (select term, count(*) df from p group by term), corpus),
lengths as (select rid, doc_id, 50 + (50 * n * nd) // l m from sizes, corpus),
scores as (
  select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score
  from q join p using (term) join weights using (term) join lengths using (rid) group by item_id, rid, doc_id)
select item_id, rank::int rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from scores where score > 0) where rank <= 50""")
def op13(spark, folder):
    from .ranked_search import rank_documents
    return rank_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
