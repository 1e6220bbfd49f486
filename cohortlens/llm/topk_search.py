"""Exact top-k search: score everything, refine score histograms to each query's kth value, filter, break ties.

Queries and candidates meet in tiles: candidates in groups of about ``ROWS``, queries in groups of about
``QUERIES``, each pair of groups one bounded task unit scored as a matrix product. Every round scores all
tiles. A refining round counts, per query, how many scores fall in each of ``BINS`` equal bins of the query's current range; the
bin that holds the kth largest becomes the next range, until it is one integer wide. A tile sends only its bins down
to its own kth score: what lies lower cannot hold the kth of all. The last round keeps scores at or above the kth
value, at most k a tile with the smaller id first, and a ranked window ends it.

Products are sums of integers: in float64 while no score can pass 2**53, in int64 beyond that, and refused where a score
could pass int64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.lineage import cut

ROWS, QUERIES = 4096, 1024
BINS = 4096
LIMIT = 1 << 61  # of a score: ranges of scores are added and doubled in int64


def whole_vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component. Null or empty vectors, vectors with null or non-finite components
    and rows without vec_id are left out."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v")))


def matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    whole = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return whole.astype(np.int64) if pa.types.is_integer(column.type.value_type) else whole


def tiles(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int):
    """Both sides dealt to the tiles (dim, q, c); vectors of other lengths do not meet."""
    nq, nc = max(1, -(-n_queries // QUERIES)), max(1, -(-n_rows // ROWS))
    left = queries.withColumns({"q": F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int"), "c": F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))})
    right = rows.withColumns({"c": F.pmod(F.xxhash64("vec_id"), F.lit(nc)).cast("int"), "q": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))})
    return (side.withColumn("dim", F.size("v")).groupBy("dim", "q", "c") for side in (left, right))


def strips(left: pa.Table, right: pa.Table):
    """(query rows, scores) in strips of bounded size; a query's own row scores below all others."""
    a, b = matrix(left), matrix(right)
    own, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
    step = max(1, (1 << 20) // max(1, len(ids)))
    for lo in range(0, len(own), step):
        scores = a[lo: lo + step] @ b.T
        scores[own[lo: lo + step][:, None] == ids[None, :]] = -np.inf if scores.dtype.kind == "f" else -LIMIT - 1
        yield np.arange(lo, min(lo + step, len(own))), scores


def top_k(rows: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other rows, all if fewer.

    rows (vec_id, embedding); ``is_query`` is a condition on vec_id. Ties go to the smaller vec_id. Rows that repeat a
    vec_id are candidates each (with equal scores, both are listed) and never their own; repeated query rows count once.
    Empty input gives no rows. Vectors so long that a score may pass ``LIMIT`` are an error, not a rounded score.
    """
    all_rows = cut(whole_vectors(rows, scale))
    queries = all_rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.max("v").alias("v"))
    n_rows, n_queries = all_rows.count(), queries.count()
    # by the inequality of Cauchy and Schwarz no score lies beyond the largest squared length
    reach = all_rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    if reach is None:
        return all_rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    if reach >= LIMIT:
        raise ValueError(f"integer scores may reach {reach:.3g}, beyond {LIMIT}: choose a smaller scale")
    if reach >= 1 << 52:
        all_rows = cut(all_rows.withColumn("v", F.transform("v", lambda x: x.cast("long"))))
        queries = all_rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.max("v").alias("v"))
    # lo: the lowest score of the range, need: which of the scores in it (1 = largest) is wanted
    state = cut(queries.select("query_id", "v", F.lit(-int(reach) - 1).cast("long").alias("lo"), F.lit(k).cast("long").alias("need")))
    width = 2 * (int(reach) + 1) + 1
    while width > 1:
        step = -(-width // BINS)
        state = cut(refined(state, all_rows, n_queries, n_rows, step, width, k))
        width = step
    left, right = tiles(state, all_rows, n_queries, n_rows)

    def last(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if a.num_rows and b.num_rows:
            ids, floor, own = b.column("vec_id").to_numpy(), a.column("lo").to_numpy(), a.column("query_id").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            b = b.take(pa.array(by_id))
            ids = ids[by_id]
            for which, scores in strips(a, b):
                for i, s in zip(which, scores, strict=True):
                    good = np.flatnonzero(s >= floor[i])
                    good = good[np.argsort(-s[good], kind="stable")][:k]
                    out[0].append(np.full(len(good), own[i])), out[1].append(ids[good]), out[2].append(s[good])
        return pa.table([pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    kept = left.cogroup(right).applyInArrow(last, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def refined(state: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, step: int, width: int, k: int) -> DataFrame:
    """The state with each query's range narrowed to the bin (``step`` wide) that holds the wanted score."""
    left, right = tiles(state, rows, n_queries, n_rows)

    def histogram(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if a.num_rows and b.num_rows:
            lo, need, own = (a.column(c).to_numpy() for c in ("lo", "need", "query_id"))
            for which, scores in strips(a, b):
                for i, s in zip(which, scores, strict=True):
                    inside = s[(s >= lo[i]) & (s < lo[i] + width)]
                    if len(inside) > need[i]:  # bins below this tile's own candidate cannot hold the wanted score
                        bound = np.partition(inside, len(inside) - need[i])[len(inside) - need[i]]
                        inside = inside[inside >= lo[i] + (bound - lo[i]) // step * step]
                    bins, count = np.unique(((inside - lo[i]) // step).astype(np.int64), return_counts=True)
                    out[0].append(np.full(len(bins), own[i])), out[1].append(bins), out[2].append(count)
        return pa.table([pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in out], ["query_id", "bin", "n"])

    counts = left.cogroup(right).applyInArrow(histogram, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # at most BINS rows a query
    placed = counts.withColumn("upto", F.sum("n").over(above)).withColumnRenamed("query_id", "_q")
    hit = placed.join(state.select(F.col("query_id").alias("_q"), "need"), "_q").filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    hit = hit.select("_q", "bin", (F.col("need") - (F.col("upto") - F.col("n"))).alias("rest"))
    # fewer than k other rows: the range's lowest score stays the floor
    return (state.join(hit, F.col("query_id") == F.col("_q"), "left")
            .select("query_id", "v", F.when(F.col("_q").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("bin") * step).alias("lo"),
                    F.coalesce("rest", "need").alias("need")))
