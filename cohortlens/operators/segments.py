"""Segmentation: k-means of many starts in shared scans, mixtures from Spark ML's starts, choice of k, stability and sensitivity.

The silhouette is Spark's squared-Euclidean one, which needs only cluster sums; the plain Euclidean
form would compare every pair of rows.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inference import adjusted_rand, adjusted_rand_of_cells
from .lineage import cut
from .linear import standardise
from .lloyd import Clusters, best_kmeans, crossed_labels, many_kmeans
from .mixtures import Mixture, continued_together
from .resample import uniform


def feature_vectors(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """Complete rows, standardised with the population sd, as one vector column."""
    if df.dropna(subset=cols).isEmpty():
        raise ValueError("no complete rows to segment")
    z = standardise(df.dropna(subset=cols).select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]), cols)
    return cut(VectorAssembler(inputCols=cols, outputCol="features").transform(z).drop(*cols))


def fit_kmeans(v: DataFrame, k: int | list[int], seeds: tuple[int, ...] = tuple(range(10)), max_iter: int = 40) -> Clusters | list[Clusters]:
    """Best of several seeds by within-cluster cost, one for each k of a list. All share the scans. A start tells rows apart by the columns of ``v``."""
    names = F.xxhash64(*[c for c in v.columns if c != "features"], vector_to_array("features"))
    rows = cut(v.select(names.alias("id"), vector_to_array("features").alias("x"), F.array(F.lit(True)).alias("inside")).repartition(v.sparkSession.sparkContext.defaultParallelism))
    fits = best_kmeans(rows, [k] if isinstance(k, int) else k, list(seeds), max_iter)
    return fits[0] if isinstance(k, int) else fits


def points(v: DataFrame) -> DataFrame:
    """(x) the features of ``v`` as arrays, written once, dealt to all cores."""
    return cut(v.select(vector_to_array("features").alias("x")).repartition(v.sparkSession.sparkContext.defaultParallelism))


def fit_mixture(v: DataFrame, k: int | list[int], seeds: tuple[int, ...] = tuple(range(5)), max_iter: int = 50, rows: DataFrame | None = None) -> Mixture | list[Mixture]:
    """Best of several seeds by likelihood, one for each k of a list. Spark ML makes every start and its first step, the others run in shared scans of ``rows``, the ``points`` of ``v``."""
    ks = [k] if isinstance(k, int) else k
    with ThreadPool(8) as pool:
        first = pool.starmap(lambda j, s: GaussianMixture(k=j, seed=s, maxIter=1).fit(v), [(j, s) for j in ks for s in seeds], chunksize=1)
    grown = continued_together(points(v) if rows is None else rows, [first[i: i + len(seeds)] for i in range(0, len(first), len(seeds))], max_iter)
    best = [max(g, key=lambda m: m.summary.logLikelihood) for g in grown]
    return best[0] if isinstance(k, int) else best


def segment(df: DataFrame, cols: list[str], keep: list[str], k: int, seeds: tuple[int, ...] = tuple(range(10))) -> DataFrame:
    """Rows with their segment."""
    v = feature_vectors(df, cols, keep)
    return fit_kmeans(v, k, seeds).transform(v).select(*keep, F.col("prediction").alias("segment"))


def mixture_bic(model, n: int, p: int) -> float:
    params = model.getK() * (p + p * (p + 1) / 2) + model.getK() - 1
    return -2 * model.summary.logLikelihood + params * math.log(n)


def selection_table(v: DataFrame, ks: list[int], p: int, seeds: tuple[int, ...] = tuple(range(20)), mixture: bool = True,
                    mixture_seeds: tuple[int, ...] = tuple(range(3))) -> DataFrame:
    """Per k: inertia, silhouette, mixture BIC and the smallest cluster."""
    n = v.count()
    bics = [mixture_bic(m, n, p) for m in fit_mixture(v, ks, mixture_seeds)] if mixture else [None] * len(ks)
    fits = fit_kmeans(v, ks, seeds)

    def silhouette(m: Clusters) -> float:
        return float(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(m.transform(v)))

    with ThreadPool(min(4, len(ks))) as pool:
        shapes = pool.map(silhouette, fits, chunksize=1)
    rows = [(k, float(m.summary.trainingCost), shape, bic, int(min(m.summary.clusterSizes))) for k, m, shape, bic in zip(ks, fits, shapes, bics, strict=True)]
    return v.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, bic double, smallest int")


def choose_k(table: DataFrame, min_k: int = 6, min_size: int = 30) -> int | None:
    """Best silhouette among the k that are large enough and leave no small cluster."""
    r = table.filter((F.col("k") >= min_k) & (F.col("smallest") >= min_size)).agg(F.max_by("k", "silhouette")).collect()[0][0]
    return r


def stability(v: DataFrame, entity: str, k: int, runs: int = 30, share: float = 0.8, seed: int = 0, starts: int = 10) -> DataFrame:
    """Adjusted Rand index between the full fit and fits on random subsamples: (run, n, ari).

    The full fit and all runs, each from ``starts`` starts, are fitted side by side in shared scans. An entity stands once.
    """
    inside = [F.lit(True), *[uniform(seed, r, entity) < share for r in range(runs)]]
    rows = cut(v.select(F.xxhash64(entity).alias("id"), vector_to_array("features").alias("x"), F.array(*inside).alias("inside")))
    seeds = [*range(starts), *[seed + r + i for r in range(runs) for i in range(starts)]]
    fits = many_kmeans(rows, k, seeds, [s for s in range(runs + 1) for _ in range(starts)])
    cells = crossed_labels(rows, fits, 0, list(range(1, runs + 1)))
    return adjusted_rand_of_cells(cells, "sample", "a", "b").select("n", "ari", (F.col("sample") - 1).cast("int").alias("run"))


def mixture_agreement(v: DataFrame, entity: str, k: int, seed: int = 0) -> DataFrame:
    """Adjusted Rand index between k-means and a Gaussian mixture of the same size."""
    a = fit_kmeans(v, k).transform(v).select(entity, F.col("prediction").alias("a"))
    b = fit_mixture(v, k, tuple(seed + i for i in range(5))).transform(v).select(entity, F.col("prediction").alias("b"))
    return adjusted_rand(a.join(b, entity), "a", "b")


def added_block_sensitivity(df: DataFrame, base: list[str], added: list[str], entity: str, k: int, seeds: tuple[int, ...] = tuple(range(10))) -> DataFrame:
    """Agreement of the segmentation with and without an added feature block."""
    a = segment(df, base, [entity], k, seeds).withColumnRenamed("segment", "a")
    b = segment(df, [*base, *added], [entity], k, seeds).withColumnRenamed("segment", "b")
    return adjusted_rand(a.join(b, entity), "a", "b")


def distance_to_centre(v: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """Euclidean distance of every row to its own centre."""
    m = fit_kmeans(v, k)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in m.clusterCenters()])
    own = F.get(centres, F.col("prediction"))
    gap = F.zip_with(vector_to_array("features"), own, lambda a, b: (a - b) * (a - b))
    d = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x))
    return m.transform(v).select(*keep, F.col("prediction").alias("segment"), d.alias("distance"))
