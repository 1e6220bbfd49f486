"""Many k-means fits in the scans of one: all starts and subsamples step together.

The centres of all models are stacked. A scan assigns each row under every model that has not settled, adds up the rows of
each cluster by task, and sends sums whose size does not depend on the rows. Starts are k-means++: in a scan every row draws a
number from its own hash, scaled by its distance, and the smallest of all tasks is the next centre - a weighted draw
that does not depend on how rows are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # rows at a time


@dataclass
class Fits:
    """Per model: centres (model, k, dim), cost, scans of Lloyd steps, and the sample it saw."""
    centres: np.ndarray
    cost: np.ndarray
    steps: np.ndarray
    sample: np.ndarray

    def best(self, sample: int) -> int:
        own = np.flatnonzero(self.sample == sample)
        return int(own[np.argmin(self.cost[own])])


def draws(ids: np.ndarray, seed: np.ndarray, step: int) -> np.ndarray:
    """(rows, seeds) uniform numbers in (0, 1) from the hash of (id, seed, step)."""
    u = np.uint64
    x = ids.astype(np.int64).view(u)[:, None] * u(0x9E3779B97F4A7C15) ^ seed.astype(np.int64).view(u)[None, :] * u(0xC2B2AE3D27D4EB4F) ^ u(step * 0x165667B19E3779F9 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(shift))) * u(factor)
    return ((x ^ (x >> u(31))) >> u(11)).astype(float) / (1 << 53) + 2.0**-54


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, models, k) squared distances."""
    m, k, d = centres.shape
    flat = centres.reshape(m * k, d)
    out = x @ flat.T  # one array, changed in place: it is the largest there is
    out *= -2.0
    out += (x * x).sum(1)[:, None]
    out += (flat * flat).sum(1)[None]
    return np.maximum(out, 0, out=out).reshape(len(x), m, k)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, models) the first of the nearest centres. Centre by centre over all rows: a minimum along a short last axis is slow."""
    m, k, d = centres.shape
    flat = centres.transpose(1, 0, 2).reshape(k * m, d)
    far = flat @ x.T  # without the rows' own squares, which change no comparison
    far *= -2.0
    far += (flat * flat).sum(1)[:, None]
    far = far.reshape(k, m, len(x))
    least, label = far[0], np.zeros((m, len(x)), np.int64)
    for j in range(1, k):
        np.copyto(label, j, where=far[j] < least)
        np.minimum(least, far[j], out=least)
    return label.T


def cluster_sums(x: np.ndarray, label: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """(models, k, dim + 1): sums of x and the number of rows by cluster; label and inside are (rows, models)."""
    models, size = label.shape[1], label.shape[1] * k
    place = (label + np.arange(models) * k).ravel()
    out = [np.bincount(place, (inside * x[:, c, None]).ravel(), size) for c in range(x.shape[1])]
    return np.stack([*out, np.bincount(place, inside.ravel(), size)], axis=1).reshape(models, k, -1)


def _blocks(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            n = part.num_rows
            yield (part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(n, -1),
                   part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1))


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over tasks of ``make(blocks)``, an array of ``size`` numbers a task."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(make(_blocks(batches)), float).ravel()], pa.list_(pa.float64()))], ["v"])

    return rows.mapInArrow(run, "v array<double>").toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0)


def starts(rows: DataFrame, k: int, seed: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """k-means++ centres of every model: each of the k scans draws one more, by the squared distance to those there are."""
    m, centres = len(seed), None
    for step in range(k):
        def run(batches, centres=centres, step=step):
            key, point = np.full(m, np.inf), None
            for ids, x, inside in _blocks(batches):
                point = np.zeros((m, x.shape[1])) if point is None else point
                weight = np.ones((len(x), m)) if centres is None else distances(x, centres).min(axis=2)
                with np.errstate(divide="ignore"):
                    drawn = np.where(inside[:, sample] & (weight > 0), -np.log(draws(ids, seed, step)) / weight, np.inf)
                at = drawn.argmin(axis=0)
                here = drawn[at, np.arange(m)]
                better = here < key
                key[better], point[better] = here[better], x[at[better]]
            if point is not None:
                good = np.flatnonzero(np.isfinite(key))
                yield pa.RecordBatch.from_arrays([pa.array(good), pa.array(key[good]), pa.array(list(point[good]), pa.list_(pa.float64()))], ["model", "key", "point"])

        first = rows.mapInArrow(run, "model long, key double, point array<double>").groupBy("model").agg(F.min_by("point", "key").alias("point")).collect()
        if step == 0 and len(first) < m:
            raise ValueError("a sample without rows cannot be clustered")
        found = {r["model"]: r["point"] for r in first}
        # fewer distinct points than clusters: the last centre stands twice
        new = np.array([found.get(i, None if centres is None else centres[i, -1].tolist()) for i in range(m)])
        centres = new[:, None, :] if centres is None else np.concatenate([centres, new[:, None, :]], axis=1)
    return centres


def several_kmeans(rows: DataFrame, ks: list[int], seed: list[int], sample: list[int], max_iter: int = 40, tolerance: float = 1e-4) -> list[Fits]:
    """k-means for every (seed, sample) and every number of clusters side by side: the fits of each of ``ks``.

    rows (id long, x array<double>, inside array<boolean>): sample j holds the rows with inside[j]. A model has settled when no
    centre moves by more than ``tolerance``, or after ``max_iter`` steps; a cluster that loses all rows keeps its centre. The starts
    of a seed are the first centres of one draw, whatever the number of clusters.
    """
    rows = rows.select("id", "x", "inside")
    seed, sample = np.asarray(seed, np.int64), np.asarray(sample, np.int64)
    begun = starts(rows, max(ks), seed, sample)
    m, _, d = begun.shape
    fits = [Fits(begun[:, :k].copy(), np.zeros(m), np.zeros(m, np.int64), sample) for k in ks]
    active = [np.arange(m) for _ in ks]
    for _ in range(max_iter):
        now = [(f.centres[own], sample[own]) for f, own in zip(fits, active, strict=True) if len(own)]

        def sums(blocks, now=now):
            total = [np.zeros((*c.shape[:2], d + 1)) for c, _ in now]
            for _, x, inside in blocks:
                for t, (c, own) in zip(total, now, strict=True):
                    t += cluster_sums(x, nearest(x, c), inside[:, own], c.shape[1])
            return np.concatenate([t.ravel() for t in total])

        sizes = [c.shape[0] * c.shape[1] * (d + 1) for c, _ in now]
        parts = iter(np.split(_summed(rows, sums, sum(sizes)), np.cumsum(sizes)[:-1]))
        for j, (f, own) in enumerate(zip(fits, active, strict=True)):
            if not len(own):
                continue
            total = next(parts).reshape(len(own), -1, d + 1)
            n = total[:, :, d:]
            moved = np.where(n > 0, total[:, :, :d] / np.maximum(n, 1), f.centres[own])
            far = np.sqrt(((moved - f.centres[own]) ** 2).sum(axis=2)).max(axis=1)
            f.centres[own] = moved
            f.steps[own] += 1
            active[j] = own[far > tolerance]
        if not any(map(len, active)):
            break

    models = [f.centres for f in fits]

    def costs(blocks):
        total = np.zeros((len(models), m))
        for _, x, inside in blocks:
            mine = inside[:, sample]
            for t, c in zip(total, models, strict=True):
                t += (distances(x, c).min(axis=2) * mine).sum(axis=0)
        return total

    for f, cost in zip(fits, _summed(rows, costs, len(models) * m).reshape(-1, m), strict=True):
        f.cost = cost
    return fits


def many_kmeans(rows: DataFrame, k: int, seed: list[int], sample: list[int], max_iter: int = 40, tolerance: float = 1e-4) -> Fits:
    """``several_kmeans`` for one number of clusters."""
    return several_kmeans(rows, [k], seed, sample, max_iter, tolerance)[0]


@dataclass
class Clusters:
    """A k-means fit; ``summary`` has, as Spark ML's, its trainingCost and clusterSizes."""
    centres: np.ndarray
    summary: SimpleNamespace

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802
        return list(self.centres)

    def transform(self, v: DataFrame) -> DataFrame:
        """``v`` (features) with the nearest centre of each row as ``prediction``."""
        model = self.centres[None]

        @F.arrow_udf("int")
        def own(x: pa.Array) -> pa.Array:
            points = x.flatten().to_numpy().reshape(len(x), -1)
            parts = [nearest(points[lo: lo + BLOCK], model)[:, 0] for lo in range(0, len(points), BLOCK)]
            return pa.array(np.concatenate([np.zeros(0, int), *parts]), pa.int32())

        return v.withColumn("prediction", own(vector_to_array("features")))


def best_kmeans(rows: DataFrame, ks: list[int], seed: list[int], max_iter: int = 40) -> list[Clusters]:
    """Per number of clusters the cheapest of the fits from every seed, all stepping together. rows as in ``several_kmeans``, of one sample."""
    fits = several_kmeans(rows, ks, seed, [0] * len(seed), max_iter)
    best = [f.best(0) for f in fits]
    models = [f.centres[b: b + 1] for f, b in zip(fits, best, strict=True)]

    def sizes(blocks):
        total = [np.zeros(k) for k in ks]
        for _, x, _ in blocks:
            for t, c in zip(total, models, strict=True):
                t += np.bincount(nearest(x, c)[:, 0], minlength=len(t))
        return np.concatenate(total)

    n = np.split(_summed(rows.select("id", "x", "inside"), sizes, sum(ks)), np.cumsum(ks)[:-1])
    return [Clusters(c[0], SimpleNamespace(trainingCost=float(f.cost[b]), clusterSizes=[int(r) for r in size]))
            for c, f, b, size in zip(models, fits, best, n, strict=True)]


def crossed_labels(rows: DataFrame, fits: Fits, base: int, others: list[int]) -> DataFrame:
    """(sample, a, b, n): rows of each other sample by their label under the best fit of sample ``base`` and of their own."""
    k = fits.centres.shape[1]
    models = fits.centres[[fits.best(base), *(fits.best(s) for s in others)]]

    def run(batches):
        total = np.zeros((len(others), k, k), np.int64)
        for _, x, inside in _blocks(batches):
            label = nearest(x, models)
            for j, s in enumerate(others):
                mine = inside[:, s]
                total[j] += np.bincount(label[mine, 0] * k + label[mine, j + 1], minlength=k * k).reshape(k, k)
        j, a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(others, np.int64)[j]), pa.array(a), pa.array(b), pa.array(total[j, a, b])], ["sample", "a", "b", "n"])

    return rows.select("id", "x", "inside").mapInArrow(run, "sample long, a long, b long, n long").groupBy("sample", "a", "b").agg(F.sum("n").alias("n"))
