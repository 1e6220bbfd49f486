"""Gaussian mixtures of several starts in the scans of one.

Spark ML draws each start and makes its first step; the steps after it are those of Spark ML's GaussianMixture, with the
same floor under every density and the same rule to stop, but all starts share a scan, and a task works on blocks of
rows with matrix products. What a task sends does not depend on its rows.
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
FLOOR = 2.0**-52  # added to every weighted density, as Spark ML does


def whitened(means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((models, k, dim + 1, dim) maps of (1, x) to whitened distances from the mean, (models, k) log factors), with pseudo-inverses as in Spark ML."""
    d, u = np.linalg.eigh(covs)
    use = d > FLOOR * d.max(axis=-1, keepdims=True) * d.shape[-1]
    if not use.any(axis=-1).all():
        raise ValueError("a covariance matrix has no non-zero singular values")
    root = u * np.where(use, 1 / np.sqrt(np.where(use, d, 1)), 0)[..., None, :]
    log_det = np.where(use, np.log(np.where(use, d, 1)), 0).sum(axis=-1)
    shift = -(means[..., None, :] @ root)
    return np.concatenate([shift, root], axis=-2), -0.5 * (means.shape[-1] * np.log(2 * np.pi) + log_det)


def densities(x: np.ndarray, weights: np.ndarray, maps: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(rows, models, k) weighted densities."""
    m, k, e, d = maps.shape
    one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    y = (one @ maps.transpose(2, 0, 1, 3).reshape(e, m * k * d)).reshape(len(x), m * k, d)
    p = np.einsum("ijk,ijk->ij", y, y)
    p *= -0.5
    p += factors.ravel()
    np.exp(p, out=p)
    p *= weights.ravel()
    p += FLOOR
    return p.reshape(len(x), m, k)


def _blocks(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            yield part.column(0).flatten().to_numpy().reshape(part.num_rows, -1)


def steps(rows: DataFrame, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """One step of every model over ``rows`` (x array<double>), in one scan. A group (weights, means, covariances) holds models of the same
    number of components; it gets new weights, means, covariances, and the log likelihoods before the step."""
    d = groups[0][1].shape[-1]
    prepared = [(weights, *whitened(means, covs)) for weights, means, covs in groups]
    upper = np.triu_indices(d)
    wide = 1 + d + len(upper[0])

    def run(batches):
        total, likely = [np.zeros((w.size, wide)) for w, _, _ in prepared], [np.zeros(len(w)) for w, _, _ in prepared]
        for x in _blocks(batches):
            powers = np.concatenate([np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]], axis=1)
            for t, own, (weights, maps, factors) in zip(total, likely, prepared, strict=True):
                p = densities(x, weights, maps, factors)
                norm = p.sum(axis=2)
                own += np.log(norm).sum(axis=0)
                p /= norm[:, :, None]
                t += p.reshape(len(x), -1).T @ powers
        sums = np.concatenate([part.ravel() for pair in zip(total, likely, strict=True) for part in pair])
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["v"])

    # a row of sums a task, whose size does not depend on the rows; those are dealt to as many tasks as there are cores
    sizes = [n for weights, _, _ in groups for n in (weights.size * wide, len(weights))]
    found = rows.mapInArrow(run, "v array<double>").toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, sum(sizes)).sum(axis=0)
    parts, out = iter(np.split(found, np.cumsum(sizes)[:-1])), []
    for weights, _, _ in groups:
        m, k = weights.shape
        sums, likely = next(parts).reshape(m, k, wide), next(parts)
        w = sums[:, :, 0]
        new = sums[:, :, 1: 1 + d] / w[:, :, None]
        cov = np.zeros((m, k, d, d))
        cov[:, :, upper[0], upper[1]] = cov[:, :, upper[1], upper[0]] = sums[:, :, 1 + d:] / w[:, :, None]
        out.append((w / w.sum(axis=1, keepdims=True), new, cov - new[:, :, :, None] * new[:, :, None, :], likely))
    return out


def step(rows: DataFrame, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, ...]:
    """``steps`` of one group."""
    return steps(rows, [(weights, means, covs)])[0]


@dataclass
class Mixture:
    """A fitted mixture; ``summary.logLikelihood`` is, as in Spark ML, that of the last step's beginning."""
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    summary: SimpleNamespace

    def getK(self) -> int:  # noqa: N802
        return len(self.weights)

    def transform(self, v: DataFrame) -> DataFrame:
        """``v`` (features) with the likeliest component of each row as ``prediction``."""
        weights, (maps, factors) = self.weights[None], whitened(self.means[None], self.covs[None])

        @F.arrow_udf("int")
        def likeliest(x: pa.Array) -> pa.Array:
            points = x.flatten().to_numpy().reshape(len(x), -1)
            parts = [densities(points[lo: lo + BLOCK], weights, maps, factors)[:, 0].argmax(axis=1) for lo in range(0, len(points), BLOCK)]
            return pa.array(np.concatenate([np.zeros(0, int), *parts]), pa.int32())

        return v.withColumn("prediction", likeliest(vector_to_array("features")))


def continued_together(rows: DataFrame, firsts: list[list], max_iter: int, tolerance: float = 0.01) -> list[list[Mixture]]:
    """The mixtures that grow from ``firsts``, groups of Spark ML models after one step, by up to ``max_iter`` steps in all.

    rows (x array<double>). The models of a group have the same number of components; all groups share the scans. A model stops
    when its log likelihood moves by at most ``tolerance``.
    """
    groups = []
    for first in firsts:
        parts = [[(g["mean"].toArray(), g["cov"].toArray()) for g in f.gaussiansDF.collect()] for f in first]
        means, covs = (np.array([[g[j] for g in p] for p in parts]) for j in (0, 1))
        groups.append(SimpleNamespace(weights=np.array([f.weights for f in first]), means=means, covs=covs,
                                      likely=np.array([f.summary.logLikelihood for f in first]), active=np.arange(len(first))))
    for _ in range(1, max_iter):
        moving = [g for g in groups if len(g.active)]
        if not moving:
            break
        now = [(g.weights[g.active], g.means[g.active], g.covs[g.active]) for g in moving]
        for g, new in zip(moving, [step(rows, *now[0])] if len(now) == 1 else steps(rows, now), strict=True):
            g.weights[g.active], g.means[g.active], g.covs[g.active], likely = new
            moved = np.abs(likely - g.likely[g.active])
            g.likely[g.active] = likely
            g.active = g.active[moved > tolerance]
    return [[Mixture(*each[:3], SimpleNamespace(logLikelihood=float(each[3]))) for each in zip(g.weights, g.means, g.covs, g.likely, strict=True)] for g in groups]


def continued(rows: DataFrame, first: list, max_iter: int, tolerance: float = 0.01) -> list[Mixture]:
    """``continued_together`` for models of one number of components."""
    return continued_together(rows, [first], max_iter, tolerance)[0]
