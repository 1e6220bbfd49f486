"""Boosted trees of all folds in the scans of one.

The trees are Spark ML's GBT: variance splits, the first tree with weight one, the others fitted to its pseudo-residuals, the
smallest number of rows a leaf. But the models of all folds share the scans, and missing values are a bin of their own, which each
split sends to the side that is better. Rows are first counted by their bins: trees, and therefore residuals, do not tell rows of the
same bins apart. A scan sends the counts and sums of each node by bin, whose size does not depend on the rows, and the driver keeps
trees only. What the trees add up to is written every ``REFRESH`` trees with the cells (``lineage.cut``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .lineage import cut

REFRESH = 8  # trees between two writes
CELLS_A_TASK = 200_000
FEW_CELLS = 5_000  # less is not worth a task
MOST_DEPTH = 6  # a set of leaves is 64 bits
_BLOBS = "x binary, n binary, s binary, f binary"


@dataclass
class Layout:
    """The bins of each feature side by side: numeric ones by cut points with the missing values last, then categorical ones by level."""
    numeric: list[str]
    categorical: list[str]
    cuts: list[np.ndarray]
    levels: list[list[str]]

    def widths(self) -> list[int]:
        return [len(c) + 2 for c in self.cuts] + [len(v) + 1 for v in self.levels]

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.widths())])

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        """(features, rows) places of a batch that has the columns of ``inputs``."""
        out = []
        for j, c in enumerate(self.cuts):
            v = batch.column(j).to_numpy(zero_copy_only=False)
            out.append(np.where(np.isnan(v), len(c) + 1, np.searchsorted(c, v, side="left")))
        for j, known in enumerate(self.levels, len(self.cuts)):
            at = pc.fill_null(pc.index_in(batch.column(j), value_set=pa.array(known, batch.column(j).type)), len(known))
            out.append(at.to_numpy(zero_copy_only=False))
        return (np.array(out, np.int32).reshape(len(self.widths()), -1) + self.offsets()[:-1, None]).astype(np.int32)

    def inputs(self) -> list:
        return [F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate([*self.numeric, *self.categorical]) if j < len(self.numeric)] + [
            F.col(c).cast("string").alias(f"_x{j}") for j, c in enumerate(self.categorical, len(self.numeric))]


def layout(df: DataFrame, numeric: list[str], categorical: list[str], bins: int) -> Layout:
    """Midpoints between the values of a column, if it has at most ``bins``; else its quantiles. Of all folds: cut points do not see y."""
    cuts = []
    for c in numeric:
        v = df.select(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v")).filter("v is not null")
        values = sorted(r[0] for r in v.distinct().limit(bins + 1).collect())
        if len(values) > bins:
            at = v.agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], 10_000)).first()[0]
            cuts.append(np.unique(np.array(at, float)))
        else:
            cuts.append(np.array([a + (b - a) / 2 for a, b in zip(values, values[1:])], float))
    levels = [sorted((r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().collect()), reverse=True) for c in categorical]
    return Layout(list(numeric), list(categorical), cuts, levels)


def _leaves(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The leaf of each cell: every feature leaves the bits of the leaves that its bin can reach, the lowest common one is taken."""
    bits = masks[x[0]]
    for j in range(1, len(x)):
        bits &= masks[x[j]]
    return np.log2((bits & (~bits + np.uint64(1))).astype(float)).astype(np.intp)


def _residuals(n: np.ndarray, s: np.ndarray, f: np.ndarray, binary: bool, first: bool) -> np.ndarray:
    """Sums of Spark ML's pseudo-residuals over the rows of each cell; s is the sum of y, which is 0 or 1 if ``binary``."""
    if first:
        return 2 * s - n if binary else s
    if not binary:
        return 2 * (s - n * f)
    return 4 * (s / (1 + np.exp(2 * f)) - (n - s) / (1 + np.exp(-2 * f)))


def _unpacked(row, models: int) -> tuple[np.ndarray, ...]:
    n, s, f = (np.frombuffer(row[i]).reshape(models, -1) for i in (1, 2, 3))
    return np.frombuffer(row[0], np.int32).reshape(-1, n.shape[1]), n, s, f


def _cells(df: DataFrame, form: Layout, y: str, folds: int) -> DataFrame:
    """(x, n, s, f) a row a task: the bins of its cells, and for each fold's model the rows and the sum of y it learns from, and its prediction so far."""
    names = [f"_b{j}" for j in range(len(form.widths()))]

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, form.bins(batch)), batch.column("fold"), batch.column("_y")], [*names, "fold", "_y"])

    binned = df.select(*form.inputs(), F.col("fold").cast("int").alias("fold"), F.col(y).cast("double").alias("_y")).mapInArrow(
        place, ", ".join(f"{c} int" for c in names) + ", fold int, _y double")
    of = lambda c, m: F.coalesce(F.sum(F.when(F.col("fold") != m, c)), F.lit(0.0))
    counted = cut(binned.groupBy(*names).agg(*[of(F.lit(1.0), m).alias(f"n{m}") for m in range(folds)], *[of(F.col("_y"), m).alias(f"s{m}") for m in range(folds)]))
    size = counted.count()
    cores = counted.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, size // FEW_CELLS + 1), size // CELLS_A_TASK + 1)

    def pack(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            side = lambda prefix, kind: np.array([table.column(c).to_numpy() for c in table.column_names if c.startswith(prefix)], kind)
            n = side("n", float)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (side("_b", np.int32), n, side("s", float), np.zeros_like(n))], ["x", "n", "s", "f"])

    return cut(counted.repartition(tasks).mapInArrow(pack, _BLOBS))


def _splits(counts: np.ndarray, sums: np.ndarray, form: Layout, smallest: int) -> tuple[np.ndarray, ...]:
    """Per node the best split of the histograms (models, nodes, bins): gain over no split, its number, and its left side's rows and sum.

    Splits stand as Spark ML's features do: each numeric column with its missing values left, then right; then level by level.
    """
    at, left = form.offsets(), []
    for h in (counts, sums):
        parts = []
        for j, c in enumerate(form.cuts):
            known = np.cumsum(h[..., at[j]: at[j + 1] - 1], axis=-1)
            missing = h[..., at[j + 1] - 1: at[j + 1]]
            parts += [missing, known[..., :len(c)] + missing, known]
        parts += [h[..., at[j]: at[j + 1] - 1] for j in range(len(form.cuts), len(at) - 1)]
        left.append(np.concatenate(parts, axis=-1))
    whole = slice(at[0], at[1])
    n, s = counts[..., whole].sum(axis=-1, keepdims=True), sums[..., whole].sum(axis=-1, keepdims=True)
    ln, ls = left
    rn, rs = n - ln, s - ls
    plain = s * s / np.maximum(n, 1)
    good = (ln >= smallest) & (rn >= smallest)
    gain = np.where(good, ls * ls / np.maximum(ln, 1) + rs * rs / np.maximum(rn, 1) - plain, -np.inf)
    best = gain.argmax(axis=-1)
    take = lambda a: np.take_along_axis(a, best[..., None], axis=-1)[..., 0]
    return np.where(take(gain) > 1e-12 * plain[..., 0], take(gain), -np.inf), best, take(ln), take(ls), n[..., 0], s[..., 0]


def _sides(form: Layout) -> list[tuple[int, np.ndarray]]:
    """Of each split of ``_splits`` the feature and which of its bins go left."""
    out = []
    for j, c in enumerate(form.cuts):
        places = np.arange(len(c) + 2)
        missing = places == len(c) + 1
        out += [(j, missing), *[(j, (places <= t) | missing) for t in range(len(c))], *[(j, places <= t) for t in range(len(c) + 1)]]
    for j, known in enumerate(form.levels, len(form.cuts)):
        out += [(j, np.arange(len(known) + 1) == t) for t in range(len(known))]
    return out


@dataclass
class Boosted:
    """The models of all folds: per tree the reachable leaves of each bin (models, bins) and the values of the leaves (models, leaves)."""
    form: Layout
    trees: list[tuple[np.ndarray, np.ndarray]]
    binary: bool

    def transform(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the prediction (a probability if binary) of the model that did not see the row's fold."""
        form, binary = self.form, self.binary
        masks, values = np.array([t[0] for t in self.trees]), np.array([t[1] for t in self.trees])
        inputs = form.inputs()
        skip = len(inputs)

        def score(batches):
            for batch in batches:
                x, fold = form.bins(batch), batch.column("fold").to_numpy()
                total = np.zeros(batch.num_rows)
                for m in np.unique(fold):
                    mine = np.flatnonzero(fold == m)
                    own = np.ascontiguousarray(x[:, mine])
                    total[mine] = sum(values[t, m][_leaves(own, masks[t, m])] for t in range(len(masks)))
                kept = [batch.column(i) for i in range(skip, batch.num_columns)]
                out = 1 / (1 + np.exp(-2 * total)) if binary else total
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], [*batch.schema.names[skip:], name])

        return df.select(*inputs, *df.columns).mapInArrow(score, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def fit_folds(df: DataFrame, numeric: list[str], categorical: list[str], y: str, settings, folds: int, binary: bool) -> Boosted:
    """Boosting on all rows outside each fold. ``settings`` is the Spark ML estimator whose trees are grown; df has y and fold, and is a written table."""
    trees, depth, rate, smallest = settings.getMaxIter(), settings.getMaxDepth(), settings.getStepSize(), settings.getMinInstancesPerNode()
    if depth > MOST_DEPTH:
        raise ValueError(f"trees deeper than {MOST_DEPTH}")
    form = layout(df, numeric, categorical, settings.getMaxBins())
    at, sides, leaves = form.offsets(), _sides(form), 1 << depth
    width, models = int(at[-1]), folds
    every = np.uint64((1 << leaves) - 1)
    table = _cells(df, form, y, folds)
    state, pending, grown = table.rdd.map(tuple).persist(), [], []

    def histograms(masks: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        nodes, first, late = 1 << level, not grown, list(pending)

        def run(rows):
            total = np.zeros((2, models, nodes * width))
            for row in rows:
                x, n, s, f = _unpacked(row, models)
                for m in range(models):
                    so_far = f[m] + sum(v[m][_leaves(x, k[m])] for k, v in late) if late else f[m]
                    place = (_leaves(x, masks[m]) >> (depth - level)) * width
                    g = _residuals(n[m], s[m], so_far, binary, first)
                    for feature in x:
                        total[0, m] += np.bincount(place + feature, n[m], nodes * width)
                        total[1, m] += np.bincount(place + feature, g, nodes * width)
            yield total.tobytes()

        found = sum(np.frombuffer(b) for b in state.mapPartitions(run).collect()).reshape(2, models, nodes, width)
        return found[0], found[1]

    for number in range(trees):
        masks, values = np.full((models, width), every, np.uint64), np.zeros((models, leaves))
        active = np.ones((models, 1), bool)
        for level in range(depth):
            gain, best, ln, ls, n, s = _splits(*histograms(masks, level), form, smallest)
            if level == 0 and not n.all():
                raise ValueError("a fold has no rows to learn from")
            wide, after = leaves >> level, np.zeros((models, 2 << level), bool)
            for m, p in zip(*np.nonzero(active)):
                if level == 0:
                    values[m] = s[m, p] / n[m, p]
                if not np.isfinite(gain[m, p]):
                    continue
                lo, middle, hi = p * wide, p * wide + wide // 2, (p + 1) * wide
                values[m, lo:middle] = ls[m, p] / ln[m, p]
                values[m, middle:hi] = (s[m, p] - ls[m, p]) / (n[m, p] - ln[m, p])
                j, goes_left = sides[best[m, p]]
                left, right = (np.uint64(((1 << (b - a)) - 1) << a) for a, b in ((int(lo), int(middle)), (int(middle), int(hi))))
                masks[m, at[j]: at[j + 1]] &= ~np.where(goes_left, right, left)
                after[m, 2 * p: 2 * p + 2] = True
            active = after
            if not active.any():
                break
        tree = (masks, values * (1.0 if number == 0 else rate))
        grown.append(tree)
        pending.append(tree)
        if len(pending) == REFRESH and number + 1 < trees:
            late = list(pending)

            def add(row, late=late):
                x, n, _, f = _unpacked(row, models)
                new = np.array([f[m] + sum(v[m][_leaves(x, k[m])] for k, v in late) for m in range(models)])
                return row[0], row[1], row[2], new.tobytes()

            table = cut(df.sparkSession.createDataFrame(state.map(add), _BLOBS))
            state.unpersist()
            state, pending = table.rdd.map(tuple).persist(), []
    state.unpersist()
    return Boosted(form, grown, binary)
