"""Many boosted classifiers from the same scan, each grown whole in one task.

The trees are those of Spark's GBTClassifier: at most 32 bins a column, a first tree on classes -1 and +1, the
next ones on the residuals of the log loss, the split of the largest drop in variance, leaves that say the mean.
Rows of equal bins share all their nodes, so a fit needs the rows of each class in every cell, not the rows.
Hundreds of levels in a row then cost no jobs of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.manytrees import BINS, CELLS, LEAF, SAMPLE

# Ship these functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins (cells times columns) of one fit: all 32 ** 4 cells of four columns.
TASK_BINS = 4 * BINS**4
#: Gains that are rounding errors, and gains that count as equal: the first split is taken, however the sums were rounded.
NO_GAIN, EQUAL = 1e-18, 1e-9


# ---------------------------------------------------------------- bins and cells


def column_borders(values: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values: all of them, or those that Spark's trees take of unweighted rows."""
    points, counts = np.unique(values, return_counts=True)
    bins = min(BINS, len(values))
    if len(points) <= bins:
        return (points[:-1] + points[1:]) / 2
    stride = len(values) / bins
    found, goal, reached = [], stride, counts[0]
    for i in range(1, len(points)):
        before, reached = reached, reached + counts[i]
        if abs(before - goal) < abs(reached - goal):
            found.append((points[i - 1] + points[i]) / 2)
            goal += stride
    return np.array(found)


def borders(rows: DataFrame, vector: str, key: str, folds: list[int]) -> dict[int, list[np.ndarray]]:
    """Borders of every column for each left-out fold (-1: none), from the rows outside the fold.

    As in Spark's trees, 10,000 rows place them if there are more. They are drawn by key and values, these without
    the last digits of a scaled column, which differ from run to run.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("fold").count().collect()}
    total, whole = sum(sizes.values()), 1 << 30
    limits = {f: int(min(1.0, SAMPLE / max(total - sizes.get(f, 0), 1)) * whole) for f in folds}
    x = vector_to_array(vector)
    plain = F.transform(x, lambda v: F.round(v * 1e6).cast("bigint"))
    drawn = rows.select("fold", x.alias("x"), F.pmod(F.xxhash64(key, plain, F.lit("borders")), F.lit(whole)).alias("h"))
    table = drawn.where(F.col("h") < max(limits.values())).toArrow()
    fold, h = table["fold"].to_numpy(), table["h"].to_numpy()
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = x.reshape(len(h), len(x) // len(h) if len(h) else len(rows.first()[vector]))
    chosen = {f: x[(fold != f) & (h < limit)] for f, limit in limits.items()}
    return {f: [column_borders(x[:, i]) for i in range(x.shape[1])] for f, x in chosen.items()}


def cells_of(rows: DataFrame, vector: str, target: str, cuts: dict[int, list[np.ndarray]]) -> DataFrame:
    """(fold, _bins, n0, n1): cells by the borders of a left-out fold, with the rows of each class outside it."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["_x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            y, fold = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            if not np.isin(y, (0, 1)).all():
                raise ValueError("the target must be 0 or 1")
            for f, columns in cuts.items():
                here = fold != f
                bins = np.empty((here.sum(), len(columns)), np.uint8)
                for i, c in enumerate(columns):
                    bins[:, i] = np.searchsorted(c, x[here, i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), f, np.int32)), pa.array([b.tobytes() for b in bins], pa.binary()),
                     pa.array(1 - y[here].astype(np.int64)), pa.array(y[here].astype(np.int64))],
                    ["fold", CELLS, "n0", "n1"])

    width = len(next(iter(cuts.values())))
    plain = rows.select("fold", F.col(target).cast("int").alias("y"), vector_to_array(vector).alias("_x"))
    return plain.mapInArrow(binned, f"fold int, {CELLS} binary, n0 bigint, n1 bigint").groupBy("fold", CELLS).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


# ---------------------------------------------------------------- growing


@dataclass(frozen=True)
class Tree:
    """Nodes from the root on: code (column * 32 + bin, or LEAF), left child (the right one follows it), mean."""

    code: np.ndarray
    left: np.ndarray
    mean: np.ndarray


def grow(bins: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int, leaf: int) -> tuple[Tree, np.ndarray]:
    """The regression tree of cells [column, cell] with their rows and sums, and the node of every cell."""
    code, left = [np.full(1, LEAF)], [np.zeros(1, int)]
    mean = [np.array([s.sum() / n.sum()])]
    node, cell = np.zeros(len(n), int), np.arange(len(n))
    at, first, nodes = np.zeros(len(n), int), 0, 1  # places in the level, which begins with node `first`
    for _ in range(depth):
        below = np.empty((2, nodes, len(bins), BINS))
        for j, column in enumerate(bins):
            where = at * BINS + column[cell]
            for i, of in enumerate((n, s)):
                below[i, :, j] = np.bincount(where, of[cell], minlength=nodes * BINS).reshape(nodes, BINS)
        nl, sl = np.cumsum(below, axis=3)
        nr, sr = nl[:, :, -1:] - nl, sl[:, :, -1:] - sl
        means = sl / np.maximum(nl, 1), sr / np.maximum(nr, 1)
        gain = nl * nr * ((means[0] - means[1]) / (nl + nr)) ** 2
        gain = np.where((nl >= leaf) & (nr >= leaf), gain, -1.0).reshape(nodes, -1)
        most = gain.max(1)
        split = np.flatnonzero(most > NO_GAIN)
        if not len(split):
            break
        best = (gain[split] >= most[split, None] * (1 - EQUAL)).argmax(1)
        code[-1][split] = best
        left[-1][split] = first + nodes + 2 * np.arange(len(split))
        sides = [m.reshape(nodes, -1)[split, best] for m in means]
        place = np.full(nodes, -1)
        place[split] = np.arange(len(split))
        inner = place[at] >= 0
        cell, at = cell[inner], place[at[inner]]
        column, border = np.divmod(best[at], BINS)
        at = 2 * at + (bins[column, cell] > border)
        first, nodes = first + nodes, 2 * len(split)
        node[cell] = first + at
        code.append(np.full(nodes, LEAF))
        left.append(np.zeros(nodes, int))
        mean.append(np.stack(sides, 1).ravel())
    return Tree(*map(np.concatenate, (code, left, mean))), node


def residuals(n0: np.ndarray, n1: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Sum over the rows of each cell of the negative gradient of 2 log(1 + exp(-2 y margin)), y = -1 or +1."""
    with np.errstate(over="ignore"):
        return 4 * n1 / (1 + np.exp(2 * margin)) - 4 * n0 / (1 + np.exp(-2 * margin))


@dataclass(frozen=True)
class Boosted:
    """Trees one after the other; `first` is the place of each root, all but the first tree count `rate` times."""

    first: np.ndarray
    code: np.ndarray
    left: np.ndarray
    mean: np.ndarray
    rate: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, for cells [cell, column]."""
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for m, root in enumerate(self.first):
            at = np.full(len(x), root)
            while (inner := self.code[at] >= 0).any():
                column, border = np.divmod(np.maximum(self.code[at], 0), BINS)
                at = np.where(inner, self.left[at] + (x[rows, column] > border), at)
            margin += (self.rate if m else 1.0) * self.mean[at]
        with np.errstate(over="ignore"):
            return 1 - 1 / (1 + np.exp(2 * margin))


def boosted(x: np.ndarray, n0: np.ndarray, n1: np.ndarray, rate: float, depth: int, rounds: int, leaf: int) -> Boosted:
    """The fit on cells [cell, column]; their order, and so the order of all sums, is made the same."""
    order = np.lexsort(x.T)
    bins = np.ascontiguousarray(x[order].T)
    n0, n1 = n0[order].astype(float), n1[order].astype(float)
    trees, margin = [], np.zeros(len(n0))
    for m in range(rounds):
        tree, node = grow(bins, n0 + n1, residuals(n0, n1, margin) if m else n1 - n0, depth, leaf)
        margin += (rate if m else 1.0) * tree.mean[node]
        trees.append(tree)
    first = np.cumsum([0, *(len(t.code) for t in trees[:-1])])
    return Boosted(
        first, np.concatenate([t.code for t in trees]).astype(np.int32),
        np.concatenate([t.left + f for t, f in zip(trees, first)]).astype(np.int32),
        np.concatenate([t.mean for t in trees]), rate)


MODELS = "fit int, first binary, code binary, left binary, mean binary"


def grow_boosted(cells: DataFrame, fits: list[tuple[int, float, int, int]], leaf: int) -> list[Boosted]:
    """A model for each (left-out fold, rate, depth, rounds), a task for each."""

    def fit(table: pa.Table) -> pa.Table:
        number = table["fit"][0].as_py()
        x = np.frombuffer(b"".join(table[CELLS].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        model = boosted(x, table["n0"].to_numpy(), table["n1"].to_numpy(), *fits[number][1:], leaf)
        return pa.table({"fit": pa.array([number], pa.int32())} | {
            c: pa.array([getattr(model, c).tobytes()], pa.binary()) for c in ("first", "code", "left", "mean")})

    of_fold = F.array(*[
        F.struct(F.lit(fold).alias("fold"), F.lit(i).alias("fit")) for i, (fold, *_) in enumerate(fits)])
    wanted = F.transform(F.filter(of_fold, lambda f: f["fold"] == F.col("fold")), lambda f: f["fit"])
    # Few bytes, much work: dealt to many partitions, so that few of them hold two fits.
    found = (cells.withColumn("fit", F.explode(wanted)).repartition(8 * len(fits), "fit")
             .groupBy("fit").applyInArrow(fit, MODELS).toArrow().to_pylist())
    kinds = {"first": np.int64, "code": np.int32, "left": np.int32, "mean": float}
    models = {r["fit"]: Boosted(**{c: np.frombuffer(r[c], t) for c, t in kinds.items()}, rate=fits[r["fit"]][1])
              for r in found}
    if len(models) < len(fits):
        raise ValueError("a fold leaves no rows to learn from")
    return [models[i] for i in range(len(fits))]
