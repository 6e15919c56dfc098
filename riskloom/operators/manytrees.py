"""Many forests grown level by level from the same scans of binned rows.

Columns are cut into at most 32 bins, as Spark's trees do, so rows of equal bins and class are one cell
with a count for each fold. A level of all trees of all forests is one job: tasks hold a slice of cells
and a group of trees, count the cells of every open node by bin and class, and the counts of one tree
are summed in one place, where its splits are chosen. Only the splits travel to the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.tables import stored

# Ship these functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a column and rows that place their borders, both as in Spark's trees.
BINS, SAMPLE = 32, 10_000
#: Cells of a slice and trees of a group: the work of one task.
SLICE, GROUP = 10_000, 25
LEAF, OPEN = -1, -2
CELLS = "_bins"


# ---------------------------------------------------------------- bins and cells


def column_borders(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values: all of them, or those nearest to the weighted quantiles."""
    points, inverse = np.unique(values, return_inverse=True)
    if len(points) <= BINS:
        return (points[:-1] + points[1:]) / 2
    reached = np.cumsum(np.bincount(inverse, weights))
    goals = reached[-1] * np.arange(1, BINS) / BINS
    at = np.searchsorted(reached, goals)
    below = np.where(at > 0, reached[at - 1], 0.0)
    at = np.unique(np.where(goals - below < reached[at] - goals, at - 1, at))
    at = at[(at >= 0) & (at < len(points) - 1)]
    return (points[at] + points[at + 1]) / 2


def borders(rows: DataFrame, vector: str, target: str, key: str) -> list[np.ndarray]:
    """Borders of every column of the vector, the classes weighing the same."""
    share = SAMPLE / max(rows.count(), 1)
    chosen = rows
    if share < 1:
        chosen = rows.where(F.pmod(F.xxhash64(key, F.lit("borders")), F.lit(1 << 30)) < int(share * (1 << 30)))
    table = chosen.select(F.col(target).cast("int").alias("y"), vector_to_array(vector).alias("x")).toArrow()
    y = table["y"].to_numpy()
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    weights = np.where(y == 1, 1 / max((y == 1).sum(), 1), 1 / max((y != 1).sum(), 1))
    return [column_borders(x[:, i], weights) for i in range(x.shape[1])]


def with_bins(rows: DataFrame, vector: str, cuts: list[np.ndarray]) -> DataFrame:
    """The vector replaced by the bin of each column, one byte each; bin b lies at or below border b."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["_x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in keep] + [pa.array([b.tobytes() for b in bins], pa.binary())], [*keep, CELLS])

    keep = [c for c in rows.columns if c != vector]
    schema = rows.select(*keep).withColumn(CELLS, F.lit(b"")).schema
    return rows.select(*keep, vector_to_array(vector).alias("_x")).mapInArrow(binned, schema)


def cells_of(rows: DataFrame, target: str, k: int) -> DataFrame:
    """(_bins, y, n): one row per distinct cell and class, with its rows in each of the k folds."""
    counts = F.array(*[F.count_if(F.col("fold") == f) for f in range(k)])
    return rows.groupBy(CELLS, F.col(target).cast("int").alias("y")).agg(counts.alias("n"))


# ---------------------------------------------------------------- draws


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(h: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the two hashed numbers alone."""
    return (mixed(h + mixed(stream.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)) * 2.0**-53


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion: a cell of n rows drawn with replacement is drawn Poisson(n) times."""
    out = np.zeros(u.shape, np.int64)
    for n in np.unique(mean[mean > 0]):
        top = int(n + 12 * math.sqrt(n) + 20)
        j = np.arange(top + 1)
        logs = j * math.log(n) - n - np.cumsum(np.log(np.maximum(j, 1)))
        here = mean == n
        out[here] = np.searchsorted(np.cumsum(np.exp(logs)), u[here], side="right")
    return out


def subsets(seed: int, tree: int, nodes: int, width: int) -> np.ndarray:
    """[node, place]: the columns that each node of a tree may split, root of `width` of them."""
    place = np.arange(nodes * width, dtype=np.uint64).reshape(nodes, width)
    u = uniform(mixed(np.array([[(seed << 32) + tree]], np.uint64)), place + np.uint64(1))
    return np.sort(np.argsort(u, axis=1, kind="stable")[:, :math.ceil(math.sqrt(width))], axis=1).astype(np.int32)


# ---------------------------------------------------------------- growing


@dataclass(frozen=True)
class Plan:
    """What all forests share. A forest is a leaf size and a left-out fold (-1: none)."""

    forests: list[tuple[int, int]]
    weights: np.ndarray  # [forest, class]
    trees: int
    depth: int
    width: int
    seed: int

    @property
    def size(self) -> int:
        return 2**self.depth - 1


def counted(plan: Plan, level: int, codes: np.ndarray, bins: np.ndarray, y: np.ndarray, n: np.ndarray,
            first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tree, places, counts) of the open nodes of a level, by forest, node, allowed column, bin and class.

    `codes` are the nodes [tree, forest, node] of the trees from `first` on.
    """
    rows, k = n.shape
    nodes, m = 2**level, math.ceil(math.sqrt(plan.width))
    text = np.zeros((rows, -(-(plan.width + 1) // 8) * 8), np.uint8)
    text[:, :plan.width], text[:, plan.width] = bins, y + 1
    h = np.full(rows, plan.seed, np.uint64)
    for part in text.view(np.uint64).T:
        h = mixed(h ^ mixed(part + np.uint64(0x9E3779B97F4A7C15)))
    flat = np.ascontiguousarray(bins).ravel()
    for i in range(len(codes)):
        code = codes[i].ravel()
        if not (code == OPEN).any():
            continue
        tree = first + i
        drawn = poisson(uniform(h[:, None], tree * k + np.arange(1, k + 1)[None, :]), n)
        whole = drawn.sum(1)
        weight = np.stack([whole if f < 0 else whole - drawn[:, f] for _, f in plan.forests])
        forest, row = (a.astype(np.int32) for a in np.nonzero(weight))
        weight, at = weight[forest, row], np.zeros(len(row), np.int32)
        start, cell = forest * np.int32(plan.size), row * np.int32(plan.width)
        for _ in range(level):
            now = code.take(start + at)
            inner = now >= 0
            if not inner.all():
                start, cell, at, weight, now = (a[inner] for a in (start, cell, at, weight, now))
            at = 2 * at + 1 + (flat.take(cell + (now >> 5)) > (now & 31))
        open_ = code.take(start + at) == OPEN
        start, cell, at, weight = (a[open_] for a in (start, cell, at, weight))
        allowed = subsets(plan.seed, tree, plan.size, plan.width)[nodes - 1:2 * nodes - 1]
        local = at - (nodes - 1)
        base = (start // plan.size * nodes + local) * m
        side = y.take(cell // plan.width)
        total = np.zeros(len(plan.forests) * nodes * m * BINS * 2)
        for j in range(m):
            where = ((base + j) * BINS + flat.take(cell + allowed[:, j].take(local))) * 2 + side
            total += np.bincount(where, weight, minlength=len(total))
        places = np.flatnonzero(total)
        yield tree, places, total[places].astype(np.int64)


def splits(plan: Plan, level: int, tree: int, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """(forest, node, code, left share, right share) of the best splits of one tree's open nodes."""
    nodes, m = 2**level, math.ceil(math.sqrt(plan.width))
    total = total.reshape(len(plan.forests), nodes, m, BINS, 2)
    forest, node = np.nonzero(total.any((2, 3, 4)))
    below = np.cumsum(total[forest, node], axis=2)  # rows up to each bin
    whole = below[:, :, -1:, :]
    weights = plan.weights[forest][:, None, None, :]
    fewest = np.array([leaf for leaf, _ in plan.forests])[forest][:, None, None]

    def weighed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = counts * weights
        size = both.sum(-1)
        share = both[..., 1] / np.maximum(size, 1e-300)
        return size, share

    (nl, sl), (nr, sr), (n, s) = weighed(below), weighed(whole - below), weighed(whole)
    gini = lambda p: 2 * p * (1 - p)
    gain = gini(s) - (nl * gini(sl) + nr * gini(sr)) / np.maximum(n, 1e-300)
    fits = (below.sum(-1) >= fewest) & ((whole - below).sum(-1) >= fewest)
    gain = np.where(fits, gain, -1.0).reshape(len(node), -1)
    best = gain.argmax(1)
    good = gain[np.arange(len(best)), best] > 1e-12
    forest, node, best = forest[good], node[good], best[good]
    at = np.arange(len(good))[good], best // BINS, best % BINS
    column = subsets(plan.seed, tree, plan.size, plan.width)[node + nodes - 1, at[1]]
    return forest, node + nodes - 1, column * BINS + at[2], sl[at], sr[at]


COUNTS = "tree int, places binary, counts binary"
SPLITS = "tree int, forest int, node int, code int, lower double, upper double"


def grow_level(plan: Plan, level: int, work: DataFrame, tasks: int, codes: np.ndarray) -> pa.Table:
    """The splits of one level of all trees."""

    def count(table: pa.Table) -> pa.Table:
        first = table["trees"][0].as_py() * GROUP
        bins = np.frombuffer(b"".join(table[CELLS].to_pylist()), np.uint8).reshape(table.num_rows, plan.width)
        n = table["n"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        found = list(counted(plan, level, codes[first:first + GROUP], bins, table["y"].to_numpy(), n, first))
        return pa.table({
            "tree": pa.array([t for t, _, _ in found], pa.int32()),
            "places": pa.array([p.astype(np.int32).tobytes() for _, p, _ in found], pa.binary()),
            "counts": pa.array([c.tobytes() for _, _, c in found], pa.binary())})

    def choose(table: pa.Table) -> pa.Table:
        m = math.ceil(math.sqrt(plan.width))
        total = np.zeros(len(plan.forests) * 2**level * m * BINS * 2, np.int64)
        for places, counts in zip(table["places"].to_pylist(), table["counts"].to_pylist()):
            total[np.frombuffer(places, np.int32)] += np.frombuffer(counts, np.int64)
        tree = table["tree"][0].as_py()
        forest, node, code, lower, upper = splits(plan, level, tree, total)
        return pa.table({
            "tree": pa.array(np.full(len(node), tree), pa.int32()), "forest": pa.array(forest, pa.int32()),
            "node": pa.array(node, pa.int32()), "code": pa.array(code, pa.int32()),
            "lower": pa.array(lower), "upper": pa.array(upper)})

    # Few bytes, much work: dealt by number, as partitions by size would all be one.
    groups = -(-plan.trees // GROUP)
    return (work.repartition(tasks, "trees", "slice").groupBy("trees", "slice").applyInArrow(count, COUNTS)
            .repartition(2 * groups, "tree").groupBy("tree").applyInArrow(choose, SPLITS).toArrow())


@dataclass(frozen=True)
class Grown:
    """Nodes of all trees in heap order: code (column * 32 + bin, or LEAF) and share of class 1."""

    codes: np.ndarray  # [tree, forest, inner place]
    shares: np.ndarray  # [tree, forest, place]


def grow_forests(cells: DataFrame, forests: list[tuple[int, int]], trees: int, depth: int, seed: int) -> Grown:
    """Forests on binned cells; each draws rows with replacement and weighs the classes alike.

    A draw depends on the seed, the tree and the cell, so a result does not depend on how rows are
    stored, and forests that differ in leaf size or fold share their draws. Nodes of one majority
    under a split are joined, as in Spark's forests.
    """
    first = cells.first()
    k = len(first["n"])
    by_class = {r[0]: r[1:] for r in cells.groupBy("y").agg(*[F.sum(F.col("n")[f]) for f in range(k)]).collect()}
    if set(by_class) - {0, 1}:
        raise ValueError("the target must be 0 or 1")
    rows = np.array([[sum(n) - (n[f] if f >= 0 else 0) for n in (by_class.get(c, (0,) * k) for c in (0, 1))]
                     for _, f in forests], float)
    weights = rows.sum(1, keepdims=True) / (2 * np.maximum(rows, 1))
    plan = Plan(forests, weights, trees, depth, len(first[CELLS]), seed)
    slices = -(-cells.count() // SLICE)
    groups = F.sequence(F.lit(0), F.lit(-(-trees // GROUP) - 1))
    work = cells.withColumn("slice", F.pmod(F.xxhash64(CELLS, "y"), F.lit(slices))).withColumn(
        "trees", F.explode(groups))
    work = stored(work, "work")
    tasks = min(2 * slices * -(-trees // GROUP), 1000)

    codes = np.full((trees, len(forests), plan.size), LEAF, np.int32)
    shares = np.full((trees, len(forests), 2 * plan.size + 1), np.nan)
    weighed = rows * weights
    shares[:, :, 0] = weighed[:, 1] / np.maximum(weighed.sum(1), 1e-300)
    if depth:
        codes[:, :, 0] = OPEN
    for level in range(depth):
        if not (codes == OPEN).any():
            break
        found = grow_level(plan, level, work, tasks, codes)
        tree, forest, node, code = (found[c].to_numpy() for c in ("tree", "forest", "node", "code"))
        codes[codes == OPEN] = LEAF
        codes[tree, forest, node] = code
        for side, share in enumerate((found["lower"].to_numpy(), found["upper"].to_numpy())):
            child = 2 * node + 1 + side
            shares[tree, forest, child] = share
            if level + 1 < depth:
                mixed_ = (share > 0) & (share < 1)
                codes[tree[mixed_], forest[mixed_], child[mixed_]] = OPEN
    inner = np.zeros(shares.shape, bool)
    inner[:, :, :plan.size] = codes >= 0
    for level in range(depth - 1, -1, -1):  # joined from below
        node = np.arange(2**level - 1, 2**(level + 1) - 1)
        same = (shares[:, :, 2 * node + 1] > 0.5) == (shares[:, :, 2 * node + 2] > 0.5)
        inner[:, :, node] &= ~(same & ~inner[:, :, 2 * node + 1] & ~inner[:, :, 2 * node + 2])
    codes = np.where(inner[:, :, :plan.size], codes, LEAF)
    return Grown(codes, shares)
