"""Exact nearest donors for rows with gaps, over all features that two rows share.

Points with the same features present are searched in a tree of their own, cut only along these
features, as cuts along others tell nothing about the distance; rare patterns share one tree. Donors are
dealt into the cells of a tree of medians; the donors of one cell that have the same
features present make a box with the least and largest value of every feature. A searched point looks
into its nearest boxes first. The k-th distance found there closes all boxes that lie farther away, so
donors meet only the points that visit their box. A box that many points visit is read by several
tasks, and every meeting keeps its k nearest donors before anything is shuffled again.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.tables import stored

# Ship these functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Digits of a distance; ties beyond them go to the lower key.
DIGITS = 9
#: Fewest donors of a box, rows that place the medians (balance only), patterns with cells of their own.
LEAF, SAMPLE, PATTERNS = 256, 200_000, 4096
#: Patterns of points with a tree of their own, each of which holds the donors that can serve it.
TREES = 8
#: Nearest boxes of a point that are put in order first; all of them if these hold too few donors.
NEAR = 64
#: Points that one task takes into a box, distances held at once, and boxes that every point sees at once.
VISITS, HELD, BOXES = 2048, 1 << 20, 50_000


@dataclass(frozen=True)
class Tree:
    """Medians in heap order, and how many levels of them each frequent pattern uses."""

    dims: np.ndarray
    cuts: np.ndarray
    levels: int
    used: dict[str, int]

    def cells(self, z: np.ndarray, patterns: list[str]) -> np.ndarray:
        """Cell of each row; missing values count as 0, the mean."""
        node, z = np.zeros(len(z), np.int64), np.nan_to_num(z)
        rows = np.arange(len(z))
        for _ in range(self.levels):
            node = 2 * node + 1 + (z[rows, self.dims[node]] > self.cuts[node])
        leaf = node - (2**self.levels - 1)
        depth = np.array([self.used.get(p, 0) for p in patterns], np.int64)
        return leaf >> (self.levels - depth)


def medians(points: np.ndarray, levels: int, used: dict[str, int], along: list[int] | None = None) -> Tree:
    """Every node halves its points at the median of the feature (of those in `along`) that spreads most there."""
    along = np.array(along or range(points.shape[1]))
    size = 2**levels - 1
    dims, cuts, held = np.zeros(max(size, 1), np.int64), np.zeros(max(size, 1)), {0: np.nan_to_num(points)}
    for node in range(size):
        here = held.pop(node)
        if len(here):
            dims[node] = along[np.argmax(here[:, along].std(0))]
            cuts[node] = np.median(here[:, dims[node]])
        right = here[:, dims[node]] > cuts[node]
        held[2 * node + 1], held[2 * node + 2] = here[~right], here[right]
    return Tree(dims, cuts, levels, used)


@dataclass(frozen=True)
class Boxes:
    """Bounds of every box; an absent feature has none."""

    ids: np.ndarray
    counts: np.ndarray
    present: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def distances(self, z: np.ndarray) -> np.ndarray:
        """[point, box]: least squared distance that a donor of the box can have; infinite if none is shared."""
        seen = ~np.isnan(z)
        common = seen.astype(float) @ self.present.T.astype(float)
        out = np.zeros(common.shape)
        for i in np.flatnonzero(seen.any(0)):
            gap = np.maximum(np.maximum(self.low[None, :, i] - z[:, i, None], z[:, i, None] - self.high[None, :, i]), 0)
            out += np.where(seen[:, i, None] & self.present[None, :, i], gap * gap, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(common > 0, out * (z.shape[1] / common), np.inf)

    def first_look(self, z: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
        """[point, box]: for each missing feature the nearest boxes that have it, until k donors are seen."""
        chosen = np.zeros(distance.shape, bool)
        near = np.argpartition(distance, NEAR, axis=1)[:, :NEAR] if distance.shape[1] > NEAR else None
        for row, (point, away) in enumerate(zip(z, distance)):
            asks = np.flatnonzero(np.isnan(point))
            order = np.arange(len(away)) if near is None else near[row]
            order = order[np.argsort(away[order], kind="stable")]
            if near is not None and (self.counts[order] @ self.present[order][:, asks] < k).any():
                order = np.argsort(away, kind="stable")
            order = order[away[order] < np.inf]
            for j in asks:
                has = order[self.present[order, j]]
                enough = int(np.searchsorted(np.cumsum(self.counts[has]), k)) + 1
                chosen[row, has[:enough]] = True
        return chosen


def numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


VISIT = "box long, q long, pattern string, z array<double>"


def visits(points: DataFrame, boxes: Boxes, k: int, width: int, later: bool) -> DataFrame:
    """(box, point) of the first look, or later of all other boxes that the limits leave open."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, HELD // max(1, len(boxes.ids)))
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                z = numbers(batch["z"], width)
                distance = boxes.distances(z)
                chosen = boxes.first_look(z, distance, k)
                if later:
                    limits = numbers(batch["limits"], width)  # of the missing features; NaN: none yet
                    open_ = np.zeros(chosen.shape, bool)
                    for j in range(width):
                        asks = np.isnan(z[:, j])
                        limit = np.where(np.isnan(limits[:, j]), np.inf, limits[:, j])
                        near = distance <= (limit * (1 + 1e-12) + 10.0**-DIGITS)[:, None]
                        open_ |= asks[:, None] & near & (distance < np.inf) & boxes.present[None, :, j]
                    chosen = open_ & ~chosen
                point, box = np.nonzero(chosen)
                at = pa.array(point)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(boxes.ids[box]), batch["q"].take(at), batch["pattern"].take(at), batch["z"].take(at)],
                    ["box", "q", "pattern", "z"])

    return points.mapInArrow(look, VISIT)


def lowest(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least of every row; of equal ones the first."""
    if distance.shape[1] <= k:
        row, column = np.nonzero(np.ones(distance.shape, bool))
    else:
        row, column = np.nonzero(distance <= np.partition(distance, k - 1, axis=1)[:, k - 1, None])
    order = np.lexsort((column, distance[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def meeting(k: int, width: int, schema: str):
    """The k nearest donors of one box for each point that visits it."""

    def meet(key: tuple, points: pa.Table, donors: pa.Table) -> pa.Table:
        found, told = [], []
        if points.num_rows and donors.num_rows:
            d = numbers(donors["z"].combine_chunks(), width)
            z = numbers(points["z"].combine_chunks(), width)
            order = np.argsort(donors["donor"].to_numpy(zero_copy_only=False), kind="stable")
            d = d[order]  # by key, so that a stable sort breaks ties by key
            for low in range(0, len(z), max(1, HELD // len(d))):
                part = z[low:low + max(1, HELD // len(d))]
                square, common = np.zeros((len(part), len(d))), np.zeros((len(part), len(d)))
                for i in np.flatnonzero(~np.isnan(part).all(0)):
                    both = ~np.isnan(part[:, i, None]) & ~np.isnan(d[None, :, i])
                    square += np.where(both, (part[:, i, None] - d[None, :, i]) ** 2, 0.0)
                    common += both
                distance = np.round(square * (width / common), DIGITS)
                point, donor = lowest(distance, k)
                told.append(distance[point, donor])
                found.append((point + low, order[donor]))
        at = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1)]
        return pa.table({
            "q": points["q"].take(pa.array(at[0])), "pattern": points["pattern"].take(pa.array(at[0])),
            "d2": pa.array(np.concatenate(told) if told else np.zeros(0)),
            "donor": donors["donor"].take(pa.array(at[1])), "x": donors["x"].take(pa.array(at[1]))})

    return meet


def met(asked: DataFrame, donors: DataFrame, k: int, width: int) -> DataFrame:
    """Every visit as a meeting in its box; a box of many visits is dealt to several tasks."""
    parts = asked.groupBy("box").agg(F.ceil(F.count("*") / F.lit(VISITS)).cast("int").alias("parts"))
    left = asked.join(parts, "box").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    right = donors.join(parts, "box").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kind = donors.schema["donor"].dataType.simpleString()
    schema = f"q long, pattern string, d2 double, donor {kind}, x array<double>"
    return left.select("box", "part", "q", "pattern", "z").groupBy("box", "part").cogroup(
        right.select("box", "part", "donor", "z", "x").groupBy("box", "part")).applyInArrow(
        meeting(k, width, schema), schema)


def nearest(found: DataFrame, k: int, width: int) -> DataFrame:
    """(q, j, rank, d2, donor, value): the k nearest donors of each missing feature of each point."""
    asks = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: (
        (F.substring("pattern", j + 1, F.lit(1)) == "0") & F.get("x", j).isNotNull()))
    each = Window.partitionBy("q", "j").orderBy("d2", "donor")
    return (found.withColumn("j", F.explode(asks)).withColumn("value", F.get("x", F.col("j")))
            .select("q", "j", "d2", "donor", "value")
            .withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k))


def pattern_of(z: Column, width: int) -> Column:
    """One character per feature: 1 if present."""
    return F.array_join(F.transform(z, lambda v: F.when(v.isNull(), "0").otherwise("1")), "")


def serves(z: np.ndarray, pattern: str) -> np.ndarray:
    """Whether a donor shares a feature with the points of the pattern and has one they lack."""
    has, known = np.array([c == "1" for c in pattern]), ~np.isnan(z)
    return known[:, has].any(1) & known[:, ~has].any(1)


def serving(z: np.ndarray, pattern: str) -> np.ndarray:
    return z[serves(z, pattern)]


def means_of_nearest(donors: DataFrame, points: DataFrame, k: int, width: int, leaf: int = LEAF) -> DataFrame:
    """(pattern, z, means): for each distinct point the mean of its k nearest donors, feature by feature.

    `donors` has donor (a unique key), z and x; `points` has z. A feature that no comparable donor has
    is absent from the map `means`. Donors that look alike keep their k lowest keys, which is as many as
    one point can use, so that a crowded point is no crowd.
    """
    lowest = Window.partitionBy("z").orderBy("donor")
    pool = stored(donors.withColumn("pattern", pattern_of(F.col("z"), width))
                  .withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k).drop("n"), "donors")
    frequent = pool.groupBy("pattern").count()
    size = frequent.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # Boxes as large as there are boxes: a point sees all boxes and a few of their donors.
    fill = max(leaf, math.isqrt(size))
    levels = max(0, math.ceil(math.log2(max(size / fill, 1))))
    large = frequent.where(F.col("count") >= 2 * fill).orderBy(F.col("count").desc(), "pattern").limit(PATTERNS)
    used = {r["pattern"]: min(levels, int(math.log2(r["count"] / fill))) for r in large.collect()}
    share = min(1.0, SAMPLE / max(size, 1))
    sample = (pool.sample(share, seed=0) if share < 1 else pool).select("z").toArrow()["z"].combine_chunks()
    sample = numbers(sample, width)
    # Few bytes, much work: dealt by number, as partitions by size would all be one.
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = stored(points.select("z").distinct().repartition(parts, "z").select(
        "z", pattern_of(F.col("z"), width).alias("pattern"), F.monotonically_increasing_id().alias("q")), "points")
    often = asked.groupBy("pattern").count().orderBy(F.col("count").desc(), "pattern").limit(TREES + 1).collect()
    own = [r["pattern"] for r in often if "1" in r["pattern"]][:TREES]
    trees = [medians(serving(sample, p), levels, used, [i for i, c in enumerate(p) if c == "1"]) for p in own]
    shared = [medians(sample, levels, used)] if len(often) > len(own) else []

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, patterns = numbers(batch["z"], width), batch["pattern"].to_pylist()
            for number, tree in enumerate([*trees, *shared]):
                rows = np.arange(len(z)) if number == len(trees) else np.flatnonzero(serves(z, own[number]))
                cells = tree.cells(z[rows], [patterns[i] for i in rows])
                yield batch.take(pa.array(rows)).append_column("tree", pa.array(np.full(len(rows), number), pa.int32())
                                                               ).append_column("cell", pa.array(cells, pa.int64()))

    schema = pool.withColumn("tree", F.lit(0)).withColumn("cell", F.lit(0).cast("long")).schema
    boxed = stored(pool.mapInArrow(dealt, schema).withColumn("box", F.xxhash64("tree", "pattern", "cell")), "boxes")
    bounds = boxed.groupBy("box").agg(
        F.count("*").alias("n"), F.any_value("pattern").alias("pattern"), F.any_value("tree").alias("tree"),
        F.array(*[F.min(F.col("z")[i]) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.col("z")[i]) for i in range(width)]).alias("high"))
    listed = stored(bounds, "bounds")
    # About as many boxes as the root of the donors, and one for each rare pattern; blocks bound what is sent.
    blocks = {r["tree"]: -(-r["count"] // BOXES) for r in listed.groupBy("tree").count().collect()}

    def block(tree: int, number: int) -> Boxes:
        rows = listed.where((F.col("tree") == tree) & (F.pmod("box", F.lit(blocks[tree])) == number)).orderBy("box").toArrow()
        return Boxes(rows["box"].to_numpy(), rows["n"].to_numpy(),
                     np.array([[c == "1" for c in p] for p in rows["pattern"].to_pylist()]).reshape(-1, width),
                     numbers(rows["low"].combine_chunks(), width), numbers(rows["high"].combine_chunks(), width))

    def searched(rows: DataFrame, tree: int) -> DataFrame:
        """The points of one tree."""
        return rows.where(F.col("pattern") == own[tree] if tree < len(own) else ~F.col("pattern").isin(own))

    first, last = None, None
    lists = [(tree, block(tree, i)) for tree in sorted(blocks) for i in range(blocks[tree])]
    for tree, boxes in lists:
        visit = visits(searched(asked, tree).select("q", "pattern", "z"), boxes, k, width, False)
        first = visit if first is None else first.unionByName(visit)
    if first is None:
        return asked.select("pattern", "z", F.create_map().cast("map<int,double>").alias("means"))
    near = stored(nearest(met(stored(first, "visits"), boxed, k, width), k, width), "near")
    limit = near.where(F.col("rank") == k).groupBy("q").agg(
        F.map_from_entries(F.array_agg(F.struct("j", "d2"))).alias("found"))
    limits = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.try_element_at("found", j))
    closed = asked.join(limit, "q", "left").select("q", "pattern", "z", F.coalesce(
        limits, F.array_repeat(F.lit(None).cast("double"), width)).alias("limits")).repartition(parts, "q")
    for tree, boxes in lists:
        visit = visits(searched(closed, tree), boxes, k, width, True)
        last = visit if last is None else last.unionByName(visit)
    more = nearest(met(stored(last, "visits"), boxed, k, width), k, width)
    each = Window.partitionBy("q", "j").orderBy("d2", "donor")
    final = near.unionByName(more).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)
    means = final.groupBy("q", "j").agg(F.avg("value").alias("mean")).groupBy("q").agg(
        F.map_from_entries(F.array_agg(F.struct("j", "mean"))).alias("means"))
    return asked.join(means, "q", "left").select("pattern", "z", "means")
