"""Grid search, cross-validated AUC, leaderboard and comparison of splits.

Every search ends in one stored table of scores (model, sample, fold, key, target, score), which the
AUC of folds and samples and the ROC curves read. Linear families fit all settings and folds from the
same scans. A forest is grown once per leaf size and fold, all from the same scans, at the largest number
of trees and depth of the grid; fewer trees are its first ones and smaller depths its upper nodes. Boosted
fits share the cells of their fold and are grown whole, a task each; if the cells are too many for a task, Spark's own
boosting deals the rows of each fit to tasks, and fits run side by side.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import manyboosts, manyfits, manytrees
from riskloom.operators.evaluate import auc, roc_curve
from riskloom.operators.sampling import random_split, stratified_folds
from riskloom.plans.classifiers import (
    BOOSTING_LEAF, GRIDS, SEED, VECTOR, Boosting, Forest, LinearProbability, PenalizedLogit, Probit, Ridge, preprocessor,
)
from riskloom.sources.tables import scratch_path, stored

# Ship these functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Families that are fitted from sums, by estimator: name there and the tuned value.
LINEAR = {PenalizedLogit: ("logreg", "C"), Probit: ("probit", None), LinearProbability: ("ols", None),
          Ridge: ("ridge", "alpha")}
LINEAR_GRIDS = {n: g for n, g in GRIDS.items() if g[0] in LINEAR}
TREE_GRIDS = {n: g for n, g in GRIDS.items() if g[0] not in LINEAR}

LEADERBOARD = (
    "model string, cv_auc double, train_auc double, test_auc double, "
    "best_params map<string,string>"
)
CV, TRAIN, TEST = "cv", "train", "test"
#: Fits of Spark's boosting at once and rows of one task: their jobs are many and small, and tasks of few rows hold the others up.
PARALLEL, TASK_ROWS = 6, 25_000


@dataclass(frozen=True)
class Search:
    """Best settings of each model, and its scores: unseen folds, the training rows, the held-out rows."""

    params: dict[str, dict[str, str]]
    scores: DataFrame
    grid: tuple = ()  # (model, settings, mean accuracy over the folds, whether it is the best)

    def sample(self, name: str) -> DataFrame:
        return self.scores.where(F.col("sample") == name)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def best_setting(settings: list, accuracy: dict) -> object:
    """The setting of the highest accuracy; of equal ones the first."""
    return max(settings, key=lambda s: round(accuracy.get(s, 0.0), 12))


# ---------------------------------------------------------------- linear families


def linear_search(
    folded: DataFrame, held: DataFrame | None, features: list[str], target: str = "yd", key: str = "id",
    k: int = 5, grids: dict = LINEAR_GRIDS,
) -> Search:
    """All settings of the linear families, best by mean accuracy over the folds in column `fold`."""
    families = {LINEAR[kind][0]: name for name, (kind, _, _) in grids.items()}
    if len(families) < len(grids):
        raise ValueError("each linear family can stand once in the grids")
    axes = {LINEAR[kind][0]: LINEAR[kind][1] for kind, _, _ in grids.values()}
    settings = {LINEAR[kind][0]: [v for values in grid.values() for v in values] or [fixed.get(LINEAR[kind][1])]
                for kind, grid, fixed in grids.values()}
    plan = manyfits.design(folded, features, target, key)
    fits = manyfits.many_fits(plan, settings, k)
    unseen = stored(manyfits.scores(plan, fits), "scores")
    accuracy = {(f, s): a for f, s, a in manyfits.accuracies(unseen)}
    chosen = {f: best_setting([(f, v) for v in values], accuracy)[1] for f, values in settings.items()}
    whole = [f for f in fits if f.fold < 0 and chosen[f.family] == f.setting]

    is_best = reduce(lambda a, b: a | b, [
        (F.col("family") == f) & F.col("setting").eqNullSafe(F.lit(v).cast("double")) for f, v in chosen.items()])
    samples = {CV: unseen.where(is_best), TRAIN: manyfits.scores(plan, whole, plan.rows)}
    if held is not None:
        rows = plan.vector(held).select(F.col(key).alias("_key"), F.col(target).cast("double").alias("_y"), "_x")
        samples[TEST] = manyfits.scores(plan, whole, rows)
    model = F.lit(None)
    for family, name in families.items():
        model = F.when(F.col("family") == family, name).otherwise(model)
    scores = stack([
        df.select(model.alias("model"), F.lit(sample).alias("sample"), "fold", F.col("_key").alias(key),
                  F.col("_y").cast("int").alias(target), "score")
        for sample, df in samples.items()])

    def named(f: str, value) -> dict[str, str]:
        return {axes[f]: str(value)} if grids[families[f]][1] else {}

    grid = tuple((families[f], named(f, v), accuracy.get((f, v)), v == chosen[f])
                 for f, values in settings.items() for v in values)
    return Search({families[f]: named(f, v) for f, v in chosen.items()}, stored(scores, "scores"), grid)


# ---------------------------------------------------------------- forests


@dataclass(frozen=True)
class Nodes:
    """A forest as arrays; `first` is the place of each tree's root."""

    first: np.ndarray
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    sides: np.ndarray | None  # of a yes/no column: whether 0 and 1 go left; NaN for numbers; None: all numbers
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # of class 1

    def probabilities(self, x: np.ndarray, counts: list[int], depths: list[int]) -> np.ndarray:
        """[row, setting]: mean share over the first trees, at most so deep, for all pairs of the two."""
        sums, out = np.zeros((len(x), len(depths))), {}
        rows = np.arange(len(x))
        for tree, root in enumerate(self.first[:max(counts)], 1):
            at = np.full(len(x), root)
            for depth in range(max(depths) + 1):
                if depth in depths:
                    sums[:, depths.index(depth)] += self.share[at]
                inner = self.feature[at] >= 0
                if not inner.any():
                    for deeper in [d for d in depths if d > depth]:
                        sums[:, depths.index(deeper)] += self.share[at]
                    break
                value = x[rows, np.maximum(self.feature[at], 0)]
                goes_left = value <= self.threshold[at]
                if self.sides is not None:
                    side = np.where(value == 0, self.sides[at, 0], self.sides[at, 1])
                    goes_left = np.where(np.isnan(side), goes_left, side > 0)
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            if tree in counts:
                out[tree] = sums / tree
        return np.concatenate([out[c] for c in counts], axis=1)


def forest_nodes(spark, model) -> Nodes:
    """The nodes of a fitted forest as Spark saves them: at most trees * 2 ** (depth + 1)."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.impurityStats", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.numCategories").alias("kinds"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("at")).toArrow().sort_by(
        [("treeID", "ascending"), ("id", "ascending")])
    tree, node = rows["treeID"].to_numpy(), rows["id"].to_numpy()
    first = np.flatnonzero(np.diff(tree, prepend=-1))
    root = first[np.searchsorted(tree[first], tree)]
    if not np.array_equal(node, np.arange(len(node)) - root):
        raise ValueError("node ids of a tree are expected to be 0, 1, ...")
    kinds, at = rows["kinds"].to_numpy(), rows["at"].to_pylist()
    if (kinds > 2).any():
        raise ValueError("only numbers and yes/no columns can be split")
    sides = np.array([[float(c in a) for c in (0.0, 1.0)] if n == 2 else [math.nan] * 2 for n, a in zip(kinds, at)])
    threshold = np.array([a[0] if n == -1 and a else 0.0 for n, a in zip(kinds, at)])
    stats = np.array(rows["impurityStats"].to_pylist())
    left, right = (rows[c].to_numpy() for c in ("leftChild", "rightChild"))
    feature = np.where(left >= 0, rows["feature"].to_numpy(), -1)
    share = stats[:, 1] / np.maximum(stats.sum(1), 1e-300)
    return Nodes(first, feature, threshold, sides, left + root, right + root, share)


def grown_nodes(grown: manytrees.Grown, forest: int) -> Nodes:
    """The nodes of one of several forests grown together; columns are read as bins."""
    codes, shares = grown.codes[:, forest], grown.shares[:, forest]
    inner = np.zeros(shares.shape, bool)
    inner[:, :codes.shape[1]] = codes >= 0
    held = np.zeros(shares.shape, bool)
    held[:, 0] = True
    held[:, 1::2] = held[:, 2::2] = inner[:, :codes.shape[1]]
    number = (np.cumsum(held) - 1).reshape(held.shape).astype(np.int32)
    tree, place = np.nonzero(held)
    is_inner = inner[tree, place]
    code = np.where(is_inner, codes[tree, np.minimum(place, codes.shape[1] - 1)], -1)
    left = np.where(is_inner, number[tree, np.minimum(2 * place + 1, held.shape[1] - 1)], 0).astype(np.int32)
    return Nodes(number[:, 0], np.where(is_inner, code // manytrees.BINS, -1).astype(np.int16),
                 np.where(is_inner, code % manytrees.BINS, 0).astype(np.uint8), None, left,
                 np.where(is_inner, left + 1, 0).astype(np.int32), shares[tree, place])


SCORED = "model string, setting int, fold int, {key} {kind}, {target} int, score double"


def cell_scores(
    of: Callable[[np.ndarray], np.ndarray], rows: DataFrame, name: str, places: list[int], fold: int, target: str, key: str,
) -> DataFrame:
    """Scores of the settings numbered by `places` for all rows, from their cells [cell, column]; no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bins = np.array(batch[column].to_pylist(), object)
            cells, inverse = np.unique(bins, return_inverse=True)
            x = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
            found = of(x)[inverse]
            for j, place in enumerate(places):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([place] * n, pa.int32()),
                     pa.array([fold] * n, pa.int32()), batch[key], batch[target], pa.array(found[:, j])],
                    ["model", "setting", "fold", key, target, "score"])

    column, kind = manytrees.CELLS, rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(target).cast("int").alias(target), column).mapInArrow(
        score, SCORED.format(key=key, kind=kind, target=target))


def forest_scores(
    nodes: Nodes, rows: DataFrame, name: str, places: list[int], counts: list[int], depths: list[int],
    fold: int, target: str, key: str,
) -> DataFrame:
    """Scores of all settings (tree counts x depths, numbered by `places`) for all rows."""
    return cell_scores(lambda x: nodes.probabilities(x, counts, depths), rows, name, places, fold, target, key)


# ---------------------------------------------------------------- tree families


def settings_of(grid: dict) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def side_by_side(tasks: list[Callable], parallelism: int) -> list:
    """Results of independent fits, `parallelism` at a time."""
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(lambda task: task()), tasks)


def forest_fits(prepared, held, name, grid, fixed, settings, folds, target, key) -> list[DataFrame]:
    """Scores of every setting by forests grown once per leaf size and fold, all from the same scans.

    A fold is scored by the forest that did not see it; fold -1 stands for all rows, scored with the
    held-out ones (fold -2).
    """
    axes = {a: grid.get(a, [fixed.get(a)]) for a in ("trees", "depth", "leaf")}
    counts, depths = sorted(axes["trees"]), sorted(axes["depth"])
    cuts = manytrees.borders(prepared, VECTOR, target, key)
    rows = stored(manytrees.with_bins(prepared, VECTOR, cuts), "bins")
    unseen = None if held is None else stored(manytrees.with_bins(held, VECTOR, cuts), "bins")
    cells = stored(manytrees.cells_of(rows, target, max(folds) + 1), "cells")
    forests = [(leaf, fold) for leaf in axes["leaf"] for fold in folds]
    grown = manytrees.grow_forests(cells, forests, counts[-1], depths[-1], SEED)
    found = []
    for forest, (leaf, fold) in enumerate(forests):
        wanted = [{"trees": t, "depth": d, "leaf": leaf} for t in counts for d in depths]
        places = [settings.index({a: v for a, v in s.items() if a in grid}) for s in wanted]
        parts = [(fold, rows.where(F.col("fold") == fold))] if fold >= 0 else [(-1, rows), (-2, unseen)]
        nodes = grown_nodes(grown, forest)
        found += [forest_scores(nodes, part, name, places, counts, depths, at, target, key)
                  for at, part in parts if part is not None]
    return found


def boosted_fits(prepared, held, name, fixed, settings, wanted, target, key) -> list[DataFrame] | None:
    """Scores of the (setting, fold) pairs in `wanted` by boosted fits grown whole; None if a task cannot hold the cells."""
    folds = sorted({fold for _, fold in wanted})
    cuts = manyboosts.borders(prepared, VECTOR, key, folds)
    cells = stored(manyboosts.cells_of(prepared, VECTOR, target, cuts), "cells")
    most = max((r[1] for r in cells.groupBy("fold").count().collect()), default=0)
    if most * len(cuts[folds[0]]) > manyboosts.TASK_BINS:
        return None
    values = [{**fixed, **settings[place]} for place, _ in wanted]
    fits = [(fold, v["rate"], v["depth"], v["rounds"]) for (_, fold), v in zip(wanted, values)]
    models = dict(zip(wanted, manyboosts.grow_boosted(cells, fits, BOOSTING_LEAF)))
    found = []
    for fold in folds:
        places = [place for place, at in wanted if at == fold]
        grown = [models[place, fold] for place in places]
        of = lambda x, grown=grown: np.stack([m.probabilities(x) for m in grown], 1)
        parts = [(fold, prepared.where(F.col("fold") == fold))] if fold >= 0 else [(-1, prepared), (-2, held)]
        found += [cell_scores(of, manytrees.with_bins(rows.select(key, target, VECTOR), VECTOR, cuts[fold]),
                              name, places, at, target, key) for at, rows in parts if rows is not None]
    return found


def plain_fits(prepared, held, name, kind, fixed, settings, wanted, target, key, parallelism) -> list[DataFrame]:
    """Scores of the (setting, fold) pairs in `wanted`, a fit for each."""
    if kind is Boosting:
        grown = boosted_fits(prepared, held, name, fixed, settings, wanted, target, key)
        if grown is not None:
            return grown

    def run(place: int, fold: int) -> Callable:
        def task() -> list[DataFrame]:
            learnt = prepared.where(F.col("fold") != fold) if fold >= 0 else prepared
            model = kind(target=target, **fixed, **settings[place]).fit(learnt)
            parts = [(fold, prepared.where(F.col("fold") == fold))] if fold >= 0 else [(-1, prepared), (-2, held)]
            return [model.transform(rows).select(
                F.lit(name).alias("model"), F.lit(place).alias("setting"), F.lit(at).alias("fold"), key,
                F.col(target).cast("int").alias(target), "score") for at, rows in parts if rows is not None]
        return task

    return [df for dfs in side_by_side([run(*w) for w in wanted], parallelism) for df in dfs]


def tree_search(
    folded: DataFrame, held: DataFrame | None, features: list[str], target: str = "yd", key: str = "id",
    k: int = 5, grids: dict = TREE_GRIDS, parallelism: int = PARALLEL,
) -> Search:
    """All settings of the tree families, best by mean accuracy over the folds in column `fold`.

    Features are assembled once from all training rows: trees do not depend on the scaling of a
    column, and a text level that a fit has not seen is a column without a split.
    """
    fitted = Pipeline(stages=preprocessor(folded, features)).fit(folded)
    prepared = stored(fitted.transform(folded).select(key, target, "fold", VECTOR), "prepared")
    if held is not None:
        held = stored(fitted.transform(held).select(key, target, VECTOR), "prepared")
    params, tables, told = {}, [], []
    for name, (kind, grid, fixed) in grids.items():
        settings, folds = settings_of(grid), list(range(k))
        if kind is Forest:
            found = stored(stack(forest_fits(
                prepared, held, name, grid, fixed, settings, [*folds, -1], target, key)), "scores")
        else:
            prepared = stored(prepared.coalesce(max(1, -(-prepared.count() // TASK_ROWS))), "prepared")
            wanted = [(i, fold) for i in range(len(settings)) for fold in folds]
            found = stored(stack(plain_fits(
                prepared, held, name, kind, fixed, settings, wanted, target, key, parallelism)), "scores")
        hit = ((F.col("score") >= 0.5) == (F.col(target) == 1)).cast("int")
        by_fold = found.where("fold >= 0").groupBy("setting", "fold").agg(F.avg(hit).alias("right"))
        accuracy = {r[0]: r[1] for r in by_fold.groupBy("setting").agg(F.avg("right")).collect()}
        best = best_setting(list(range(len(settings))), accuracy)
        if kind is not Forest:
            whole = plain_fits(prepared, held, name, kind, fixed, settings, [(best, -1)], target, key, 1)
            found = stack([found, *whole])
        named = [{a: str(v) for a, v in setting.items()} for setting in settings]
        told += [(name, n, accuracy.get(i), i == best) for i, n in enumerate(named)]
        params[name] = named[best]
        tables.append(found.where(F.col("setting") == best))
    sample = F.when(F.col("fold") >= 0, CV).when(F.col("fold") == -1, TRAIN).otherwise(TEST)
    scores = stack(tables).select("model", sample.alias("sample"), "fold", key, target, "score")
    return Search(params, stored(scores, "scores"), tuple(told))


# ---------------------------------------------------------------- comparisons


def search_models(
    train: DataFrame, valid: DataFrame | None, features: list[str], target: str = "yd", key: str = "id",
    k: int = 5, grids: dict = GRIDS, parallelism: int = PARALLEL,
) -> Search:
    """Search over all families of the grids; the folds are fixed once and shared by all models."""
    keep = [key, target, *features]
    folded = stored(stratified_folds(train.select(*keep), k, target, key), "folds")
    held = None if valid is None else stored(valid.select(*keep), "held")
    found = []
    linear = {n: g for n, g in grids.items() if g[0] in LINEAR}
    trees = {n: g for n, g in grids.items() if g[0] not in LINEAR}
    if linear:
        found.append(linear_search(folded, held, features, target, key, k, linear))
    if trees:
        found.append(tree_search(folded, held, features, target, key, k, trees, parallelism))
    params = {n: p for s in found for n, p in s.params.items()}
    return Search({n: params[n] for n in grids}, stack([s.scores for s in found]),
                  tuple(row for s in found for row in s.grid))


def fold_aucs(search: Search, target: str = "yd") -> DataFrame:
    """AUC of the unseen rows of every fold, model by model; NULL for a fold with one class."""
    return auc(search.sample(CV), "score", target, ["model", "fold"])


def leaderboard(search: Search, target: str = "yd") -> DataFrame:
    """Mean AUC over the folds, AUC on the training and on the held-out rows; the best test AUC first.

    All areas come from one run over the stored scores. A fold with one class has no AUC and is left
    out of the mean.
    """
    areas = auc(search.scores, "score", target, ["model", "sample", "fold"])
    mean = [F.avg(F.when(F.col("sample") == s, F.col("auc"))).alias(f"{s}_auc") for s in (CV, TRAIN, TEST)]
    told = search.scores.sparkSession.createDataFrame(
        list(search.params.items()), "model string, best_params map<string,string>")
    board = areas.groupBy("model").agg(*mean).join(told, "model").select(
        "model", "cv_auc", "train_auc", "test_auc", "best_params")
    return board.orderBy(F.col("test_auc").desc_nulls_last(), "model")


def compare_models(
    train: DataFrame, valid: DataFrame, features: list[str], target: str = "yd", key: str = "id",
    k: int = 5, grids: dict = GRIDS, parallelism: int = PARALLEL,
) -> tuple[DataFrame, Search]:
    """Leaderboard by test AUC, and the search with the scores for later ROC curves."""
    search = search_models(train, valid, features, target, key, k, grids, parallelism)
    return leaderboard(search, target), search


def model_rocs(search: Search, target: str = "yd") -> DataFrame:
    """ROC points of every model on the held-out rows with its area, the best model first."""
    scores = search.sample(TEST)
    areas = auc(scores, "score", target, ["model"])
    return roc_curve(scores, "score", target, ["model"]).join(areas, "model").orderBy(
        F.col("auc").desc_nulls_last(), "model", F.col("threshold").desc()
    )


def compare_splits(
    df: DataFrame, features: list[str], target: str = "yd", key: str = "id", test_share: float = 0.25,
    k: int = 5, grids: dict = GRIDS, parallelism: int = PARALLEL,
) -> DataFrame:
    """Best model under the systematic split (column `dumVE`) and under a random split."""
    parts = random_split(df, test_share, target, key)
    plans = {
        "deterministic": (df.where(F.col("dumVE") == 0), df.where(F.col("dumVE") == 1)),
        "random": (parts.where(F.col("in_test") == 0), parts.where(F.col("in_test") == 1)),
    }
    best = []
    for name, (train, valid) in plans.items():
        board, _ = compare_models(train, valid, features, target, key, k, grids, parallelism)
        best.append(
            board.limit(1).select(
                F.lit(name).alias("split"), F.col("model").alias("best_model"), "train_auc", "test_auc"
            )
        )
    return stack(best)
