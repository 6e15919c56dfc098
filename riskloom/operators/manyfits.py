"""Many fits of linear families from the same scans: all settings and all folds advance together.

A row is read once per step, whatever the number of fits. One pass gives the cross products of every
fold and class; those of "all folds but one" are a subtraction, so least squares and ridge regression
need nothing more for any penalty. Penalised logit and probit take Newton steps: one pass carries
gradient, Hessian and objective of every fit that has not settled. Only sums travel to the driver, as
many as there are fits times the square of the number of columns.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.tails import normal_cdf_array
from riskloom.operators.frame import levels
from riskloom.operators.impute import fit_scaler
from riskloom.operators.regression import usable_rank
from riskloom.sources.tables import stored

# Ship these functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tables of sums that one task adds up.
SALTS = 64
#: Newton steps at most, halvings included, and the relative change that ends them.
STEPS, TOLERANCE = 60, 1e-10


# ---------------------------------------------------------------- the design


@dataclass(frozen=True)
class Design:
    """Rows as (key, target, fold, x): numbers scaled by all rows, then one column per text level."""

    rows: DataFrame
    names: tuple[str, ...]
    numeric: int
    columns: tuple  # expressions of x, for rows of other tables

    def vector(self, df: DataFrame) -> DataFrame:
        """Add `_x` to another table."""
        return df.withColumn("_x", F.array(*self.columns))


def design(df: DataFrame, features: list[str], target: str = "yd", key: str = "id", fold: str = "fold") -> Design:
    """Numbers and text levels of the features as one array per row, written once.

    A missing number takes the mean. A text has a column per level; a missing or unseen one has none.
    The number of levels decides the size of every sum, as it does for any fit.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    numbers = [c for c in features if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    texts = [c for c in features if isinstance(kinds[c], T.StringType)]
    columns, names = [], list(numbers)
    if numbers:
        scaler = fit_scaler(df.select(*[F.col(c).cast("double").alias(c) for c in numbers]), numbers)
        columns = [F.coalesce((F.col(c).cast("double") - (scaler.mean[c] or 0.0)) / scaler.std[c], F.lit(0.0))
                   for c in numbers]
    for c in texts:
        for value in sorted(r[0] for r in levels(df, c).where(F.col(c).isNotNull()).collect()):
            names.append(f"{c}={value}")
            columns.append(F.coalesce((F.col(c) == value).cast("double"), F.lit(0.0)))
    narrow = df.select(F.col(key).alias("_key"), F.col(target).cast("double").alias("_y"),
                       F.col(fold).cast("int").alias("_fold"), F.array(*columns).alias("_x"))
    return Design(stored(narrow, "design"), tuple(names), len(numbers), tuple(columns))


# ---------------------------------------------------------------- sums over all rows


def matrix_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Design matrix of a batch, the constant first."""
    x = batch["_x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.column_stack([np.ones(len(x)), x])


SUMS = "part int, fit int, sums array<double>"


def summed(key: tuple, table: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(row, float) for row in table["sums"].to_pylist()], axis=0)
    return pa.table({"part": pa.array([0], pa.int32()), "fit": table["fit"].slice(0, 1),
                     "sums": pa.array([total], pa.list_(pa.float64()))})


def totals(rows: DataFrame, add, width: int) -> dict[int, np.ndarray]:
    """Sums of `add(design matrix, targets, folds) -> {fit: array}` over all rows, fit by fit."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x, y = matrix_of(batch, width), batch["_y"].to_numpy(zero_copy_only=False)
                for fit, values in add(x, y, batch["_fold"].to_numpy(zero_copy_only=False)).items():
                    found[fit] = found[fit] + values if fit in found else values
        part = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(found), pa.int32()), pa.array(list(found), pa.int32()),
             pa.array(list(found.values()), pa.list_(pa.float64()))], ["part", "fit", "sums"])

    each = rows.select("_x", "_y", "_fold").mapInArrow(per_task, SUMS)
    once = each.groupBy("part", "fit").applyInArrow(summed, SUMS)
    return {r["fit"]: np.array(r["sums"]) for r in once.groupBy("fit").applyInArrow(summed, SUMS).collect()}


def cross_products(rows: DataFrame, width: int, k: int) -> np.ndarray:
    """[fold, class, column, column]: cross products with the constant; fold and class as indices."""

    def add(x, y, fold):
        return {int(f) * 2 + c: (x[at].T @ x[at]).ravel()
                for f in np.unique(fold) for c in (0, 1) for at in [(fold == f) & (y == c)] if at.any()}

    found = totals(rows, add, width)
    none = np.zeros((width + 1) ** 2)
    return np.array([[found.get(f * 2 + c, none).reshape(width + 1, -1) for c in (0, 1)] for f in range(k)])


# ---------------------------------------------------------------- fits


@dataclass(frozen=True)
class Fit:
    """One setting of a family, learnt from all folds but `fold` (-1: from all)."""

    family: str
    setting: float | None
    fold: int
    coef: np.ndarray  # constant first, on the columns of the design
    settled: bool = True
    steps: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Score as the family defines it: a probability, or the distance of a ridge regression.

        Twelve digits, so that equal rows have equal scores wherever they stand.
        """
        value = x @ self.coef
        if self.family == "logreg":
            value = 1 / (1 + np.exp(-np.clip(value, -700, 700)))
        elif self.family == "probit":
            value = normal_cdf_array(value)
        if self.family in ("probit", "ols"):
            value = np.clip(value, 1e-9, 1 - 1e-9)
        return np.round(value, 12)

    @property
    def cut(self) -> float:
        return 0.0 if self.family == "ridge" else 0.5


@dataclass(frozen=True)
class Sample:
    """Cross products of the rows that a fit learns from, and the scaling these rows have."""

    by_class: np.ndarray  # [class, column, column]
    to_design: np.ndarray  # coefficients on columns scaled by these rows -> on columns of the design

    @property
    def counts(self) -> np.ndarray:
        return self.by_class[:, 0, 0]

    def weights(self) -> np.ndarray:
        """Balanced class weights; they add up to the number of rows."""
        return self.counts.sum() / (2 * np.maximum(self.counts, 1))


def sample_of(products: np.ndarray, fold: int, numeric: int) -> Sample:
    by_class = products.sum(0) - (products[fold] if fold >= 0 else 0)
    both = by_class.sum(0)
    n, size = max(both[0, 0], 1), len(both)
    mean = both[0] / n
    sd = np.sqrt(np.maximum(np.diag(both) / n - mean**2, 0))
    move = np.eye(size)
    for j in range(1, numeric + 1):
        scale = sd[j] if sd[j] > 1e-12 else 1.0
        move[j, j], move[0, j] = 1 / scale, -mean[j] / scale
    return Sample(by_class, move)


def centred(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, means and centred cross products from those with the constant."""
    n, mean = gram[0, 0], gram[0] / max(gram[0, 0], 1e-300)
    return n, mean, gram - n * np.outer(mean, mean)


def least_squares(sample: Sample) -> np.ndarray:
    """Minimum-norm least squares of the class on the columns."""
    move = sample.to_design
    gram = move.T @ sample.by_class.sum(0) @ move
    target = move.T @ sample.by_class[1][:, 0]
    _, _, cross = centred(gram)
    if usable_rank(cross[1:, 1:]) == len(gram) - 1:
        return move @ np.linalg.solve(gram, target)
    values, vectors = np.linalg.eigh(gram)
    live = values > 1e-10 * max(values.max(), 1e-300)
    return move @ ((vectors[:, live] / values[live]) @ (vectors[:, live].T @ target))


def ridge(sample: Sample, alpha: float) -> np.ndarray:
    """Balanced ridge regression of -1/+1; the constant is free."""
    w, move = sample.weights(), sample.to_design
    gram = move.T @ np.tensordot(w, sample.by_class, 1) @ move
    target = move.T @ (w[1] * sample.by_class[1][:, 0] - w[0] * sample.by_class[0][:, 0])
    n, mean, cross = centred(gram)
    slope = np.linalg.solve(cross[1:, 1:] + alpha * np.eye(len(gram) - 1), target[1:] - mean[1:] * target[0])
    return move @ np.concatenate([[target[0] / max(n, 1e-300) - mean[1:] @ slope], slope])


@dataclass
class Search:
    """A fit under way: where it stands, the best so far and the step that is being tried."""

    fit: Fit
    sample: Sample
    weights: tuple[float, float]
    penalty: float
    at: np.ndarray  # on columns scaled by the rows it learns from
    step: np.ndarray
    best: float = math.inf
    done: bool = False

    def read(self, sums: np.ndarray) -> None:
        """Take in objective, gradient and Hessian at `at + step`; halve the step or go on from there."""
        size, move = len(self.at), self.sample.to_design
        tried, ridge_ = self.at + self.step, self.penalty * np.concatenate([[0.0], np.ones(size - 1)])
        value = sums[0] + 0.5 * float(ridge_ @ tried**2)
        if not value <= self.best + 1e-9 * (1 + abs(self.best)):
            self.step = self.step / 2
            self.done = bool(np.abs(self.step).max() < 1e-12)
        else:
            gradient = move.T @ sums[1:size + 1] + ridge_ * tried
            hessian = move.T @ sums[size + 1:].reshape(size, size) @ move + np.diag(ridge_)
            change = self.best - value
            self.at, self.best = tried, min(value, self.best)
            self.step = -np.linalg.pinv(hessian, rcond=1e-12, hermitian=True) @ gradient
            decrease = float(-gradient @ self.step)
            self.done = decrease < TOLERANCE * (1 + abs(value)) * 1e-4 and change < 1e-6 * (1 + abs(value))
            if self.done:
                self.at = self.at + self.step
        self.fit = replace(self.fit, steps=self.fit.steps + 1)

    def result(self) -> Fit:
        # Without a penalty a loss of nearly nothing means separated classes: there is no best fit.
        separated = self.penalty == 0 and self.best < 1e-4 * float(self.sample.counts.sum())
        return replace(self.fit, coef=self.sample.to_design @ self.at, settled=bool(self.done) and not separated)


def loss(family: str, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minus log-likelihood, its slope and its (expected) curvature in the linear predictor."""
    side = 2 * y - 1
    if family == "logreg":
        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        return np.logaddexp(0, -side * eta), p - y, np.maximum(p * (1 - p), 1e-300)
    density = np.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
    own = np.maximum(normal_cdf_array(side * eta), 1e-300)
    other = np.maximum(normal_cdf_array(-side * eta), 1e-300)
    return -np.log(own), -side * density / own, np.maximum(density * density / (own * other), 1e-300)


def newton(rows: DataFrame, width: int, searches: list[Search]) -> list[Fit]:
    """All searches at once: one pass over the rows per step."""
    for _ in range(STEPS):
        open_ = {i: s for i, s in enumerate(searches) if not s.done}
        if not open_:
            break
        tries = [(i, s.fit.family, s.fit.fold, s.weights, s.sample.to_design @ (s.at + s.step)) for i, s in open_.items()]

        def add(x, y, fold, tries=tries):
            out = {}
            for i, family, without, weights, coef in tries:
                at = fold != without
                part, known = x[at], y[at]
                value, slope, curve = loss(family, part @ coef, known)
                w = np.where(known == 1, weights[1], weights[0])
                out[i] = np.concatenate([[w @ value], part.T @ (w * slope),
                                         (part.T @ (part * (w * curve)[:, None])).ravel()])
            return out

        sums = totals(rows, add, width)
        for i, s in open_.items():
            s.read(sums[i])
    return [s.result() for s in searches]


def many_fits(
    plan: Design, settings: dict[str, list], k: int = 5, whole: bool = True
) -> list[Fit]:
    """Fits of every family, setting and left-out fold; with `whole` those from all rows too (fold -1).

    `settings` maps "logreg" to values of C, "ridge" to penalties, "probit" and "ols" to [None].
    Fold-wise scaling is exact: it is a change of coordinates of the same sums.
    """
    width = len(plan.names)
    products = cross_products(plan.rows, width, k)
    folds = [*range(k), *([-1] if whole else [])]
    samples = {f: sample_of(products, f, plan.numeric) for f in folds}
    done, open_ = [], []
    for family, values in settings.items():
        for value in values:
            for f in folds:
                sample, start = samples[f], np.zeros(width + 1)
                if family == "ols":
                    done.append(Fit(family, value, f, least_squares(sample)))
                elif family == "ridge":
                    done.append(Fit(family, value, f, ridge(sample, value)))
                else:
                    weights = tuple(sample.weights()) if family == "logreg" else (1.0, 1.0)
                    open_.append(Search(Fit(family, value, f, start, False), sample, weights,
                                        1 / value if family == "logreg" else 0.0, start, start.copy()))
    return [*done, *newton(plan.rows, width, open_)]


# ---------------------------------------------------------------- scores


SCORED = "family string, setting double, fold int, _key {key}, _y double, score double, hit int"


def scores(plan: Design, fits: list[Fit], rows: DataFrame | None = None) -> DataFrame:
    """One row per row and fit: family, setting, fold, key, target, score and whether the class is right.

    Without `rows` every fit of a left-out fold scores that fold; with `rows` (key, target and `_x`)
    every fit scores all of them. One pass, no shuffle.
    """
    unseen, width = rows is None, len(plan.names)
    rows = plan.rows if unseen else rows.withColumn("_fold", F.lit(-1))
    schema = SCORED.format(key=rows.schema["_key"].dataType.simpleString())
    told = [f for f in fits if f.fold >= 0] if unseen else fits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = matrix_of(batch, width), batch["_y"].to_numpy(zero_copy_only=False)
            fold, key = batch["_fold"].to_numpy(zero_copy_only=False), batch["_key"]
            for f in told:
                at = np.flatnonzero(fold == f.fold) if unseen else np.arange(len(x))
                value = f.score(x[at])
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.family] * n, pa.string()), pa.array([f.setting] * n, pa.float64()),
                     pa.array([f.fold] * n, pa.int32()), key.take(pa.array(at)), pa.array(y[at]), pa.array(value),
                     pa.array(((value >= f.cut) == (y[at] == 1)).astype(np.int32))],
                    ["family", "setting", "fold", "_key", "_y", "score", "hit"])

    return rows.select("_key", "_y", "_fold", "_x").mapInArrow(score, schema)


def accuracies(out_of_fold: DataFrame) -> list[tuple[str, float | None, float]]:
    """(family, setting, mean accuracy over the folds), from the scores of unseen folds."""
    by_fold = out_of_fold.groupBy("family", "setting", "fold").agg(F.avg("hit").alias("accuracy"))
    return [tuple(r) for r in by_fold.groupBy("family", "setting").agg(F.avg("accuracy")).collect()]
