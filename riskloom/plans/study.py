"""The three studies: refit study, model comparison and hold-out study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evaluate import auc, concordance
from riskloom.operators.frame import (
    check_binary_target, complete_cases, finite_rows, resolve_features,
)
from riskloom.operators.impute import knn_impute
from riskloom.operators.regression import (
    comparison_table, long_scores, residual_table, score_table, three_fits,
)
from riskloom.operators.sampling import random_split, systematic_split
from riskloom.plans.classifiers import GRIDS
from riskloom.plans.selection import compare_splits
from riskloom.sources.tables import stored


@dataclass(frozen=True)
class Fitted:
    """Three fits on one sample with their scores and tables."""

    fits: list
    scores: DataFrame
    table: DataFrame


def fit_sample(df: DataFrame, features: list[str], target: str = "yd", key: str = "id") -> Fitted:
    clean = finite_rows(df, [*features, target])
    fits = three_fits(clean, features, target)
    return Fitted(fits, score_table(clean, fits, features, target, key),
                  comparison_table(clean, fits, target))


def split_complete_rows(
    df: DataFrame, sort: list[str], tie: str, target: str = "yd", columns: list[str] | None = None
) -> DataFrame:
    """Complete rows, indexed in sort order, every second one marked for validation."""
    clean = complete_cases(check_binary_target(df, target), columns)
    return systematic_split(clean, sort, tie)


def refit_study(indexed: DataFrame, features: list[str], target: str = "yd") -> dict[str, DataFrame]:
    """Fit on the estimation sample, refit on the validation sample, residuals of the latter.

    Scores stay aligned with their own rows by `id`.
    """
    features = resolve_features(indexed, features)
    train = fit_sample(indexed.where(F.col("dumVE") == 0), features, target)
    valid = fit_sample(indexed.where(F.col("dumVE") == 1), features, target)
    return {
        "train_table": train.table, "train_scores": train.scores,
        "valid_table": valid.table, "valid_scores": valid.scores,
        "train_concordance": concordance(
            long_scores(train.scores, target), "p_hat", target, ["Model"]
        ),
        "residuals": residual_table(valid.scores, target),
    }


def holdout_scores(
    df: DataFrame, features: list[str], target: str = "yd", key: str = "id", test_share: float = 0.25
) -> tuple[list, DataFrame]:
    """Fit on a random train sample, score both samples: key, target, features, sample, scores."""
    split = stored(random_split(finite_rows(df, [*features, target]), test_share, None, key))
    train = split.where(F.col("in_test") == 0)
    fits = three_fits(train, features, target)
    return fits, score_table(split, fits, features, target, key, ["in_test"])


def holdout_study(
    df: DataFrame, features: list[str], target: str = "yd", key: str = "id",
    impute: list[str] | None = None, test_share: float = 0.25,
) -> dict[str, DataFrame]:
    """Impute, split at random, fit on train, compare train and test AUC."""
    filled = stored(knn_impute(df, impute, 3, key)) if impute else df
    features = resolve_features(filled, features)
    fits, scores = holdout_scores(filled, features, target, key, test_share)
    train_scores = scores.where(F.col("in_test") == 0).drop("in_test")
    marked = long_scores(scores, target, key, keep=["in_test"])
    return {
        "train_scores": train_scores,
        "table": comparison_table(
            finite_rows(filled, [*features, target]).join(train_scores.select(key), key, "left_semi"),
            fits, target,
        ),
        "auc": auc(marked, "p_hat", target, ["Model", "in_test"]),
    }


def comparison_study(
    df: DataFrame, features: list[str], sort: list[str], tie: str, target: str = "yd",
    grids: dict = GRIDS, k: int = 5, fit_on: DataFrame | None = None,
) -> DataFrame:
    """Index all rows, impute the features, compare the models under both splits."""
    checked = check_binary_target(df, target)
    indexed = systematic_split(checked, sort, tie)
    chosen = resolve_features(indexed, features)
    filled = stored(knn_impute(indexed, chosen, 3, "id", fit_on=fit_on))
    return compare_splits(filled, chosen, target, "id", k=k, grids=grids)
