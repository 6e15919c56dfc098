"""Standardising and nearest-neighbour filling of missing cells; the search is in `neighbours`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import all_of, finite_or_null, is_finite
from riskloom.operators.neighbours import means_of_nearest, pattern_of


@dataclass(frozen=True)
class Scaler:
    """Mean and population sd of each feature, missing values left out."""

    mean: dict[str, float | None]
    std: dict[str, float]

    def scale(self, c: str) -> Column:
        return (finite_or_null(c) - F.lit(self.mean[c])) / F.lit(self.std[c])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scale(c) for c in self.mean})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.std[c] + F.lit(self.mean[c]) for c in self.mean})


def fit_scaler(df: DataFrame, features: list[str]) -> Scaler:
    row = df.agg(
        *[F.avg(finite_or_null(c)).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(finite_or_null(c)).alias(f"std_{c}") for c in features],
    ).first()
    return Scaler(
        {c: row[f"mean_{c}"] for c in features}, {c: row[f"std_{c}"] or 1.0 for c in features}
    )


def standardize(df: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    return fit_scaler(fit_on if fit_on is not None else df, features).transform(df)


def knn_impute(
    df: DataFrame, features: list[str], k: int = 3, key: str = "id", scale: bool = True,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Fill missing features with the mean of the k nearest donors; observed cells stay as they are.

    Distance: root of (features / features present in both) times the sum of squared differences
    on scaled values. Donors must have the wanted cell. Ties go to the lower key; without any
    comparable donor the column mean is used. `fit_on` restricts scaling and donors to a sample.
    Any number of features.
    """
    width, source = len(features), fit_on if fit_on is not None else df
    gap = ~all_of([is_finite(c) for c in features])
    if df.where(gap).isEmpty():
        return df
    scaler = fit_scaler(source, features)
    used = scaler if scale else Scaler({c: 0.0 for c in features}, {c: 1.0 for c in features})
    # A column without any value has no scale, and nothing to give.
    z = F.array(*[
        (used.scale(c) if scaler.mean[c] is not None else F.lit(None)).cast("double") for c in features])
    x = F.array(*[finite_or_null(c) for c in features])
    donors = source.select(F.col(key).alias("donor"), z.alias("z"), x.alias("x"))
    means = means_of_nearest(
        donors.where(F.exists("z", lambda v: v.isNotNull())), df.where(gap).select(z.alias("z")), k, width)
    known = lambda c: F.transform(c, lambda v: F.coalesce(v, F.lit(0.0)))
    answers = means.select(F.col("pattern").alias("_s"), known("z").alias("_z"), F.col("means").alias("_means"))
    rows = df.where(gap).withColumn("_z", z).withColumn("_s", pattern_of(F.col("_z"), width))
    filled = rows.withColumn("_z", known("_z")).join(answers, ["_s", "_z"], "left").withColumns({
        c: F.coalesce(finite_or_null(c), F.try_element_at("_means", F.lit(i)), F.lit(scaler.mean[c]).cast("double"))
        for i, c in enumerate(features)})
    whole = df.where(~gap).withColumns({c: F.col(c).cast("double") for c in features})
    return whole.select(*df.columns).unionByName(filled.select(*df.columns))
