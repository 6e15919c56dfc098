"""Selection, cleaning, validation and small projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import all_of, finite_or_null, is_finite, nan_to_null
from riskloom.sources.tables import TARGET, numeric_fields

BASE = ("yd", "id", "dumVE")


def select_except(df: DataFrame, skip: tuple[str, ...] = BASE) -> DataFrame:
    return df.drop(*skip)


def resolve_features(
    df: DataFrame, requested: list[str] | None = None, exclude: tuple[str, ...] = BASE
) -> list[str]:
    """Requested columns that exist, in the order asked for; all others when none is named."""
    found = (
        [c for c in requested if c in df.columns]
        if requested
        else [c for c in df.columns if c not in exclude]
    )
    if not found:
        raise ValueError(f"no usable feature among {requested}; the table has {df.columns}")
    return found


def numeric_features(df: DataFrame, skip: tuple[str, ...] = BASE) -> list[str]:
    return numeric_fields(df, skip)


def floating(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("double", "float")]


def nulls_for_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: nan_to_null(c) for c in columns or floating(df)})


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(all_of([is_finite(c) for c in columns]))


def finite_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, with NaN and infinities as NULL."""
    return df.withColumns({c: finite_or_null(c) for c in columns})


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    nan_possible = set(floating(df))
    return df.where(
        all_of(
            [
                F.col(c).isNotNull() & ~F.isnan(c) if c in nan_possible else F.col(c).isNotNull()
                for c in columns
            ]
        )
    )


def check_binary_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """The table with an integer target; other levels than 0 and 1 are an error."""
    if target not in df.columns:
        raise ValueError(f"target '{target}' is not a column")
    odd = df.where(F.col(target).isNotNull() & ~F.col(target).isin(0, 1))
    levels = [r[0] for r in odd.select(target).distinct().limit(10).collect()]
    if levels:
        raise ValueError(f"target '{target}' must hold 0 and 1 only, found {levels}")
    return df.withColumn(target, F.col(target).cast("int"))


def missing_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column, one pass over the table."""
    columns = columns or df.columns
    nan_possible = set(floating(df))
    gap = {
        c: F.col(c).isNull() | F.isnan(c) if c in nan_possible else F.col(c).isNull()
        for c in columns
    }
    counts = df.agg(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.count_if(g).alias("n_missing"))
        for c, g in gap.items()
    ]).alias("cells"))
    return counts.select(F.inline("cells"))


def with_complement(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Opposite dummy `ynd` and contrast `z` of a binary target."""
    return df.withColumns(
        {"ynd": (1 - F.col(target)).cast("int"), "z": (2 * F.col(target) - 1).cast("int")}
    )


def class_counts(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.groupBy(target).agg(F.count("*").alias("n"))


def levels(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def long_form(df: DataFrame, ids: list[str], columns: list[str],
              name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; the identifying columns repeat in every block."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids, columns, name, value
    )


def attach(df: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    return df.join(other, key, "left")


def keep_members(df: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    return df.join(members.select(key), key, "left_semi")


def fill_gaps(df: DataFrame, values: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Replace only what is missing; observed cells stay as they are."""
    renamed = values.select(key, *[F.col(c).alias(f"{c}__new") for c in columns])
    filled = df.join(renamed, key, "left").withColumns(
        {c: F.coalesce(nan_to_null(F.col(c).cast("double")), f"{c}__new") for c in columns}
    )
    return filled.select(*df.columns)


def top_rows(df: DataFrame, by: str, k: int, tie: str = "id", ascending: bool = False) -> DataFrame:
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(order, F.col(tie)).limit(k)
