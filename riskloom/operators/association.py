"""Correlations and regression lines between pairs of variables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.tails import student_p
from riskloom.operators.frame import finite_rows, finite_values
from riskloom.operators.hypothesis import equal_means, point_biserial


@dataclass(frozen=True)
class Pair:
    """Moments of two columns over the rows where both are present."""

    n: int
    mean: tuple[float, float]
    spread: tuple[float, float]  # centred sums of squares
    cross: float

    def varies(self, side: int) -> bool:
        """False for a constant, up to the rounding of its mean."""
        return self.n > 0 and self.spread[side] > 1e-26 * self.n * self.mean[side] ** 2

    @property
    def r(self) -> float | None:
        """Pearson correlation; None when either side is constant."""
        if not (self.varies(0) and self.varies(1)):
            return None
        return self.cross / math.sqrt(self.spread[0] * self.spread[1])


def pair_moments(
    df: DataFrame, columns: list[str], complete: bool = False
) -> dict[tuple[str, str], Pair]:
    """All pairs from one pass over the rows; any number of columns, p * p numbers to the driver.

    Every task sums, for each pair, the rows that have both cells: their number, both sums, the first
    sum of squares and the cross products. Values are centred at the column means first.
    """
    finite = finite_values(df.select(*columns), columns)
    if complete:
        finite = finite.na.drop()
    size = len(columns)
    means = finite.agg(*[F.avg(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([m or 0.0 for m in means])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, square, cross = np.zeros((4, size, size))
        for batch in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            x = x - centre
            has = ~np.isnan(x)
            x, has = np.where(has, x, 0.0), has.astype(float)
            n += has.T @ has
            first += x.T @ has
            square += (x * x).T @ has
            cross += x.T @ x
        i, j = np.indices((size, size)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n.ravel().astype(np.int64)),
             pa.array(first.ravel()), pa.array(square.ravel()), pa.array(cross.ravel())],
            ["i", "j", "n", "first", "square", "cross"])

    rows = (
        finite.mapInArrow(sums, "i int, j int, n long, first double, square double, cross double")
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "first", "square", "cross")])
        .collect()
    )
    found = {(r["i"], r["j"]): r for r in rows}
    out = {}
    for i, j in [*combinations(range(size), 2), *[(i, i) for i in range(size)]]:
        a, b = found.get((i, j)), found.get((j, i))
        n = a["n"] if a else 0
        if not n:
            out[columns[i], columns[j]] = Pair(0, (0.0, 0.0), (0.0, 0.0), 0.0)
            continue
        out[columns[i], columns[j]] = Pair(
            n, tuple(r["first"] / n + float(centre[k]) for r, k in ((a, i), (b, j))),
            tuple(max(0.0, r["square"] - r["first"] ** 2 / n) for r in (a, b)),
            a["cross"] - a["first"] * b["first"] / n,
        )
    return out


def correlation_pairs(df: DataFrame, columns: list[str], complete: bool = False) -> DataFrame:
    """r of every pair a < b in column order; pairwise complete rows, or rows complete in all."""
    table = [
        (a, b, p.r, p.n) for (a, b), p in pair_moments(df, columns, complete).items() if a != b
    ]
    return df.sparkSession.createDataFrame(table, "var1 string, var2 string, r double, n bigint")


def correlation_matrix(df: DataFrame, columns: list[str], complete: bool = True) -> DataFrame:
    """One row per variable, one column per variable."""
    found = pair_moments(df, columns, complete)
    table = [
        (a, *[(found.get((a, b)) or found[b, a]).r for b in columns]) for a in columns
    ]
    schema = "variable string, " + ", ".join(f"`{c}` double" for c in columns)
    return df.sparkSession.createDataFrame(table, schema)


def lower_triangle(df: DataFrame, columns: list[str], complete: bool = True) -> DataFrame:
    """|r| below the diagonal: var1 comes after var2 in column order."""
    return correlation_pairs(df, columns, complete).select(
        F.col("var2").alias("var1"), F.col("var1").alias("var2"), F.abs("r").alias("abs_r")
    )


def strong_pairs(df: DataFrame, columns: list[str], cut: float = 0.8) -> DataFrame:
    return (
        correlation_pairs(df, columns)
        .where(F.abs("r") > cut)
        .orderBy(F.abs("r").desc(), "var1", "var2")
    )


def strong_columns(df: DataFrame, columns: list[str], cut: float = 0.8) -> DataFrame:
    return (
        strong_pairs(df, columns, cut)
        .select(F.explode(F.array("var1", "var2")).alias("variable"))
        .distinct()
    )


def pair_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Regression line of var2 on var1 for every pair."""
    table = []
    for (a, b), p in pair_moments(df, columns).items():
        if a != b:
            slope = p.cross / p.spread[0] if p.varies(0) else None
            level = None if slope is None else p.mean[1] - slope * p.mean[0]
            table.append((a, b, slope, level, p.n))
    return df.sparkSession.createDataFrame(
        table, "var1 string, var2 string, slope double, intercept double, n bigint"
    )


def equivalence_check(df: DataFrame, column: str, target: str = "yd") -> DataFrame:
    """One association seen four ways; pooled t, correlation t and both slope t agree in size."""
    clean = finite_rows(df, [column, target])
    r_row = point_biserial(clean, [column], target).select(F.lit("correlation").alias("test"), "t_stat", "p_value")
    tests = [
        equal_means(clean, [column], target, cols).select(
            F.lit(name).alias("test"), F.col("t_statistic").alias("t_stat"), "p_value"
        )
        for name, cols in (("pooled", [column]), ("welch", []))
    ]
    x, y = F.col(column).cast("double"), F.col(target).cast("double")
    slopes = []
    for name, a, b in (("x_on_y", y, x), ("y_on_x", x, y)):
        slope = F.try_divide(F.covar_pop(a, b), F.var_pop(a))
        rest = F.var_pop(b) - slope * F.covar_pop(a, b)
        error = F.sqrt(F.try_divide(rest, (F.count("*") - 2) * F.var_pop(a)))
        slopes.append(
            clean.agg(F.try_divide(slope, error).alias("t_stat"),
                      (F.count("*") - 2).cast("double").alias("df"))
            .withColumn("p_value", student_p("t_stat", "df"))
            .select(F.lit(name).alias("test"), "t_stat", "p_value")
        )
    out = tests[0].unionByName(tests[1]).unionByName(r_row)
    return out.unionByName(slopes[0]).unionByName(slopes[1])
