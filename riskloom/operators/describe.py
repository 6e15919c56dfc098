"""Descriptive tables per variable and class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import finite_or_null
from riskloom.operators.ordering import quantiles, runs
from riskloom.sources.tables import stored

# Quartiles reported by a description.
QUARTILES = [0.25, 0.5, 0.75]
#: A sketch places a value within 1 / ACCURACY of its rank; a band reaches two more of these to either side.
ACCURACY = 2_000
MARGIN = 3 / ACCURACY


def moments(
    df: DataFrame, columns: list[str], by: list[str] = (), shape: bool = True
) -> DataFrame:
    """Count, missing count, mean, sd, variance, extremes and shape (population form).

    One aggregation over the wide table, turned into one row per group and variable: rows are not
    multiplied by the number of variables, only the finished group rows are.
    """
    by = list(by)
    finite = df.select(*by, *[finite_or_null(c).alias(c) for c in columns if c not in by])

    def measures(c: str) -> dict[str, Column]:
        x, n = F.col(c), F.count(c)
        variance = F.when(n > 1, F.var_pop(x) * n / F.when(n > 1, n - 1))
        named = {
            "n": n, "n_missing": F.count("*") - n, "mean": F.avg(x), "std": F.sqrt(variance),
            "variance": variance, "min": F.min(x), "max": F.max(x),
        }
        if shape:
            spread = F.var_pop(x) > 0
            named["skewness"] = F.when(spread, F.skewness(x))
            named["kurtosis"] = F.when(spread, F.kurtosis(x))
        return named

    cells = [
        F.struct(F.lit(c).alias("variable"), *[m.alias(n) for n, m in measures(c).items()])
        for c in columns
    ]
    return finite.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.inline("cells"))


def group_summary(df: DataFrame, columns: list[str], by: list[str] = ("yd",)) -> DataFrame:
    return moments(df, columns, by, shape=False).select(*by, "variable", "n", "mean", "std")


def shape(
    df: DataFrame, columns: list[str], by: list[str] = ("yd",), pearson: bool = False
) -> DataFrame:
    """Skewness and kurtosis per group; kurtosis is excess unless `pearson`."""
    kurtosis = F.col("kurtosis") + (3 if pearson else 0)
    return moments(df, columns, by).select(
        *by, "variable", kurtosis.alias("kurtosis"), "skewness"
    )


def value_quantiles(
    df: DataFrame, columns: list[str], points: list[float], by: list[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles `q_0, q_1, ...` per group and variable, by linear or nearest rank.

    Sketches bound the value of every rank asked for. One wide pass counts the rows below these bands
    and one keeps the rows inside them, some 6 / ACCURACY of the rows for each quantile; a group of at
    most ACCURACY rows is kept whole. Only these few rows are ranked, so the table is never made long.
    A group with a missing key or without values has no row.
    """
    groups, by = list(by), list(by) or ["_whole"]
    tidy = df.select(*groups, *[finite_or_null(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    tidy = tidy.dropna(subset=groups) if groups else tidy.withColumn("_whole", F.lit(0))
    cells = [(i, j) for i in range(len(columns)) for j in range(len(points))]

    def reach(x: str, share: float, edge: Column) -> Column:
        wide = F.count(x) > ACCURACY
        return F.when(wide, F.percentile_approx(x, share, ACCURACY)).otherwise(edge) if 0 < share < 1 else edge

    bands = stored(tidy.groupBy(*by).agg(
        *[F.count(f"_x{i}").alias(f"_n{i}") for i in range(len(columns))],
        *[reach(f"_x{i}", points[j] - MARGIN, F.min(f"_x{i}")).alias(f"_low{i}_{j}") for i, j in cells],
        *[reach(f"_x{i}", points[j] + MARGIN, F.max(f"_x{i}")).alias(f"_high{i}_{j}") for i, j in cells],
    ), "bands")
    near = tidy.join(bands, by)
    below = near.groupBy(*by).agg(*[F.count_if(F.col(f"_x{i}") < F.col(f"_low{i}_{j}")).alias(f"_b{i}_{j}")
                                    for i, j in cells])
    below = below.join(bands, by).select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"_n{i}").alias("_rows"),
                 F.col(f"_b{i}_{j}").alias("_below")) for i, j in cells])))
    inside = [F.when(F.col(f"_x{i}").between(F.col(f"_low{i}_{j}"), F.col(f"_high{i}_{j}")),
                     F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"_x{i}").alias("value")))
              for i, j in cells]
    kept = near.select(*by, F.inline(F.array_compact(F.array(*inside))))
    kept = stored(kept.groupBy(*by, "_i", "_j", "value").agg(F.count("*").alias("_times")), "kept")
    keys = [*by, "_i", "_j"]
    ranked = runs(kept, "value", keys, {"n": F.col("_times")}).join(below, keys)
    at = F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("_j") + 1) * (F.col("_rows") - 1)
    low = F.floor(at + 0.5) if method == "nearest" else F.floor(at)
    high = low if method == "nearest" else F.ceil(at)
    start = F.col("_below") + F.col("n_below")
    hit = [F.max(F.when((start <= k) & (k < start + F.col("n")), F.col("value"))) for k in (low, high)]
    share = F.max(at - F.floor(at)) if method == "linear" else F.lit(0.0)
    found = ranked.groupBy(*keys).agg(hit[0].alias("_a"), hit[1].alias("_b"), share.alias("_share"))
    lost = F.col("_a").isNull() | F.col("_b").isNull()
    value = F.when(lost, F.raise_error(F.lit("a quantile lies outside its band")).cast("double")).otherwise(
        F.col("_a") + F.col("_share") * (F.col("_b") - F.col("_a")))
    names = F.array(*[F.lit(c) for c in columns])
    return found.withColumn("_value", value).groupBy(*by, "_i").agg(
        *[F.max(F.when(F.col("_j") == j, F.col("_value"))).alias(f"q_{j}") for j in range(len(points))]
    ).select(*groups, F.element_at(names, F.col("_i") + 1).alias("variable"),
             *[f"q_{j}" for j in range(len(points))])


def describe(
    df: DataFrame, columns: list[str], by: list[str] = (), nearest: bool = False
) -> DataFrame:
    """Count, missing, mean, sd, min, quartiles, max; quartiles linear or by nearest rank."""
    by = list(by)
    cuts = value_quantiles(df, columns, QUARTILES, by, "nearest" if nearest else "linear")
    return moments(df, columns, by, shape=False).join(cuts, [*by, "variable"], "left").select(
        *by, "variable", "n", "n_missing", "mean", "std", "min",
        F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"), "max",
    )


def value_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.min(finite_or_null(c)).alias(f"lo_{c}") for c in columns],
        *[F.max(finite_or_null(c)).alias(f"hi_{c}") for c in columns],
    ).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns if row[f"lo_{c}"] is not None}


def histogram(
    df: DataFrame, columns: list[str], by: list[str] = ("yd",), bins: int = 30
) -> DataFrame:
    """Equal-width bin counts per variable and class, with each class's share of its rows."""
    cells = []
    for c, (low, high) in value_bounds(df, columns).items():
        width = (high - low) / bins or 1.0
        x = finite_or_null(c)
        place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(
            F.when(
                x.isNotNull(),
                F.struct(F.lit(c).alias("variable"), place.alias("bin"),
                         (F.lit(low) + place * F.lit(width)).alias("left")),
            )
        )
    if not cells:
        cells = [F.lit(None).cast("struct<variable:string,bin:int,left:double>")]
    counts = (
        df.select(*by, F.explode(F.array_compact(F.array(*cells))).alias("cell"))
        .groupBy(*by, "cell.variable", "cell.bin", "cell.left")
        .agg(F.count("*").alias("n"))
    )
    whole = counts.groupBy(*by, "variable").agg(F.sum("n").alias("_all"))
    return counts.join(whole, [*by, "variable"]).select(
        *by, "variable", "bin", "left", "n", (F.col("n") / F.col("_all")).alias("share")
    )


def box_fences(df: DataFrame, columns: list[str], by: list[str] = ("yd",), reach: float = 1.5) -> DataFrame:
    cuts = value_quantiles(df, columns, QUARTILES, by)
    spread = reach * (F.col("q_2") - F.col("q_0"))
    return cuts.select(
        *by, "variable", F.col("q_0").alias("q1"), F.col("q_1").alias("median"),
        F.col("q_2").alias("q3"), (F.col("q_0") - spread).alias("lower_fence"),
        (F.col("q_2") + spread).alias("upper_fence"),
    )


def beside_fences(
    df: DataFrame, columns: list[str], by: list[str], reach: float, ids: list[str] = ()
) -> tuple[DataFrame, list[Column]]:
    """The wide table with the box of each column beside it, and whether each value lies inside its fences."""
    fences = box_fences(df, columns, by, reach)
    boxes = fences.groupBy(*by).agg(*[
        F.max(F.when(F.col("variable") == c, F.struct("q1", "median", "q3", "lower_fence", "upper_fence")))
        .alias(f"_box{i}") for i, c in enumerate(columns)])
    values = [finite_or_null(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    placed = df.select(*ids, *by, *values).join(boxes, by)
    return placed, [F.col(f"_x{i}").between(F.col(f"_box{i}.lower_fence"), F.col(f"_box{i}.upper_fence"))
                    for i in range(len(columns))]


def box_statistics(
    df: DataFrame, columns: list[str], by: list[str] = ("yd",), reach: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences) and the number of outliers."""
    by = list(by)
    placed, inside = beside_fences(df, columns, by, reach)
    boxes = [F.struct(
        F.lit(c).alias("variable"), F.first(f"_box{i}").alias("box"),
        F.min(F.when(inside[i], F.col(f"_x{i}"))).alias("lower_whisker"),
        F.max(F.when(inside[i], F.col(f"_x{i}"))).alias("upper_whisker"),
        F.count_if(~inside[i]).alias("n_outliers")) for i, c in enumerate(columns)]
    return placed.groupBy(*by).agg(F.array(*boxes).alias("_boxes")).select(*by, F.inline("_boxes")).where(
        "box IS NOT NULL"
    ).select(*by, "variable", "box.q1", "box.median", "box.q3", "lower_whisker", "upper_whisker", "n_outliers")


def box_outliers(
    df: DataFrame, columns: list[str], by: list[str] = ("yd",), reach: float = 1.5, key: str = "id"
) -> DataFrame:
    """The rows outside the fences."""
    by = list(by)
    placed, inside = beside_fences(df, columns, by, reach, [key])
    far = [F.when(~inside[i], F.struct(F.lit(c).alias("variable"), F.col(f"_x{i}").alias("value")))
           for i, c in enumerate(columns)]
    return placed.select(key, *by, F.inline(F.array_compact(F.array(*far))))


def density(
    df: DataFrame, value: str, by: list[str] = (), low: float = -4.0, high: float = 4.0,
    points: int = 81, kernel: str = "gaussian",
) -> DataFrame:
    """Kernel density per group on a fixed grid.

    Bandwidth: Scott's factor n^(-1/5) times the sample sd (Gaussian), or
    0.9 min(sd, iqr / 1.349) n^(-1/5) (Epanechnikov). Each row adds to the grid points its kernel
    reaches; sums are combined before the shuffle, which carries one row per group and point.
    """
    groups, by = list(by), list(by) or ["_all"]
    if not groups:
        df = df.withColumn("_all", F.lit(1))
    clean = df.select(*by, finite_or_null(value).alias("x")).where(F.col("x").isNotNull())
    spread = clean.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd"))
    if kernel == "epanechnikov":
        iqr = quantiles(clean, "x", [0.25, 0.75], by)
        spread = spread.join(iqr, by)
        scale = F.least("sd", (F.col("q_1") - F.col("q_0")) / 1.349) * 0.9
        reach = math.sqrt(5)
    else:
        scale = F.col("sd")
        reach = 38.7  # exp(-z * z / 2) is exactly zero in double precision beyond this
    widths = spread.select(*by, "n", (scale * F.pow("n", F.lit(-0.2))).alias("h")).where("h > 0")
    step = (high - low) / (points - 1)
    # One row per group (class and model names).
    rows = clean.join(F.broadcast(widths), by)
    edge = lambda side: (F.col("x") + side * reach * F.col("h") - low) / step
    first = F.greatest(F.lit(0), F.ceil(edge(-1)).cast("int"))
    last = F.least(F.lit(points - 1), F.floor(edge(1)).cast("int"))
    hit = rows.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    grid = F.lit(low) + F.col("point") * F.lit(step)
    z = (grid - F.col("x")) / F.col("h")
    if kernel == "epanechnikov":
        weight = F.greatest(F.lit(0.0), 0.75 * (1 - z * z / 5) / math.sqrt(5))
    else:
        weight = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    sums = hit.groupBy(*by, "point").agg(
        (F.sum(weight) / F.first(F.col("n") * F.col("h"))).alias("density")
    )
    return sums.select(*groups, "point", grid.alias("x"), "density")
