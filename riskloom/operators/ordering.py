"""Order-based operators without a single-task window.

Rows are placed in value ranges that hold about equally many rows; positions and running sums
are taken inside a range and completed with the totals of the ranges before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.tables import stored

RANGE = "_range"
BEFORE = (Window.unboundedPreceding, -1)
#: Sampled rows per range. The share of a range then varies by about a seventh; no result depends on it.
POINTS = 50


def range_bounds(df: DataFrame, columns: list[str], parts: int) -> list[list[float]]:
    """Bounds of about equally filled ranges of each column; they set balance, never a result.

    About POINTS rows per range come to the driver, whatever the size of the table.
    """
    infinity = float("inf")
    found: list = [None] * len(columns)
    if parts > 1:
        values = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
        rows = values.count()
        share = POINTS * parts / max(rows, 1)
        sample = (values.sample(share, seed=0) if share < 1 else values).toArrow()
        for i in range(len(columns)):
            points = sample.column(i).drop_null().to_numpy()
            points = points[~np.isnan(points)]
            if len(points):
                found[i] = np.quantile(points, np.arange(1, parts) / parts, method="lower").tolist()
    inner = [sorted({v + 0.0 for v in c or [] if abs(v) < infinity}) or [0.0] for c in found]
    return [[-infinity, *c, infinity] for c in inner]


def with_ranges(df: DataFrame, value: str) -> DataFrame:
    """Add the value range of each row, as many ranges as there are shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        Bucketizer(splits=range_bounds(df, [value], parts)[0], inputCol="_as_double", outputCol=RANGE)
        .transform(df.withColumn("_as_double", F.col(value).cast("double")))
        .drop("_as_double")
        .withColumn(RANGE, F.col(RANGE).cast("int"))
    )


def present(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def runs(
    df: DataFrame, value: str, by: list[str] = (), sums: dict[str, Column] | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """One row per distinct value, with its sums, the sums below it and the totals.

    For every entry `s` of `sums` (default: the row count `n`) the result has `s`, `s_below`
    (over all smaller values of the group) and `s_all`. Missing values are left out.
    """
    sums = sums or {"n": F.lit(1)}
    by = list(by)
    keys = [*by, RANGE]
    # The explicit filter keeps both readers of `cells` alike, so the shuffle behind it is reused.
    ranged = with_ranges(present(df, value), value)
    for c in keys:
        ranged = ranged.where(F.col(c).isNotNull())
    cells = ranged.groupBy(*keys, value).agg(*[F.sum(c).alias(s) for s, c in sums.items()])
    totals = cells.groupBy(*keys).agg(*[F.sum(s).alias(f"{s}_range") for s in sums])
    whole = Window.partitionBy(*by)
    ahead = whole.orderBy(RANGE).rowsBetween(*BEFORE)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"{s}_range").over(ahead), F.lit(0)).alias(f"{s}_offset") for s in sums],
        *[F.sum(f"{s}_range").over(whole).alias(f"{s}_all") for s in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(*BEFORE)
    return cells.join(offsets, keys).select(
        *(keys if keep_range else by),
        value,
        *sums,
        *[
            (F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"{s}_offset")).alias(f"{s}_below")
            for s in sums
        ],
        *[f"{s}_all" for s in sums],
    )


def with_neighbour(
    df: DataFrame, order: str, columns: list[str], by: list[str] = (), ahead: bool = False
) -> DataFrame:
    """Add `prev_c` (or `next_c`) for each column, in the order of a unique value per group.

    A table that already carries the ranges of `order` is not divided again.
    """
    by = list(by)
    keys = [*by, RANGE]
    ranged = df if RANGE in df.columns else with_ranges(df, order)
    packed = F.struct(*columns)
    edge = F.min_by(packed, order) if ahead else F.max_by(packed, order)
    ends = ranged.groupBy(*keys).agg(edge.alias("_edge"))
    step = F.lead if ahead else F.lag
    joined = ranged.join(
        ends.select(
            *keys, step("_edge").over(Window.partitionBy(*by).orderBy(RANGE)).alias("_across")
        ),
        keys,
    )
    near = F.coalesce(step(packed).over(Window.partitionBy(*keys).orderBy(order)), F.col("_across"))
    prefix = "next" if ahead else "prev"
    return (
        joined.withColumn("_near", near)
        .withColumns({f"{prefix}_{c}": F.col("_near")[c] for c in columns})
        .drop("_near", "_across", RANGE)
    )


def sort_keys(df: DataFrame, keys: list[str], tie: str) -> list[Column]:
    """Ascending, missing last; NaN counts as missing. Columns the table lacks are skipped."""
    order = []
    for k in [c for c in keys if c in df.columns and c != tie]:
        numeric = dict(df.dtypes)[k] in ("double", "float")
        order.append((F.when(~F.isnan(k), F.col(k)) if numeric else F.col(k)).asc_nulls_last())
    return [*order, F.col(tie).asc_nulls_last()]


def global_index(df: DataFrame, keys: list[str], tie: str, name: str = "id") -> DataFrame:
    """Dense 0-based position in the order of `keys`; `tie` must be unique per row.

    Sorted ranges are written to the shared folder once, so the position inside a range and the
    offset of the range come from the same stored rows even if executors are lost.
    """
    order = sort_keys(df, keys, tie)
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    placed = stored(ranged, "index").withColumns(
        {
            "_part": F.shiftright("_slot", 33).cast("int"),
            "_place": F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))
            .alias("_offset"),
        )
    )
    # One row per shuffle partition, so the broadcast has a fixed bound.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_slot", "_part", "_place", "_offset")
    )


def quantiles(
    df: DataFrame, value: str, points: list[float], by: list[str] = (), method: str = "linear"
) -> DataFrame:
    """Exact quantiles `q_0, q_1, ...`, one column per point, by linear or nearest rank."""
    by = list(by)
    ranked = runs(df, value, by)
    out = []
    for i, p in enumerate(points):
        at = F.lit(float(p)) * (F.col("n_all") - 1)
        low = F.floor(at + 0.5) if method == "nearest" else F.floor(at)
        high = low if method == "nearest" else F.ceil(at)
        hits = [
            F.max(F.when((F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n")), F.col(value)))
            for k in (low, high)
        ]
        share = F.max(at - F.floor(at)) if method == "linear" else F.lit(0.0)
        out.append((hits[0] + share * (hits[1] - hits[0])).alias(f"q_{i}"))
    return ranked.groupBy(*by).agg(*out)
