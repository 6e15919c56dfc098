"""Reproducible samples: systematic, random, stratified and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ordering import BEFORE, global_index
from riskloom.sources.tables import stored

SEED = 42
CELLS = 1 << 16


def systematic_split(
    df: DataFrame, keys: list[str] = ("yd", "reta"), tie: str = "row_key", every: int = 2
) -> DataFrame:
    """Position `id` in sort order; `dumVE` is 1 on every second (k-th) row, starting with the first."""
    return global_index(df, list(keys), tie, "id").withColumn(
        "dumVE", (F.col("id") % every == 0).cast("byte")
    )


def hash_number(key: str, seed: int) -> Column:
    """52 bits of the MD5 of key and seed, as an exact whole number."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def hash_segments(
    df: DataFrame, shares: list[float], by: list[str] = (), key: str = "id",
    seed: int = SEED, name: str = "segment", rounding: str = "round",
    shared_out: float | None = None,
) -> DataFrame:
    """Cut each group, in hash order, at the cumulative shares; sizes are exact.

    `shared_out` instead makes one cut: ceil(share * n) rows of all, dealt to the groups by `first_sizes`.

    Group, hash and key are stored once and narrow, which evaluates the table once. Only counts per
    hash cell are shuffled: the rows at the cuts are found inside their own cells, and every other row
    is placed by comparing its hash with those few cut rows, in one more pass that shuffles nothing.
    """
    by = list(by)
    hashed = df.withColumn("_h", hash_number(key, seed)).withColumn(
        "_cell", F.shiftright("_h", 52 - 16).cast("int")
    )
    group = F.struct(*by) if by else F.lit(0)
    narrow = stored(hashed.select(group.alias("_g"), "_h", "_cell", F.col(key).alias("_k")), "hashes")
    counts = narrow.groupBy("_g", "_cell").agg(F.count("*").alias("_n"))
    cells = counts.select(
        "_g", "_cell", "_n",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy("_g").orderBy("_cell").rowsBetween(*BEFORE)), F.lit(0)
        ).alias("_below"),
        F.sum("_n").over(Window.partitionBy("_g")).alias("_all"),
    )
    size = {"round": F.round, "ceil": F.ceil, "floor": F.floor}[rounding]
    targets = F.array(*[size(F.lit(s) * F.col("_all")).cast("bigint") for s in shares])
    if shared_out is not None:
        cells = cells.join(first_sizes(counts, shared_out), "_g")
        targets = F.array("_first")
    # A target of zero rows lies before every row of its group, in its first cell.
    cut_cells = cells.withColumn("_targets", targets).withColumn(
        "_targets",
        F.filter("_targets", lambda t: ((F.col("_below") < t) & (t <= F.col("_below") + F.col("_n")))
                 | ((t == 0) & (F.col("_below") == 0))),
    ).where(F.size("_targets") > 0)
    # At most as many cut cells and cut rows as groups times shares. Both are stored, so Spark knows
    # their sizes and sends them to every task only if they are small.
    cut_cells = stored(cut_cells.select("_g", "_cell", "_below", "_targets"), "cut-cells")
    empty = (
        cut_cells.select("_g", F.size(F.filter("_targets", lambda t: t == 0)).alias("_w"))
        .where(F.col("_w") > 0)
        .select("_g", F.lit(-1).cast("bigint").alias("_h"), F.lit(None).alias("_k"), "_w")
    )
    position = F.row_number().over(Window.partitionBy("_g", "_cell").orderBy("_h", "_k"))
    # A cut cell holds one 65536th of the hash space, whatever the groups look like.
    cut_rows = stored(
        narrow.join(cut_cells, ["_g", "_cell"])
        .withColumn("_at", position + F.col("_below"))
        .withColumn("_w", F.size(F.filter("_targets", lambda t: t == F.col("_at"))))
        .where(F.col("_w") > 0)
        .select("_g", "_h", "_k", "_w")
        .unionByName(empty)
        .groupBy("_g")
        .agg(F.collect_list(F.struct(F.struct("_h", "_k").alias("at"), "_w")).alias("_cuts")),
        "cut-rows",
    )
    placed = hashed.withColumn("_g", group).join(cut_rows, "_g", "left")
    me = F.struct(F.col("_h").alias("_h"), F.col(key).alias("_k"))
    passed = F.aggregate(
        F.col("_cuts"), F.lit(0), lambda s, c: s + F.when(c["at"] < me, c["_w"]).otherwise(0)
    )
    return placed.withColumn(name, F.coalesce(passed, F.lit(0))).drop("_h", "_cell", "_g", "_cuts")


def random_split(
    df: DataFrame, test_share: float = 0.25, stratify: str | None = None, key: str = "id",
    seed: int = SEED, name: str = "in_test",
) -> DataFrame:
    """Test flag with exact sizes: ceil(share * n) overall, or shared out over the classes."""
    if not stratify:
        cut = hash_segments(df, [test_share], [], key, seed, "_part_no", "ceil")
    else:
        cut = hash_segments(df, [], [stratify], key, seed, "_part_no", shared_out=test_share)
    return cut.withColumn(name, (F.col("_part_no") == 0).cast("int")).drop("_part_no")


def first_sizes(counts: DataFrame, share: float) -> DataFrame:
    """(_g, _first): the group's part of ceil(share * n) rows; what stays behind is dealt by largest remainder.

    The groups are levels of a class; one task ranks a row for each.
    """
    levels, ranked = Window.partitionBy(), Window.orderBy("_short", F.col("_g").cast("string"))
    totals = counts.groupBy("_g").agg(F.sum("_n").alias("_size"))
    rest = totals.withColumn("_rows", F.sum("_size").over(levels)).withColumn(
        "_rest", F.col("_rows") - F.ceil(F.lit(share) * F.col("_rows")))
    ideal = (F.col("_rest") * F.col("_size")).cast("double") / F.col("_rows")
    kept = rest.withColumn("_keep", F.floor(ideal)).withColumn("_short", F.col("_keep") - ideal)
    spare = F.col("_rest") - F.sum("_keep").over(levels)
    more = (F.row_number().over(ranked) <= spare).cast("bigint")
    return kept.select("_g", (F.col("_size") - F.col("_keep") - more).alias("_first"))


def stratified_folds(
    df: DataFrame, k: int = 5, stratify: str = "yd", key: str = "id", seed: int = SEED,
    name: str = "fold",
) -> DataFrame:
    """Fold numbers 0..k-1 with each class spread evenly."""
    return hash_segments(df, [i / k for i in range(1, k)], [stratify], key, seed, name)
