"""Score evaluation: ROC, AUC, concordance, confusion, cost and cutoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ordering import present, runs, with_neighbour
from riskloom.sources.tables import stored

INFINITY = float("inf")


def score_runs(
    df: DataFrame, score: str, target: str, by: list[str], keep_range: bool = False
) -> DataFrame:
    """Positives and negatives per distinct score, below it and in all."""
    known = df.where(F.col(target).isNotNull())
    positive = F.when(F.col(target) == 1, 1).otherwise(0)
    return runs(known, score, by, {"pos": positive, "neg": 1 - positive}, keep_range)


def concordance(df: DataFrame, score: str, target: str = "yd", by: list[str] = ()) -> DataFrame:
    """Concordant, discordant and tied 0-1 pairs, percent concordant and AUC.

    Pairs are counted from sorted class counts, never formed. AUC is NULL with one class only.
    """
    by = list(by)
    wide = "decimal(38,0)"  # pair counts pass 64 bits on large tables
    pos, neg = F.col("pos").cast("decimal(19,0)"), F.col("neg").cast("decimal(19,0)")
    counted = score_runs(df, score, target, by).groupBy(*by).agg(
        F.sum((pos * F.col("neg_below").cast("decimal(19,0)")).cast(wide)).alias("c"),
        F.sum((pos * neg).cast(wide)).alias("t"),
        F.max("pos_all").alias("p"),
        F.max("neg_all").alias("n"),
    )
    pairs = F.col("p").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    total = pairs.cast("double")
    return counted.select(
        *by,
        F.col("c").alias("concordant"),
        (pairs.cast(wide) - F.col("c") - F.col("t")).cast(wide).alias("discordant"),
        F.col("t").alias("ties"),
        F.coalesce(F.try_divide(100 * c, total), F.lit(0.0)).alias("percent_concordant"),
        F.try_divide(c + t / 2, total).alias("auc"),
    )


def auc(df: DataFrame, score: str, target: str = "yd", by: list[str] = ()) -> DataFrame:
    return concordance(df, score, target, by).select(*by, "auc")


def concordance_check(df: DataFrame, score: str, target: str = "yd") -> DataFrame:
    """Counted concordance against the area under the curve; equal when no pair is tied."""
    table = concordance(df, score, target)
    return table.select(
        "percent_concordant", (100 * F.col("auc")).alias("auc_percent"), "ties",
        ((F.col("ties") == 0) | F.col("auc").isNull()).alias("no_ties"),
        (F.abs(F.col("percent_concordant") - 100 * F.col("auc")) < 1e-9).alias("equal"),
    )


def roc_curve(
    df: DataFrame, score: str, target: str = "yd", by: list[str] = (), prune: bool = True
) -> DataFrame:
    """ROC points by falling threshold, from (0, 0); points inside a straight stretch are dropped."""
    by = list(by)
    points = score_runs(df, score, target, by, prune).withColumn("threshold", F.col(score).cast("double"))
    if prune:
        points = with_neighbour(points, "threshold", ["pos", "neg"], by)
        corner = (
            F.col("prev_pos").isNull()
            | (F.col("pos") != F.col("prev_pos"))
            | (F.col("neg") != F.col("prev_neg"))
            | ((F.col("pos_all") == F.col("pos_below") + F.col("pos"))
               & (F.col("neg_all") == F.col("neg_below") + F.col("neg")))
        )
        points = points.where(corner)
    curve = points.select(
        *by,
        "threshold",
        F.try_divide(F.col("neg_all") - F.col("neg_below"), F.col("neg_all")).alias("fpr"),
        F.try_divide(F.col("pos_all") - F.col("pos_below"), F.col("pos_all")).alias("tpr"),
    )
    known = present(df.where(F.col(target).isNotNull()), score)
    start = known.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 0").select(
        *by, F.lit(INFINITY).alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
    )
    return start.unionByName(curve)


def trapezoid_area(curve: DataFrame, by: list[str] = (), order: str = "threshold") -> DataFrame:
    """Area under (fpr, tpr) points taken by falling `order`."""
    by = list(by)
    # Four passes follow; each would repeat all steps behind the curve.
    points = stored(curve.select(*by, "fpr", "tpr", (-F.col(order)).alias("_o")), "curve")
    stepped = with_neighbour(points, "_o", ["fpr", "tpr"], by)
    strip = (F.col("fpr") - F.col("prev_fpr")) * (F.col("tpr") + F.col("prev_tpr")) / 2
    return stepped.groupBy(*by).agg(F.sum(strip).alias("area"))


def confusion(
    df: DataFrame, score: str, threshold: float, target: str = "yd",
    cost_fn: float = 10.0, cost_fp: float = 1.0,
) -> DataFrame:
    """Counts at one cutoff and the average misclassification cost; empty cells stay 0."""
    known = present(df.where(F.col(target).isNotNull()), score)
    said, was = F.col(score) >= F.lit(float(threshold)), F.col(target) == 1
    counts = known.agg(
        F.count_if(~said & ~was).alias("tn"), F.count_if(said & ~was).alias("fp"),
        F.count_if(~said & was).alias("fn"), F.count_if(said & was).alias("tp"),
        F.count("*").alias("n"),
    )
    loss = F.lit(float(cost_fn)) * F.col("fn") + F.lit(float(cost_fp)) * F.col("fp")
    return counts.withColumn("cost", F.try_divide(loss, F.col("n")))


def theoretical_cutoff(cost_fn: float = 10.0, cost_fp: float = 1.0) -> float:
    return cost_fp / (cost_fn + cost_fp)


def cost_curve(
    df: DataFrame, score: str, target: str = "yd", cost_fn: float = 10.0, cost_fp: float = 1.0,
    steps: int = 200,
) -> DataFrame:
    """Average cost at the cutoffs i / steps, i = 1 .. steps - 1.

    Each row is counted once, at the highest cutoff it reaches; running sums over the at most
    `steps` counts give every cutoff.
    """
    known = present(df.where(F.col(target).isNotNull()), score)
    held = F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col(score).cast("double")))
    guess = F.floor(held * steps)
    reached = (
        F.when(F.col(score) < guess / steps, guess - 1)
        .when(F.col(score) >= (guess + 1) / steps, guess + 1)
        .otherwise(guess)
    )
    level = F.greatest(F.lit(0), F.least(F.lit(steps - 1), reached)).cast("int")
    was = F.col(target) == 1
    counts = known.groupBy(level.alias("i")).agg(
        F.count_if(was).alias("pos"), F.count_if(~was).alias("neg")
    )
    grid = df.sparkSession.range(0, steps, 1, 1).select(F.col("id").cast("int").alias("i"))
    filled = grid.join(counts, "i", "left").fillna(0, ["pos", "neg"])
    order = Window.orderBy("i")  # `steps` rows
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    missed = F.coalesce(F.sum("pos").over(below), F.lit(0))
    refused = F.sum("neg").over(onward)
    n = F.sum(F.col("pos") + F.col("neg")).over(whole)
    loss = F.lit(float(cost_fn)) * missed + F.lit(float(cost_fp)) * refused
    return (
        filled.select("i", F.try_divide(loss, n).alias("cost"))
        .where("i >= 1")
        .select((F.col("i") / steps).alias("thr"), "cost")
    )


def empirical_cutoff(
    df: DataFrame, score: str, target: str = "yd", cost_fn: float = 10.0, cost_fp: float = 1.0,
    steps: int = 200,
) -> DataFrame:
    """Cheapest cutoff (mean of tied ones), its cost, and the difference to the theoretical one."""
    t_star = theoretical_cutoff(cost_fn, cost_fp)
    at_star = confusion(df, score, t_star, target, cost_fn, cost_fp).select(
        F.lit(1).alias("k"), F.col("cost").alias("cost_star")
    )
    curve = cost_curve(df, score, target, cost_fn, cost_fp, steps)
    lowest = curve.withColumn(
        "low", F.min("cost").over(Window.partitionBy(F.lit(1)))  # `steps` rows
    ).where(F.col("cost") == F.col("low"))
    best = lowest.agg(
        F.lit(1).alias("k"), F.avg("thr").alias("t_emp"), F.min("low").alias("cost_emp"),
        F.count("*").alias("n_tied"),
    )
    return best.join(at_star, "k").select(
        F.lit(t_star).alias("t_star"), "cost_star", "t_emp", "cost_emp", "n_tied",
        (F.col("cost_emp") - F.col("cost_star")).alias("cost_change"),
    )


def cheapest_cutoffs(curve: DataFrame, k: int = 5) -> DataFrame:
    return curve.orderBy(F.col("cost").asc_nulls_last(), "thr").limit(k)
