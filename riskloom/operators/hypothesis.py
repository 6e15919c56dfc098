"""Tests of normality, equal variances and equal means between two classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import finite_or_null, polynomial, with_normal_score
from riskloom.functions.tails import chi2_p, normal_upper_p, student_p
from riskloom.operators.describe import moments, value_quantiles
from riskloom.operators.frame import long_form
from riskloom.operators.ordering import runs

ALPHA = 0.05
CHUNK = 1 << 16

# Published polynomials for the Shapiro-Wilk weights and p-value (Royston 1995).
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_LIMIT = [-2.273, 0.459]
SMALL_MEAN = [0.544, -0.39978, 0.025054, -0.0006714]
SMALL_SPREAD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_SPREAD = [-0.4803, -0.082676, 0.0030302]
RELIABLE_UP_TO = 5000


def class_moments(df: DataFrame, columns: list[str], group: str = "yd") -> DataFrame:
    """One row per variable: n, mean and variance of class 0 and class 1."""
    table = moments(df.where(F.col(group).isin(0, 1)), columns, [group], shape=False)
    pick = lambda name, g: F.max(F.when(F.col(group) == g, F.col(name)))
    return table.groupBy("variable").agg(
        *[
            (F.coalesce(pick(name, g), F.lit(0)) if name == "n" else pick(name, g)).alias(f"{name}{g}")
            for name in ("n", "mean", "variance")
            for g in (0, 1)
        ]
    )


def ordered_positions(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Every row's 1-based rank in its group; long runs of one value are spread over tasks."""
    ranked = runs(df, value, by).withColumnsRenamed({"n": "_run", "n_all": "n"})
    start, stop = F.col("n_below") + 1, F.col("n_below") + F.col("_run")
    short = ranked.where(F.col("_run") <= CHUNK).withColumn("rank", F.explode(F.sequence(start, stop)))
    starts = F.explode(F.sequence(start, stop, F.lit(CHUNK)))
    long = (
        ranked.where(F.col("_run") > CHUNK)
        .withColumn("_from", starts)
        .withColumn("_to", F.least(F.col("_from") + (CHUNK - 1), stop))
        .repartition(F.col("_from"), *by)
        .withColumn("rank", F.explode(F.sequence("_from", "_to")))
    )
    keep = [*by, value, "n", "rank"]
    return short.select(*keep).union(long.select(*keep))


def shapiro_wilk(df: DataFrame, columns: list[str], by: list[str] = ("yd",)) -> DataFrame:
    """W and p per group and variable; fewer than 3 values give NULL.

    The p-value approximation is published for up to 5000 values; `p_reliable` says so.
    """
    by = list(by)
    keys = [*by, "variable"]
    tidy = df.withColumns({c: finite_or_null(c) for c in columns})
    # Centring keeps the sums small; the weights add up to zero.
    centres = tidy.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = tidy.withColumns({c: F.col(c) - F.lit(centres[c] or 0.0) for c in columns})
    values = long_form(centred, by, columns).where(F.col("value").isNotNull())
    position = (F.col("rank") - 0.375) / (F.col("n") + 0.25)
    nth = lambda k: F.max(F.when(F.col("rank") == k, F.col("value")))
    sums = (
        with_normal_score(ordered_positions(values, "value", keys), position, "m")
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.sum(F.col("m") * F.col("m")).alias("mm"),
            F.sum(F.col("m") * F.col("value")).alias("mx"),
            (F.var_pop("value") * F.count("*")).alias("xx"),
            nth(F.lit(1)).alias("x1"), nth(F.lit(2)).alias("x2"),
            nth(F.col("n") - 1).alias("y2"), nth(F.col("n")).alias("y1"),
            F.max(F.when(F.col("rank") == F.col("n"), F.col("m"))).alias("m1"),
            F.max(F.when(F.col("rank") == F.col("n") - 1, F.col("m"))).alias("m2"),
        )
    )
    n = F.col("n").cast("double")
    root = 1 / F.sqrt(n)
    norm = F.sqrt("mm")
    a1 = F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(
        polynomial(LAST_WEIGHT, root) + F.col("m1") / norm
    )
    a2 = polynomial(NEXT_WEIGHT, root) + F.col("m2") / norm
    with_a = sums.withColumns({"a1": a1, "a2": a2})
    span1, span2 = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    m1, m2, w1, w2 = (F.col(c) for c in ("m1", "m2", "a1", "a2"))
    rest_one = F.sqrt(F.try_divide(F.col("mm") - 2 * m1 * m1, 1 - 2 * w1 * w1))
    rest_two = F.sqrt(
        F.try_divide(F.col("mm") - 2 * m1 * m1 - 2 * m2 * m2, 1 - 2 * w1 * w1 - 2 * w2 * w2)
    )
    inner_one = F.try_divide(F.col("mx") - m1 * span1, rest_one)
    inner_two = F.try_divide(F.col("mx") - m1 * span1 - m2 * span2, rest_two)
    weighted = (
        F.when(F.col("n") == 3, w1 * span1)
        .when(F.col("n") <= 5, w1 * span1 + inner_one)
        .otherwise(w1 * span1 + w2 * span2 + inner_two)
    )
    w = F.when(
        (F.col("n") >= 3) & (F.col("xx") > 0),
        F.least(F.lit(1.0), F.try_divide(weighted * weighted, F.col("xx"))),
    )
    # A constant sample is perfectly regular: W = 1 and p = 1.
    w = F.when((F.col("n") >= 3) & (F.col("xx") == 0), F.lit(1.0)).otherwise(w)
    tested = with_a.withColumn("w", w)
    gap = F.when(F.col("w") < 1, F.log(1 - F.col("w")))
    limit = polynomial(SMALL_LIMIT, n)
    small = (-F.log(F.when(gap < limit, limit - gap)) - polynomial(SMALL_MEAN, n)) / F.exp(
        polynomial(SMALL_SPREAD, n)
    )
    large = (gap - polynomial(LARGE_MEAN, F.log(n))) / F.exp(polynomial(LARGE_SPREAD, F.log(n)))
    z = F.when(F.col("n") <= 11, small).otherwise(large)
    three = F.greatest(
        F.lit(0.0),
        F.lit(1.90985931710274) * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))),
    )
    p = (
        F.when(F.col("w").isNull(), F.lit(None).cast("double"))
        .when(F.col("w") == 1, F.lit(1.0))
        .when(F.col("n") == 3, three)
        .when((F.col("n") <= 11) & (gap >= limit), F.lit(0.0))
        .otherwise(F.col("p_tail"))
    )
    return (
        tested.withColumn("z", z)
        .withColumn("p_tail", normal_upper_p("z"))
        .select(*keys, "n", "w", p.alias("p_value"), (F.col("n") <= RELIABLE_UP_TO).alias("p_reliable"))
    )


def bartlett_statistic() -> Column:
    """Chi-square statistic from the columns of `class_moments`."""
    f0, f1 = F.col("n0") - 1, F.col("n1") - 1
    pooled = F.try_divide(f0 * F.col("variance0") + f1 * F.col("variance1"), f0 + f1)
    top = (f0 + f1) * F.log(pooled) - f0 * F.log("variance0") - f1 * F.log("variance1")
    correction = 1 + (F.try_divide(F.lit(1), f0) + F.try_divide(F.lit(1), f1)
                      - F.try_divide(F.lit(1), f0 + f1)) / 3
    usable = (F.col("variance0") > 0) & (F.col("variance1") > 0)
    return F.when(usable, top / correction)


def bartlett(df: DataFrame, columns: list[str], group: str = "yd") -> DataFrame:
    """Chi-square test of equal variances for two classes."""
    return (
        class_moments(df, columns, group)
        .select("variable", bartlett_statistic().alias("statistic"))
        .withColumn("p_value", chi2_p("statistic", F.lit(1.0)))
    )


def class_centres(df: DataFrame, columns: list[str], group: str, center: str) -> dict:
    if center == "median":
        rows = value_quantiles(df, columns, [0.5], [group]).collect()
        return {(r["variable"], r[group]): r["q_0"] for r in rows}
    rows = moments(df, columns, [group], shape=False).collect()
    return {(r["variable"], r[group]): r["mean"] for r in rows}


def levene(
    df: DataFrame, columns: list[str], group: str = "yd", center: str = "median"
) -> DataFrame:
    """F test on absolute distances from the class centre (median: Brown-Forsythe)."""
    known = df.where(F.col(group).isin(0, 1))
    centre = class_centres(known, columns, group, center)
    far = {}
    for c in columns:
        middle = F.when(F.col(group) == 0, F.lit(centre.get((c, 0)))).otherwise(
            F.lit(centre.get((c, 1)))
        )
        far[c] = F.abs(finite_or_null(c) - middle)
    m = class_moments(known.withColumns(far), columns, group)
    n0, n1, z0, z1 = (F.col(c) for c in ("n0", "n1", "mean0", "mean1"))
    grand = F.try_divide(n0 * z0 + n1 * z1, n0 + n1)
    between = n0 * (z0 - grand) ** 2 + n1 * (z1 - grand) ** 2
    within = (n0 - 1) * F.col("variance0") + (n1 - 1) * F.col("variance1")
    statistic = F.try_divide((n0 + n1 - 2) * between, within)
    return (
        m.select("variable", statistic.alias("statistic"), (n0 + n1 - 2).cast("double").alias("df"))
        .withColumn("p_value", student_p(F.sqrt("statistic"), "df"))
        .drop("df")
    )


def variance_homogeneity(
    df: DataFrame, columns: list[str], group: str = "yd", alpha: float = ALPHA, digits: int | None = 3
) -> DataFrame:
    """Normality first, then Bartlett when both classes look normal, else Levene."""
    shapiro = shapiro_wilk(df.where(F.col(group).isin(0, 1)), columns, [group])
    normality = shapiro.groupBy("variable").agg(
        *[F.max(F.when(F.col(group) == g, F.col("p_value"))).alias(f"p_shapiro_{g}") for g in (0, 1)]
    )
    table = (
        class_moments(df, columns, group)
        .join(normality, "variable", "left")
        .join(
            levene(df, columns, group).select("variable", F.col("p_value").alias("p_levene")),
            "variable", "left",
        )
        .withColumn("_chi2", bartlett_statistic())
        .withColumn("p_bartlett", chi2_p("_chi2", F.lit(1.0)))
    )
    enough = (F.col("n0") >= 3) & (F.col("n1") >= 3)
    flat = (F.col("variance0") == 0) | (F.col("variance1") == 0)
    normal = (F.col("p_shapiro_0") > alpha) & (F.col("p_shapiro_1") > alpha)
    chosen = F.when(normal, F.col("p_bartlett")).otherwise(F.col("p_levene"))
    show = lambda c: F.round(c, digits) if digits is not None else c
    return table.select(
        "variable",
        F.when(enough, F.when(flat, F.lit("undefined (zero variance)"))
               .when(normal, F.lit("bartlett")).otherwise(F.lit("levene"))).alias("test"),
        F.when(enough & ~flat, show(chosen)).alias("pvalue"),
        F.when(enough, normal).alias("decision_normality"),
        *[F.when(enough, F.when(flat, F.col(f"p_shapiro_{g}")).otherwise(show(F.col(f"p_shapiro_{g}"))))
          .alias(f"p_shapiro_{g}") for g in (0, 1)],
        F.when(enough, F.when(flat, F.col("variance0") == F.col("variance1"))
               .otherwise(chosen >= alpha)).alias("equal_variances"),
        "n0",
        "n1",
    ).orderBy(F.col("equal_variances").asc_nulls_last(), F.col("pvalue").asc_nulls_last(), "variable")


def equal_means(
    df: DataFrame, columns: list[str], group: str = "yd", equal_var_cols: list[str] = ()
) -> DataFrame:
    """t-tests of class 0 minus class 1: Welch, or pooled for the columns named; sorted by p."""
    m = class_moments(df, columns, group)
    n0, n1, v0, v1 = (F.col(c) for c in ("n0", "n1", "variance0", "variance1"))
    pooled = F.col("variable").isin(*equal_var_cols) if len(equal_var_cols) else F.lit(False)
    common = F.try_divide((n0 - 1) * v0 + (n1 - 1) * v1, n0 + n1 - 2)
    part0, part1 = F.try_divide(v0, n0), F.try_divide(v1, n1)
    error = F.when(
        pooled, common * (F.try_divide(F.lit(1), n0) + F.try_divide(F.lit(1), n1))
    ).otherwise(part0 + part1)
    welch = F.try_divide(
        (part0 + part1) ** 2,
        F.try_divide(part0 * part0, n0 - 1) + F.try_divide(part1 * part1, n1 - 1),
    )
    t = F.try_divide(F.col("mean0") - F.col("mean1"), F.sqrt(error))
    return (
        m.select(
            "variable", t.alias("t_statistic"),
            F.when(pooled, (n0 + n1 - 2).cast("double")).otherwise(welch).alias("df"),
        )
        .withColumn("p_value", student_p("t_statistic", "df"))
        .orderBy(F.col("p_value").asc_nulls_last(), "variable")
    )


def rejected(table: DataFrame, alpha: float = ALPHA, p: str = "p_value") -> DataFrame:
    return table.where(F.col(p) < alpha)


def split_balance(df: DataFrame, columns: list[str], sample: str = "in_test") -> DataFrame:
    """Do two samples agree? Welch t on means and Levene on variances."""
    means = equal_means(df, columns, sample).select(
        "variable", "t_statistic", F.col("p_value").alias("p_mean")
    )
    spread = levene(df, columns, sample).select(
        "variable", F.col("statistic").alias("levene"), F.col("p_value").alias("p_variance")
    )
    return means.join(spread, "variable")


def point_biserial(
    df: DataFrame, columns: list[str], target: str = "yd", digits: int | None = None
) -> DataFrame:
    """Correlation of each variable with the 0/1 target, t and p; sorted by p, missing last."""
    m = class_moments(df, columns, target)
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    gap = F.col("mean1") - F.col("mean0")
    within = (n0 - 1) * F.coalesce("variance0", F.lit(0.0)) + (n1 - 1) * F.coalesce(
        "variance1", F.lit(0.0)
    )
    between = F.try_divide(n0 * n1, n) * gap * gap
    usable = (n >= 3) & (n0 > 0) & (n1 > 0) & (within + between > 0)
    r = F.when(usable, F.signum(gap) * F.sqrt(F.try_divide(between, within + between)))
    t = F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r") ** 2)))
    show = lambda c: F.round(c, digits) if digits is not None else F.col(c)
    return (
        m.select("variable", r.alias("r"), n.alias("n"))
        .withColumn("t_stat", t)
        .withColumn("p_value", student_p("t_stat", (F.col("n") - 2).cast("double")))
        .select("variable", "r", show("t_stat").alias("t_stat"), show("p_value").alias("p_value"))
        .orderBy(F.col("p_value").asc_nulls_last(), "variable")
    )


def by_strength(table: DataFrame, column: str = "t_stat") -> DataFrame:
    return table.orderBy(F.abs(column).desc_nulls_last(), "variable")
