"""Scalar column expressions; all stay in JVM code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def is_finite(c: Column | str) -> Column:
    """True for ordinary numbers; NaN sorts above infinity in Spark, so one comparison suffices."""
    return F.coalesce(F.abs(col(c).cast("double")) < F.lit(float("inf")), F.lit(False))


def finite_or_null(c: Column | str) -> Column:
    c = col(c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def total(terms: list[Column]) -> Column:
    """Sum of several columns of one row."""
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def clip(c: Column | str, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def at_or_above(score: Column | str, threshold: float = 0.5) -> Column:
    """Predicted class of a score."""
    return (col(score) >= F.lit(float(threshold))).cast("int")


def same_label(c: Column | str, key: str) -> Column:
    return F.lower(F.trim(col(c))) == F.lit(key.strip().lower())


def standardized_residual(y: Column | str, p: Column | str, eps: float = 1e-9) -> Column:
    """Pearson residual of a 0/1 outcome on a clipped probability."""
    p = clip(p, eps, 1 - eps)
    return (col(y) - p) / F.sqrt(p * (1 - p))


def is_outlier(residual: Column | str, cut: float = 2.0) -> Column:
    return F.abs(col(residual)) > F.lit(cut)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) * F.lit(0.3989422804014327)


def linear_form(coefficients, columns: list[Column | str], intercept: float = 0.0) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.lit(float(k)) * col(c) for k, c in zip(coefficients, columns)],
        F.lit(float(intercept)),
    )


def polynomial(coefficients: list[float], x: Column) -> Column:
    """Horner form, constant term first."""
    value = F.lit(coefficients[-1])
    for k in reversed(coefficients[:-1]):
        value = value * x + F.lit(k)
    return value


# Published coefficients of the normal quantile (Wichura 1988, PPND16).
CENTRE_TOP = [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427,
              13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
              33430.575583588128105, 2509.0809287301226727]
CENTRE_BOTTOM = [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
                 21213.794301586595867, 39307.895800092710610, 28729.085735721942674,
                 5226.4952788528545610]
MIDDLE_TOP = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
              3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770,
              0.0227238449892691845833, 0.000774545014278341407640]
MIDDLE_BOTTOM = [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
                 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600,
                 1.05075007164441684324e-9]
TAIL_TOP = [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580,
            0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860,
            2.71155556874348757815e-5, 2.01033439929228813265e-7]
TAIL_BOTTOM = [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
               0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
               2.04426310338993978564e-15]


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1."""
    return quantile_branches(
        p - F.lit(0.5), F.lit(0.180625) - (p - F.lit(0.5)) ** 2, F.sqrt(-F.log(F.least(p, 1 - p)))
    )


def quantile_branches(q: Column, r: Column, t: Column) -> Column:
    centre = q * polynomial(CENTRE_TOP, r) / polynomial(CENTRE_BOTTOM, r)
    middle = polynomial(MIDDLE_TOP, t - 1.6) / polynomial(MIDDLE_BOTTOM, t - 1.6)
    tail = polynomial(TAIL_TOP, t - 5.0) / polynomial(TAIL_BOTTOM, t - 5.0)
    side = F.when(q < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(F.abs(q) <= 0.425, centre).otherwise(side * F.when(t <= 5.0, middle).otherwise(tail))


def with_normal_score(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the normal quantile of `p`; its repeated parts are columns of their own, computed once."""
    staged = df.withColumn("_p", p).withColumn("_q", F.col("_p") - 0.5).withColumns(
        {"_r": 0.180625 - F.col("_q") * F.col("_q"), "_t": F.sqrt(-F.log(F.least("_p", 1 - F.col("_p"))))}
    )
    value = quantile_branches(F.col("_q"), F.col("_r"), F.col("_t"))
    return staged.withColumn(name, value).drop("_p", "_q", "_r", "_t")
