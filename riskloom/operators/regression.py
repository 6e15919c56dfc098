"""Linear, logit, probit and constrained fits, their tables, scores and diagnostics.

A fit is one or a few aggregations; only p x p matrices come to the driver. Scores are column
expressions or Spark ML transforms on the whole table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import (
    clip, is_outlier, linear_form, normal_density, standardized_residual, total,
)
from riskloom.functions.tails import (
    chi2_upper, fisher_upper, normal_two_sided, student_quantile, student_two_sided,
)
from riskloom.operators.evaluate import auc
from riskloom.operators.frame import finite_rows
from riskloom.operators.ordering import with_neighbour

CONST = "const"
STARS = ((0.01, "***"), (0.05, "**"), (0.10, "*"))
COEFFICIENT_SCHEMA = (
    "model string, term string, coef double, std_err double, statistic double, p_value double, "
    "ci_low double, ci_high double"
)


def number(x) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


# ---------------------------------------------------------------- moments and linear fits


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred cross products of some columns."""

    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def part(self, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = [self.names.index(c) for c in columns]
        return self.mean[at], self.cross[np.ix_(at, at)]


def cross_moments(df: DataFrame, columns: list[str]) -> Moments:
    """One pass; centred sums avoid the cancellation of raw cross products."""
    x = {c: F.col(c).cast("double") for c in columns}
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(x[c]) for c in columns]).alias("mean"),
        F.array(*[F.covar_pop(x[columns[i]], x[columns[j]]) for i, j in pairs]).alias("cross"),
    ).first()
    n, size = row["n"], len(columns)
    cross = np.zeros((size, size))
    if n:
        for (i, j), value in zip(pairs, row["cross"]):
            cross[i, j] = cross[j, i] = n * value
    return Moments(tuple(columns), n, np.array([m or 0.0 for m in row["mean"]]), cross)


@dataclass(frozen=True)
class LinearFit:
    name: str
    target: str
    features: tuple[str, ...]
    coef: np.ndarray  # constant first
    covariance: np.ndarray
    n: int
    rank: int
    sse: float
    sst: float
    eigenvalues: np.ndarray
    dropped: tuple[str, ...] = ()

    @property
    def terms(self) -> list[str]:
        return [CONST, *self.features]

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    @property
    def r2(self) -> float | None:
        return 1 - self.sse / self.sst if self.sst > 0 else None

    @property
    def loglik(self) -> float | None:
        if self.sse <= 0 or not self.n:
            return None
        return -self.n / 2 * (math.log(2 * math.pi * self.sse / self.n) + 1)

    def score(self) -> Column:
        return linear_form(self.coef[1:], list(self.features), self.coef[0])

    def transform(self, df: DataFrame, output: str = "score_ols") -> DataFrame:
        return df.withColumn(output, F.when(complete(self.features), self.score()))

    def rows(self) -> list[tuple]:
        spread = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        reach = student_quantile(0.975, self.df_resid) if self.df_resid > 0 else float("nan")
        out = []
        for term, b, se in zip(self.terms, self.coef, spread):
            t = b / se if se > 0 else float("nan")
            p = number(student_two_sided(t, self.df_resid))
            out.append((self.name, term, float(b), number(se), number(t), p,
                        number(b - reach * se), number(b + reach * se)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), COEFFICIENT_SCHEMA)


def usable_rank(cross: np.ndarray) -> int:
    """Rank of a centred cross-product matrix, judged after scaling its columns."""
    scale = np.sqrt(np.diag(cross))
    live = scale > 0
    if not live.any():
        return 0
    scaled = cross[np.ix_(live, live)] / np.outer(scale[live], scale[live])
    values = np.linalg.eigvalsh(scaled)
    return int((values > 1e-10 * max(values.max(), 1)).sum())


def independent_columns(moments: Moments, features: list[str]) -> list[str]:
    """Features kept when each is added only if it raises the rank."""
    kept: list[str] = []
    for c in features:
        if usable_rank(moments.part([*kept, c])[1]) == len(kept) + 1:
            kept.append(c)
    return kept


def solve_linear(
    moments: Moments, target: str, features: list[str], name: str = "OLS",
    drop_collinear: bool = False,
) -> LinearFit:
    dropped: tuple[str, ...] = ()
    if drop_collinear:
        kept = independent_columns(moments, features)
        dropped = tuple(c for c in features if c not in kept)
        features = kept
    mean, cross = moments.part([*features, target])
    n, k = moments.n, len(features)
    x_mean, y_mean = mean[:k], mean[k]
    sxx, sxy, syy = cross[:k, :k], cross[:k, k], cross[k, k]
    # Cross products with the constant, for eigenvalues and the minimum-norm solution.
    raw = np.empty((k + 1, k + 1))
    raw[0, 0], raw[0, 1:], raw[1:, 0] = n, n * x_mean, n * x_mean
    raw[1:, 1:] = sxx + n * np.outer(x_mean, x_mean)
    values, vectors = np.linalg.eigh(raw)
    rank = usable_rank(sxx) + (1 if n else 0)
    if rank == k + 1:
        inner = np.linalg.inv(sxx) if k else np.zeros((0, 0))
        slope = inner @ sxy
        coef = np.concatenate([[y_mean - slope @ x_mean], slope])
        inverse = np.empty((k + 1, k + 1))
        inverse[1:, 1:] = inner
        inverse[0, 1:] = inverse[1:, 0] = -inner @ x_mean
        inverse[0, 0] = 1 / n + x_mean @ inner @ x_mean
    else:
        top = np.argsort(values)[::-1][:rank]
        inverse = (vectors[:, top] / values[top]) @ vectors[:, top].T
        coef = inverse @ np.concatenate([[n * y_mean], sxy + n * y_mean * x_mean])
        slope = coef[1:]
    sse = max(float(syy - 2 * slope @ sxy + slope @ sxx @ slope), 0.0)
    df_resid = n - rank
    sigma2 = sse / df_resid if df_resid > 0 else float("nan")
    return LinearFit(name, target, tuple(features), coef, sigma2 * inverse, n, rank, sse,
                     float(syy), np.sort(values), dropped)


def ols(
    df: DataFrame, features: list[str], target: str = "yd", name: str = "OLS",
    drop_collinear: bool = False,
) -> LinearFit:
    """Least squares with constant; minimum-norm when the columns are dependent."""
    clean = finite_rows(df, [*features, target])
    return solve_linear(cross_moments(clean, [*features, target]), target, list(features), name,
                        drop_collinear)


def fit_summary(df: DataFrame, fit: LinearFit, key: str = "id") -> DataFrame:
    """R2, F, likelihood, AIC, BIC, residual shape tests, Durbin-Watson, condition number.

    `key` gives the row order for Durbin-Watson and must be unique.
    """
    rows = finite_rows(df, [*fit.features, fit.target]).select(
        key, (F.col(fit.target) - fit.score()).alias("e")
    )
    spread = F.var_pop("e") > 0
    shape = rows.agg(
        F.when(spread, F.skewness("e")).alias("skew"),
        F.when(spread, F.kurtosis("e") + 3).alias("kurtosis"),
    ).first()
    steps = with_neighbour(rows, key, ["e"])
    gap = F.col("e") - F.col("prev_e")
    dw = steps.agg(F.try_divide(F.sum(gap * gap), F.sum(F.col("e") * F.col("e")))).first()[0]
    n, k, slopes = fit.n, fit.rank, fit.rank - 1
    skew, kurt = shape["skew"], shape["kurtosis"]
    jb = None if skew is None else n / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
    omnibus = residual_omnibus(n, skew, kurt)
    f = None
    if fit.sse > 0 and slopes and fit.df_resid > 0:
        f = (fit.sst - fit.sse) / slopes / (fit.sse / fit.df_resid)
    ll = fit.loglik
    low, high = fit.eigenvalues[0], fit.eigenvalues[-1]
    values = {
        "n": n, "df_model": slopes, "df_resid": fit.df_resid, "r2": fit.r2,
        "adj_r2": None if fit.r2 is None or fit.df_resid <= 0
        else 1 - (1 - fit.r2) * (n - 1) / fit.df_resid,
        "f": f, "f_p_value": None if f is None else fisher_upper(f, slopes, fit.df_resid),
        "loglik": ll, "aic": None if ll is None else 2 * k - 2 * ll,
        "bic": None if ll is None else k * math.log(n) - 2 * ll,
        "skew": skew, "kurtosis": kurt, "jarque_bera": jb,
        "jb_p_value": None if jb is None else chi2_upper(jb, 2),
        "omnibus": omnibus, "omnibus_p_value": None if omnibus is None else chi2_upper(omnibus, 2),
        "durbin_watson": dw, "smallest_eigenvalue": low,
        "condition_number": math.sqrt(high / low) if low > 0 else math.inf,
    }
    return df.sparkSession.createDataFrame(
        [(fit.name, k, None if v is None else float(v)) for k, v in values.items()],
        "model string, measure string, value double",
    )


def residual_omnibus(n: int, skew: float | None, kurt: float | None) -> float | None:
    """Sum of squared normal scores of skewness and kurtosis (D'Agostino and Pearson)."""
    if skew is None or n < 8:
        return None
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(w2) / 2)
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - expected) / math.sqrt(variance)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(
        6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))
    )
    a = 6 + 8 / third * (2 / third + math.sqrt(1 + 4 / third**2))
    ratio = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


# ---------------------------------------------------------------- constraints


def constrained_ols(
    df: DataFrame, features: list[str], target: str, constraints: list[dict[str, float]],
    values: list[float] | None = None, name: str = "Constrained",
) -> LinearFit:
    """Least squares under linear equalities, each a mapping term -> weight."""
    m = cross_moments(finite_rows(df, [*features, target]), [*features, target])
    terms = [CONST, *features]
    r = np.array([[c.get(t, 0.0) for t in terms] for c in constraints])
    q = np.array(values if values is not None else [0.0] * len(constraints))
    mean, cross = m.part([*features, target])
    k, n = len(features), m.n
    full = np.empty((k + 1, k + 1))
    full[0, 0], full[0, 1:], full[1:, 0] = n, n * mean[:k], n * mean[:k]
    full[1:, 1:] = cross[:k, :k] + n * np.outer(mean[:k], mean[:k])
    xy = np.concatenate([[n * mean[k]], cross[:k, k] + n * mean[k] * mean[:k]])
    # Free directions that keep the constraints satisfied.
    _, singular, vt = np.linalg.svd(r)
    free = vt[int((singular > 1e-12 * singular.max()).sum()):].T
    start = np.linalg.pinv(r) @ q
    inner = free @ np.linalg.pinv(free.T @ full @ free, rcond=1e-12) @ free.T
    coef = start + inner @ (xy - full @ start)
    slope = coef[1:]
    offset = mean[k] - coef[0] - slope @ mean[:k]
    sse = float(cross[k, k] - 2 * slope @ cross[:k, k] + slope @ cross[:k, :k] @ slope + n * offset**2)
    rank = int(np.linalg.matrix_rank(free.T @ full @ free))
    sigma2 = sse / (n - rank) if n > rank else float("nan")
    return LinearFit(name, target, tuple(features), coef, sigma2 * inner, n, rank, max(sse, 0.0),
                     float(cross[k, k]), np.linalg.eigvalsh(full))


def linear_hypothesis(
    df: DataFrame, features: list[str], target: str, constraints: list[dict[str, float]],
    values: list[float] | None = None,
) -> DataFrame:
    """F test of linear equalities; NULL when a combination is not determined by the data."""
    free = ols(df, features, target)
    bound = constrained_ols(df, features, target, constraints, values)
    r = np.array([[c.get(t, 0.0) for t in free.terms] for c in constraints])
    projector = free.covariance @ np.linalg.pinv(free.covariance) if free.sse > 0 else np.eye(len(r[0]))
    estimable = bool(np.allclose(r @ projector, r, atol=1e-6))
    q = int(np.linalg.matrix_rank(r))
    f = p = None
    if estimable and free.sse > 0 and free.df_resid > 0:
        f = (bound.sse - free.sse) / q / (free.sse / free.df_resid)
        p = fisher_upper(f, q, free.df_resid)
    return df.sparkSession.createDataFrame(
        [(estimable, q, free.df_resid, number(f), number(p))],
        "estimable boolean, df1 int, df2 int, f double, p_value double",
    )


# ---------------------------------------------------------------- logit and probit


@dataclass(frozen=True)
class BinaryFit:
    name: str
    link: str
    target: str
    features: tuple[str, ...]
    coef: np.ndarray  # constant first
    covariance: np.ndarray
    n: int
    loglik: float
    loglik_null: float
    iterations: int
    converged: bool
    model: object = field(repr=False, compare=False)

    @property
    def terms(self) -> list[str]:
        return [CONST, *self.features]

    @property
    def pseudo_r2(self) -> float | None:
        """McFadden's measure."""
        return 1 - self.loglik / self.loglik_null if self.loglik_null else None

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        """Fitted probability of every row; rows with missing features get NULL."""
        output = output or f"score_{self.link}"
        if self.link == "logit":
            eta = linear_form(self.coef[1:], list(self.features), self.coef[0])
            return df.withColumn(output, F.when(complete(self.features), 1 / (1 + F.exp(-eta))))
        return (
            VectorAssembler(inputCols=list(self.features), outputCol="_x", handleInvalid="keep")
            .transform(df)
            .withColumn("_x", F.when(complete(self.features), F.col("_x")))
            .transform(lambda d: null_safe_score(self.model, d, output))
            .drop("_x")
        )

    def rows(self) -> list[tuple]:
        spread = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        out = []
        for term, b, se in zip(self.terms, self.coef, spread):
            z = b / se if se > 0 else float("nan")
            p = number(normal_two_sided(z))
            out.append((self.name, term, float(b), number(se), number(z), p,
                        number(b - 1.959963984540054 * se), number(b + 1.959963984540054 * se)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), COEFFICIENT_SCHEMA)

    def summary(self, spark: SparkSession) -> DataFrame:
        ratio = 2 * (self.loglik - self.loglik_null)
        slopes = len(self.features)
        values = {
            "n": self.n, "loglik": self.loglik, "loglik_null": self.loglik_null,
            "lr": ratio, "lr_p_value": chi2_upper(max(ratio, 0.0), slopes),
            "pseudo_r2": self.pseudo_r2, "iterations": self.iterations,
            "converged": float(self.converged),
            "aic": 2 * (slopes + 1) - 2 * self.loglik,
            "bic": math.log(self.n) * (slopes + 1) - 2 * self.loglik,
        }
        return spark.createDataFrame(
            [(self.name, k, number(v)) for k, v in values.items()],
            "model string, measure string, value double",
        )


def complete(features) -> Column:
    condition = F.lit(True)
    for c in features:
        condition = condition & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return condition


def null_safe_score(model, df: DataFrame, output: str) -> DataFrame:
    """Apply a model to the rows that have a vector; the others keep a NULL score."""
    blank = F.array_repeat(F.lit(0.0), int(model.numFeatures))
    from pyspark.ml.functions import array_to_vector

    known = df.withColumn("_known", F.col("_x").isNotNull()).withColumn(
        "_x", F.coalesce("_x", array_to_vector(blank))
    )
    scored = model.transform(known)
    return scored.withColumn(output, F.when(F.col("_known"), F.col("prediction"))).drop(
        "_known", "prediction"
    )


def glm(
    df: DataFrame, features: list[str], target: str = "yd", link: str = "logit",
    name: str | None = None, max_iter: int = 100, tol: float = 1e-12, information: str = "observed",
) -> BinaryFit:
    """Unpenalised logit or probit by maximum likelihood.

    Standard errors come from the observed information (one aggregation at the estimate), or the
    expected one on request. Perfectly separated classes give `converged=False`.
    """
    features = list(features)
    clean = finite_rows(df, [*features, target]).select(
        F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]
    )
    train = VectorAssembler(inputCols=features, outputCol="_x").transform(clean).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        model = GeneralizedLinearRegression(
            family="binomial", link=link, featuresCol="_x", labelCol="_y", predictionCol="_p",
            maxIter=max_iter, tol=tol, regParam=0.0,
        ).fit(train)
        coef = np.concatenate([[model.intercept], model.coefficients.toArray()])
        scored = model.transform(train)
        eta = linear_form(coef[1:], features, coef[0])
        y, p = F.col("_y"), F.col("_p")
        if link == "logit":
            weight = p * (1 - p)
        elif information == "expected":
            density = normal_density(eta)
            weight = density * density / F.greatest(p * (1 - p), F.lit(1e-300))
        else:
            side = 2 * y - 1
            own = F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(1e-300))
            pull = side * normal_density(eta) / own
            weight = pull * (pull + eta)
        terms = [F.lit(1.0), *[F.col(c) for c in features]]
        pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
        own_p = F.when(y == 1, p).otherwise(1 - p)
        row = scored.withColumn("_w", weight).agg(
            F.count("*").alias("n"), F.avg("_y").alias("rate"),
            F.sum(F.log(F.greatest(own_p, F.lit(1e-300)))).alias("loglik"),
            F.min(own_p).alias("worst"),
            F.array(*[F.sum(F.col("_w") * terms[i] * terms[j]) for i, j in pairs]).alias("info"),
        ).first()
        iterations = model.summary.numIterations
    finally:
        train.unpersist()
    matrix = np.zeros((len(terms), len(terms)))
    for (i, j), value in zip(pairs, row["info"]):
        matrix[i, j] = matrix[j, i] = value
    n, rate = row["n"], row["rate"]
    null = n * sum(r * math.log(r) for r in (rate, 1 - rate) if r > 0)
    separated = row["worst"] > 1 - 1e-4
    return BinaryFit(
        name or link.capitalize(), link, target, tuple(features), coef,
        np.linalg.pinv(matrix, rcond=1e-14, hermitian=True), n, row["loglik"], null, iterations,
        iterations < max_iter and not separated, model_with_prediction(model),
    )


def model_with_prediction(model):
    return model.copy().setPredictionCol("prediction").setFeaturesCol("_x")


def logit(df, features, target="yd", **options) -> BinaryFit:
    return glm(df, features, target, "logit", **options)


def probit(df, features, target="yd", **options) -> BinaryFit:
    return glm(df, features, target, "probit", **options)


# ---------------------------------------------------------------- tables over several fits


def three_fits(df: DataFrame, features: list[str], target: str = "yd") -> list:
    return [ols(df, features, target), logit(df, features, target), probit(df, features, target)]


def score_column(fit) -> str:
    return SCORE_COLUMNS.get(fit.name, f"score_{fit.name.lower()}")


def score_table(
    df: DataFrame, fits: list, features: list[str], target: str = "yd", key: str = "id",
    keep: list[str] = (),
) -> DataFrame:
    """Key, target, features, further columns to keep and one score column per fit, row by row."""
    scores = [score_column(f) for f in fits]
    if len(set(scores)) < len(scores):
        raise ValueError("fits need different names")
    out = df
    for fit, c in zip(fits, scores):
        out = fit.transform(out, c)
    return out.select(key, target, *features, *keep, *scores)


def coefficient_table(spark: SparkSession, fits: list) -> DataFrame:
    return spark.createDataFrame([r for f in fits for r in f.rows()], COEFFICIENT_SCHEMA)


def stars(p: Column, cuts=STARS) -> Column:
    mark = F.lit("")
    for level, sign in reversed(cuts):
        mark = F.when(p < level, sign).otherwise(mark)
    return mark


SCORE_COLUMNS = {"OLS": "score_ols", "Logit": "score_logit", "Probit": "score_probit"}


def long_scores(
    scores: DataFrame, target: str = "yd", key: str = "id", columns: dict[str, str] | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """Score columns, {model: column}, as rows (key, target, kept columns, Model, p_hat)."""
    columns = columns or {m: c for m, c in SCORE_COLUMNS.items() if c in scores.columns}
    cells = [F.struct(F.lit(m).alias("Model"), F.col(c).alias("p_hat")) for m, c in columns.items()]
    return scores.select(key, target, *keep, F.inline(F.array(*cells)))


def comparison_table(
    df: DataFrame, fits: list, target: str = "yd", digits: int = 3, cuts=STARS
) -> DataFrame:
    """Coefficients with stars and standard errors, N, R2 or pseudo R2, log-likelihood and AUC."""
    spark = df.sparkSession
    features = list(fits[0].features)
    scores = score_table(finite_rows(df, [*features, target]), fits, features, target)
    columns = {f.name: score_column(f) for f in fits}
    areas = auc(long_scores(scores, target, columns=columns), "p_hat", target, ["Model"])
    table = coefficient_table(spark, fits)
    shown = lambda c: F.format_number(c, digits)
    fixed = lambda v: "" if v is None else f"{v:.{digits}f}"
    cells = table.select(
        "model", "term", F.posexplode(F.array(
            F.concat(shown("coef"), stars(F.col("p_value"), cuts)),
            F.concat(F.lit("("), shown("std_err"), F.lit(")")),
        )).alias("line", "text"),
    )
    facts = spark.createDataFrame(
        [
            (f.name, term, 0, text)
            for f in fits
            for term, text in (
                ("N", str(f.n)),
                ("R2", fixed(f.r2 if isinstance(f, LinearFit) else f.pseudo_r2)),
                ("loglik", fixed(f.loglik)),
            )
        ],
        "model string, term string, line int, text string",
    )
    area_cells = areas.select(
        F.col("Model").alias("model"), F.lit("AUC").alias("term"), F.lit(0).alias("line"),
        shown("auc").alias("text"),
    )
    place = {t: i for i, t in enumerate([*fits[0].terms, "N", "R2", "loglik", "AUC"])}
    order = F.coalesce(*[F.when(F.col("term") == t, i) for t, i in place.items()])
    return (
        cells.unionByName(facts).unionByName(area_cells)
        .groupBy("term", "line").pivot("model", [f.name for f in fits]).agg(F.first("text"))
        .orderBy(order, "line")
    )


# ---------------------------------------------------------------- diagnostics


def leverage(df: DataFrame, features: list[str], output: str = "leverage") -> tuple[DataFrame, float, int]:
    """Hat diagonal of the regression on constant and features, the cut 2p/n, and the rank.

    The quadratic form is written in the principal axes of the centred columns, so it is a sum of
    squares evaluated per row without a join. Rows with missing features get NULL.
    """
    clean = finite_rows(df, features)
    m = cross_moments(clean, features)
    scale = np.sqrt(np.diag(m.cross))
    live = np.flatnonzero(scale > 0)
    squares = [F.lit(1.0 / m.n if m.n else float("nan"))]
    rank = 1
    if len(live):
        scaled = m.cross[np.ix_(live, live)] / np.outer(scale[live], scale[live])
        values, vectors = np.linalg.eigh(scaled)
        for value, vector in zip(values, vectors.T):
            if value > 1e-10 * max(values.max(), 1):
                weights = vector / scale[live] / math.sqrt(value)
                centred = [F.col(features[i]) - F.lit(float(m.mean[i])) for i in live]
                axis = linear_form(weights, centred)
                squares.append(axis * axis)
                rank += 1
    cut = 2 * (len(features) + 1) / m.n if m.n else float("nan")
    usable = complete(features) & F.lit(bool(m.n))
    out = df.withColumn(output, F.when(usable, total(squares))).withColumn(
        "high_leverage", F.col(output) > cut
    )
    return out, cut, rank


def residual_table(
    scores: DataFrame, target: str = "yd", key: str = "id", cut: float = 2.0
) -> DataFrame:
    """Pearson residual and outlier flag for every row and model, long form."""
    cells = [
        F.struct(
            F.lit(m).alias("model"),
            clip(c, 1e-9, 1 - 1e-9).alias("p_hat"),
            standardized_residual(target, c, 1e-6 if m == "OLS" else 1e-12).alias("residual"),
        )
        for m, c in SCORE_COLUMNS.items()
    ]
    return (
        scores.select(key, F.col(target).alias("y"), F.inline(F.array(*cells)))
        .where(F.col("p_hat").isNotNull())
        .withColumn("outlier", is_outlier("residual", cut))
    )


def outliers(residuals: DataFrame, model: str | None = None) -> DataFrame:
    picked = residuals.where(F.col("outlier"))
    return picked.where(F.lower(F.trim("model")) == model.strip().lower()) if model else picked


def score_gradient(df: DataFrame, fit: BinaryFit) -> DataFrame:
    """Derivative of the log-likelihood at the estimate, one row per term; near 0 at the optimum."""
    clean = finite_rows(df, [*fit.features, fit.target])
    scored = fit.transform(clean, "_p")
    y, p = F.col(fit.target), F.col("_p")
    pull = y - p
    if fit.link == "probit":
        eta = linear_form(fit.coef[1:], list(fit.features), fit.coef[0])
        pull = (y - p) * normal_density(eta) / F.greatest(p * (1 - p), F.lit(1e-300))
    cells = [F.struct(F.lit(CONST).alias("term"), F.avg(pull).alias("gradient"))] + [
        F.struct(F.lit(c).alias("term"), F.avg(pull * F.col(c)).alias("gradient"))
        for c in fit.features
    ]
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
