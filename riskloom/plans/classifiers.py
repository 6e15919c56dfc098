"""Spark ML estimators for the six model families, all with a `score` and a `prediction` column."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import clip
from riskloom.operators.impute import Scaler, fit_scaler
from riskloom.operators.regression import cross_moments, solve_linear

SEED = 42
VECTOR = "_features"
#: Fewest rows in a leaf of a boosted tree.
BOOSTING_LEAF = 20


# ---------------------------------------------------------------- preprocessing


class ScalerModel(Model):
    def __init__(self, scaler: Scaler):
        super().__init__()
        self.scaler = scaler

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_n_{c}": self.scaler.scale(c) for c in self.scaler.mean})


class PopulationScaler(Estimator):
    """Centre and divide by the population sd; the sample sd of StandardScaler differs slightly."""

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def _fit(self, df: DataFrame) -> ScalerModel:
        return ScalerModel(fit_scaler(df, self.columns))


def preprocessor(df: DataFrame, features: list[str]) -> list:
    """Stages for one vector: scaled numbers, then one-hot text; unseen text becomes all zeros."""
    kinds = {f.name: f.dataType for f in df.schema}
    numbers = [c for c in features if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    texts = [c for c in features if isinstance(kinds[c], T.StringType)]
    stages = [PopulationScaler(numbers)] if numbers else []
    if texts:
        index, hot = [f"_i_{c}" for c in texts], [f"_h_{c}" for c in texts]
        # "keep" adds a last slot for unseen values, and dropLast removes that slot.
        stages += [
            StringIndexer(inputCols=texts, outputCols=index, handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
    vector = [f"_n_{c}" for c in numbers] + [f"_h_{c}" for c in texts]
    return [*stages, VectorAssembler(inputCols=vector, outputCol=VECTOR)]


# ---------------------------------------------------------------- scored models


def continuous_score(columns: list[str]) -> Column:
    """Probability of class 1, else the raw decision value, else the plain prediction."""
    if "probability" in columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in columns:
        return vector_to_array("rawPrediction")[1]
    return F.col("prediction").cast("double")


class ScoredModel(Model):
    """A fitted model whose output is `score` and the class `prediction` at a cutoff."""

    def __init__(self, inner: Model, cut: float = 0.5, clipped: bool = False):
        super().__init__()
        self.inner, self.cut, self.clipped = inner, cut, clipped

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.inner.transform(df)
        score = continuous_score(out.columns)
        if self.clipped:
            score = clip(score, 1e-9, 1 - 1e-9)
        extra = [c for c in ("probability", "rawPrediction", "prediction") if c in out.columns]
        return (
            out.withColumn("score", score)
            .drop(*extra)
            .withColumn("prediction", (F.col("score") >= self.cut).cast("double"))
        )


class LinearScore(Model):
    """Least-squares score of a feature vector."""

    def __init__(self, coef):
        super().__init__()
        self.coef = [float(b) for b in coef]

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(VECTOR)
        value = F.lit(self.coef[0])
        for i, b in enumerate(self.coef[1:]):
            value = value + F.lit(b) * x[i]
        return df.withColumn("prediction", value)


def balanced(df: DataFrame, target: str) -> tuple[DataFrame, float]:
    """Weight n / (2 n_c) per row, from two counts; the weights add up to n."""
    row = df.agg(F.count(target).alias("n"), F.sum(F.col(target).cast("bigint")).alias("p")).first()
    n, p = row["n"], row["p"] or 0
    heavy, light = n / (2 * max(p, 1)), n / (2 * max(n - p, 1))
    return df.withColumn("_w", F.when(F.col(target) == 1, heavy).otherwise(light)), float(n)


class ScoreEstimator(Estimator):
    """Base: a target column name and tunable values held as ML params."""

    target = Param(Params._dummy(), "target", "0/1 column", TypeConverters.toString)

    def __init__(self, **values):
        super().__init__()
        self._setDefault(target="yd")
        for name, value in values.items():
            self._set(**{name: value})

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    @property
    def label(self) -> str:
        return self.value("target")


class PenalizedLogit(ScoreEstimator):
    """L2-penalised logistic regression with balanced classes; larger C, smaller penalty."""

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)

    def _fit(self, df: DataFrame) -> ScoredModel:
        weighted, total = balanced(df, self.label)
        return ScoredModel(
            LogisticRegression(
                featuresCol=VECTOR, labelCol=self.label, weightCol="_w", maxIter=2000, tol=1e-9,
                regParam=1 / (self.value("C") * total), elasticNetParam=0.0, standardization=False,
            ).fit(weighted)
        )


class Probit(ScoreEstimator):
    def _fit(self, df: DataFrame) -> ScoredModel:
        model = GeneralizedLinearRegression(
            family="binomial", link="probit", featuresCol=VECTOR, labelCol=self.label, maxIter=200,
            tol=1e-10,
        ).fit(df)
        return ScoredModel(model, clipped=True)


class LinearProbability(ScoreEstimator):
    """Least squares on the 0/1 target, clipped; dependent columns give the minimum-norm fit."""

    def _fit(self, df: DataFrame) -> ScoredModel:
        size = len(df.select(VECTOR).first()[0])
        x = vector_to_array(VECTOR)
        names = [f"_v{i}" for i in range(size)]
        wide = df.select(self.label, *[x[i].alias(n) for i, n in enumerate(names)])
        fit = solve_linear(cross_moments(wide, [*names, self.label]), self.label, names)
        return ScoredModel(LinearScore(fit.coef), clipped=True)


class Ridge(ScoreEstimator):
    """Ridge regression on -1/+1 with balanced classes; the sign decides the class."""

    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)

    def _fit(self, df: DataFrame) -> ScoredModel:
        weighted, total = balanced(df, self.label)
        signed = weighted.withColumn("_t", 2.0 * F.col(self.label) - 1)
        model = LinearRegression(
            featuresCol=VECTOR, labelCol="_t", weightCol="_w", solver="normal", elasticNetParam=0.0,
            standardization=False, regParam=self.value("alpha") / total,
        ).fit(signed)
        return ScoredModel(model, cut=0.0)


class Forest(ScoreEstimator):
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "largest depth", TypeConverters.toInt)
    leaf = Param(Params._dummy(), "leaf", "fewest rows in a leaf", TypeConverters.toInt)

    def _fit(self, df: DataFrame) -> ScoredModel:
        weighted, _ = balanced(df, self.label)
        return ScoredModel(
            RandomForestClassifier(
                featuresCol=VECTOR, labelCol=self.label, weightCol="_w", seed=SEED,
                numTrees=self.value("trees"), maxDepth=self.value("depth"),
                minInstancesPerNode=self.value("leaf"), featureSubsetStrategy="sqrt",
            ).fit(weighted)
        )


class Boosting(ScoreEstimator):
    """Gradient-boosted trees. Spark has no L2 term on leaf values, so that axis is absent."""

    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    depth = Param(Params._dummy(), "depth", "largest depth", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)

    def _fit(self, df: DataFrame) -> ScoredModel:
        return ScoredModel(
            GBTClassifier(
                featuresCol=VECTOR, labelCol=self.label, seed=SEED, maxIter=self.value("rounds"),
                stepSize=self.value("rate"), maxDepth=self.value("depth"),
                minInstancesPerNode=BOOSTING_LEAF,
            ).fit(df)
        )


# The tuning grids.
GRIDS = {
    "logreg": (PenalizedLogit, {"C": [0.1, 1.0, 3.0]}, {}),
    "probit": (Probit, {}, {}),
    "ols": (LinearProbability, {}, {}),
    "ridge": (Ridge, {"alpha": [0.5, 1.0, 3.0, 10.0]}, {}),
    "rf": (Forest, {"trees": [300, 600], "depth": [5, 8, 10], "leaf": [2, 4]}, {}),
    "hgb": (Boosting, {"rate": [0.05, 0.1], "depth": [3, 5, 8]}, {"rounds": 100}),
}


def pipeline(df: DataFrame, features: list[str], estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[*preprocessor(df, features), estimator])
