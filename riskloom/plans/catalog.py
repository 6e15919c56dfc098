"""Every operator run over whole tables of a data folder, keyed by its inventory number.

Numbers are rounded to six digits so that engines with another order of summation agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import (
    at_or_above, clip, is_outlier, normal_quantile, same_label, standardized_residual,
)
from riskloom.operators import (
    association, describe, evaluate, frame, hypothesis, impute, ordering, regression, sampling,
)
from riskloom.plans import classifiers, selection, study
from riskloom.sources import frames, tables
from riskloom.sources.frames import (
    EVENT_FEATURES, ORDER_FEATURES, QUALITY_FEATURES, coded_events, events_frame, orders_frame,
    quality_frame,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero; decimals of whole numbers as doubles."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("decimal"):
            c = c.cast("double")
        if kind in ("double", "float"):
            c = F.round(c, digits) + 0.0
        out.append(c.alias(name))
    return df.select(*out)


def indexed_orders(spark: SparkSession, d: str) -> DataFrame:
    """All orders in order of class, price and key; even positions are the validation sample."""
    return sampling.systematic_split(
        orders_frame(spark, d).withColumnRenamed("id", "row_key"), ["yd", "price"], "row_key"
    )


def scored_quality(spark: SparkSession, d: str) -> tuple[DataFrame, list, DataFrame]:
    """Quality frame, the three one-variable fits and their scores."""
    df = tables.stored(quality_frame(spark, d))
    fits = regression.three_fits(df, ["word_density"])
    return df, fits, regression.score_table(df, fits, ["word_density"])


# ---------------------------------------------------------------- sources and sinks


def coded_text(spark: SparkSession, d: str) -> str:
    path = tables.scratch_path(spark, "text")
    coded_events(spark, d).select(*EVENT_FEATURES[::-1], "id", "yd").write.csv(path, header=True, sep=";")
    return path


EVENT_SCHEMA = "id long, yd int, value double, k double, hour double"


@query
def a1_delimited_read(spark, d):
    schema = spark.createDataFrame([], EVENT_SCHEMA).schema
    return tidy(tables.read_delimited(spark, coded_text(spark, d), schema, null_tokens=("-99.99",)))


@query
def a2_sentinel_to_null(spark, d):
    return tidy(tables.sentinel_to_null(coded_events(spark, d), EVENT_FEATURES))


@query
def a3_null_tokens(spark, d):
    schema = spark.createDataFrame([], EVENT_SCHEMA).schema
    return tidy(tables.read_delimited(spark, coded_text(spark, d), schema))


@query
def a4_stored_samples(spark, d):
    path = tables.scratch_path(spark, "samples")
    tables.write_samples(indexed_orders(spark, d), path)
    return tidy(tables.read_sample(spark, path, 0).groupBy("yd").agg(
        F.count("*").alias("n"), F.avg("price").alias("mean_price"),
        F.count("quantity").alias("n_quantity"),
    ))


@query
def a5_result_table(spark, d):
    path = tables.scratch_path(spark, "result")
    tables.write_result(describe.shape(orders_frame(spark, d), ORDER_FEATURES), path)
    return tidy(spark.read.parquet(path))


# ---------------------------------------------------------------- projection and predicates


@query
def b1_all_but(spark, d):
    return tidy(frame.select_except(orders_frame(spark, d)))


@query
def b2_feature_resolution(spark, d):
    df = events_frame(spark, d)
    return tidy(df.select("id", *frame.resolve_features(df, ["hour", "absent", "value"])))


@query
def b3_numeric_columns(spark, d):
    customers = frames.table(spark, d, "customer")
    return tidy(customers.select(*frame.numeric_features(customers)))


@query
def b4_filtered_sample(spark, d):
    df = indexed_orders(spark, d).where((F.col("dumVE") == 0) & (F.col("yd") == 1))
    return tidy(df.select("id", "row_key", "price"))


@query
def b5_finite_rows(spark, d):
    df = events_frame(spark, d)
    ratio = F.when(F.col("k") == 0, F.lit(float("inf"))).otherwise(F.col("value") / F.col("k"))
    kept = frame.finite_rows(df.select("id", "yd", ratio.alias("ratio")), ["ratio"])
    return tidy(kept, 9)


@query
def b6_complete_cases(spark, d):
    return tidy(frame.complete_cases(orders_frame(spark, d)))


@query
def b7_nan_to_null(spark, d):
    coded = coded_events(spark, d).withColumn(
        "value", F.when(F.col("value") == tables.SENTINEL, F.lit(float("nan"))).otherwise(F.col("value"))
    )
    return tidy(frame.nulls_for_nan(coded))


@query
def b8_derived_columns(spark, d):
    return frame.with_complement(events_frame(spark, d)).select("id", "yd", "ynd", "z")


@query
def b9_casts_b10_rename(spark, d):
    return events_frame(spark, d).select(
        F.col("id").alias("row"), F.col("yd").cast("byte").cast("int").alias("flag"),
        F.col("hour").cast("int").alias("hour"), F.col("yd").cast("double").alias("y"),
    )


@query
def b11_binary_target(spark, d):
    return frame.class_counts(frame.check_binary_target(quality_frame(spark, d)))


@query
def b12_missing_cells(spark, d):
    return frame.missing_cells(orders_frame(spark, d), ORDER_FEATURES)


@query
def b13_clip(spark, d):
    return tidy(orders_frame(spark, d).select("id", clip("balance", 0.0, 5.0).alias("balance")))


@query
def b14_display_rounding(spark, d):
    return hypothesis.point_biserial(orders_frame(spark, d), ORDER_FEATURES, digits=3).select(
        "variable", "t_stat", "p_value"
    )


@query
def b15_label_match(spark, d):
    orders = frames.table(spark, d, "orders")
    return orders.where(same_label("o_orderpriority", " 1-Urgent ")).select("o_orderkey")


@query
def b16_outlier_flag(spark, d):
    df = impute.standardize(orders_frame(spark, d), ["quantity"])
    return tidy(df.select("id", "quantity", is_outlier("quantity").alias("outlier")))


@query
def b17_threshold_class(spark, d):
    df = events_frame(spark, d).withColumn("said", at_or_above("value", 50.0))
    return df.groupBy("said", "yd").agg(F.count("*").alias("n"))


@query
def b18_optional_columns(spark, d):
    df = events_frame(spark, d).withColumnRenamed("id", "row_key")
    return ordering.global_index(df, ["absent", "hour", "value"], "row_key").select("row_key", "id")


@query
def b19_math(spark, d):
    c = F.col("value")
    return tidy(events_frame(spark, d).select(
        "id", F.sqrt(c).alias("root"), F.abs(c - 50).alias("gap"), F.pow(c, F.lit(0.25)).alias("power"),
        F.exp(-c / 100).alias("decay"), F.pmod(F.col("k"), F.lit(7.0)).alias("rest"),
        normal_quantile((F.col("k") + 0.5) / 100.5).alias("quantile"),
    ))


@query
def b20_error_to_missing(spark, d):
    return tidy(events_frame(spark, d).select(
        "id", F.try_divide("value", "k").alias("ratio"),
        F.when(F.col("k") > 0, F.log("k")).alias("log_k"),
    ), 9)


# ---------------------------------------------------------------- order and samples


@query
def c1_sorted_c4_top(spark, d):
    return tidy(frame.top_rows(orders_frame(spark, d), "quantity", 25, ascending=True).select("id", "quantity"))


@query
def c2_global_index(spark, d):
    return indexed_orders(spark, d).select("id", "row_key")


@query
def c3_systematic_split(spark, d):
    df = sampling.systematic_split(
        events_frame(spark, d).withColumnRenamed("id", "row_key"), ["yd", "value"], "row_key"
    )
    return df.select("row_key", "id", F.col("dumVE").cast("int").alias("dumVE"))


@query
def c4_top_leverage(spark, d):
    df, _, _ = regression.leverage(orders_frame(spark, d), ORDER_FEATURES)
    return tidy(frame.top_rows(df.where("high_leverage"), "leverage", 10).select("id", "leverage"))


def placed(table: DataFrame) -> DataFrame:
    """The place of each row in the order a small result table comes in."""
    return table.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "place", F.row_number().over(Window.orderBy("_at")).cast("long")).drop("_at")


@query
def c5_sorted_by_p(spark, d):
    return tidy(placed(hypothesis.rejected(hypothesis.equal_means(quality_frame(spark, d), QUALITY_FEATURES))))


@query
def c6_by_strength(spark, d):
    table = hypothesis.point_biserial(orders_frame(spark, d), ORDER_FEATURES)
    return tidy(placed(hypothesis.by_strength(table, "r").select("variable", "r")))


@query
def c8_stratified_split(spark, d):
    return sampling.random_split(orders_frame(spark, d), 0.25, "yd").select("id", "yd", "in_test")


@query
def c9_random_split(spark, d):
    return sampling.random_split(events_frame(spark, d), 0.25).select("id", "in_test")


@query
def c10_stratified_folds(spark, d):
    return sampling.stratified_folds(orders_frame(spark, d), 5).select("id", "yd", "fold")


# ---------------------------------------------------------------- joins and reshaping


@query
def d1_attached_scores(spark, d):
    _, _, scores = scored_quality(spark, d)
    return tidy(frame.attach(quality_frame(spark, d), scores.select("id", "score_ols")))


@query
def d2_members(spark, d):
    df = events_frame(spark, d)
    test = sampling.random_split(df, 0.25).where("in_test = 1")
    return tidy(frame.keep_members(df, test))


@query
def d6_masked_fill(spark, d):
    df = orders_frame(spark, d)
    means = df.select("id", F.lit(-1.0).alias("quantity"), F.lit(-2.0).alias("lines"))
    return tidy(frame.fill_gaps(df, means, ["quantity", "lines"]).select("id", "quantity", "lines"))


@query
def d7_stacked_results(spark, d):
    parts = [
        describe.group_summary(f(spark, d), cols)
        for f, cols in ((orders_frame, ORDER_FEATURES), (quality_frame, QUALITY_FEATURES))
    ]
    return tidy(parts[0].unionByName(parts[1]))


@query
def d8_long_form(spark, d):
    return tidy(frame.long_form(orders_frame(spark, d), ["id", "yd"], ORDER_FEATURES))


# ---------------------------------------------------------------- description


@query
def e1_group_describe(spark, d):
    return tidy(describe.describe(tables.stored(orders_frame(spark, d)), ORDER_FEATURES, ["yd"]))


@query
def e1_group_describe_nearest(spark, d):
    return tidy(describe.describe(events_frame(spark, d), EVENT_FEATURES, ["yd"], nearest=True))


@query
def e2_sample_describe(spark, d):
    return tidy(describe.describe(events_frame(spark, d), EVENT_FEATURES))


@query
def e3_group_summary(spark, d):
    return tidy(describe.group_summary(orders_frame(spark, d), ORDER_FEATURES))


@query
def e4_e5_shape(spark, d):
    return tidy(describe.shape(orders_frame(spark, d), ORDER_FEATURES))


@query
def e5_pearson_kurtosis(spark, d):
    return tidy(describe.shape(events_frame(spark, d), EVENT_FEATURES, pearson=True))


@query
def e6_class_counts(spark, d):
    return frame.class_counts(orders_frame(spark, d))


@query
def e7_levels(spark, d):
    return frame.levels(events_frame(spark, d), "hour")


@query
def e8_histogram(spark, d):
    return tidy(describe.histogram(orders_frame(spark, d), ["price", "balance", "lines"], bins=30))


@query
def e9_box_statistics(spark, d):
    return tidy(describe.box_statistics(tables.stored(orders_frame(spark, d)), ORDER_FEATURES))


@query
def e9_box_outliers(spark, d):
    return tidy(describe.box_outliers(events_frame(spark, d), EVENT_FEATURES))


@query
def e10_density(spark, d):
    df = impute.standardize(orders_frame(spark, d), ["price"])
    return tidy(describe.density(df, "price", ["yd"]))


@query
def e10_density_epanechnikov(spark, d):
    df = impute.standardize(orders_frame(spark, d), ["quantity"])
    return tidy(describe.density(df, "quantity", ["yd"], kernel="epanechnikov"))


# ---------------------------------------------------------------- tests


@query
def f1_shapiro_wilk(spark, d):
    return tidy(hypothesis.shapiro_wilk(quality_frame(spark, d), ["k_chars", "word_density"]))


@query
def f1_shapiro_wilk_large(spark, d):
    return tidy(hypothesis.shapiro_wilk(tables.stored(orders_frame(spark, d)), ORDER_FEATURES))


@query
def f2_bartlett(spark, d):
    return tidy(hypothesis.bartlett(orders_frame(spark, d), ORDER_FEATURES))


@query
def f3_levene(spark, d):
    return tidy(hypothesis.levene(tables.stored(orders_frame(spark, d)), ORDER_FEATURES))


@query
def f3_levene_mean(spark, d):
    return tidy(hypothesis.levene(orders_frame(spark, d), ORDER_FEATURES, center="mean"))


@query
def f4_f5_variance_homogeneity(spark, d):
    df = tables.stored(quality_frame(spark, d))
    return tidy(placed(hypothesis.variance_homogeneity(df, ["k_chars", "word_density"], digits=None)))


@query
def f4_f5_variance_homogeneity_large(spark, d):
    df = tables.stored(orders_frame(spark, d))
    return tidy(placed(hypothesis.variance_homogeneity(df, ORDER_FEATURES, digits=None)))


@query
def f6_pooled_t(spark, d):
    return tidy(hypothesis.equal_means(orders_frame(spark, d), ORDER_FEATURES, equal_var_cols=ORDER_FEATURES))


@query
def f7_welch_t(spark, d):
    return tidy(hypothesis.equal_means(orders_frame(spark, d), ORDER_FEATURES))


@query
def f8_equal_means(spark, d):
    return tidy(hypothesis.equal_means(
        quality_frame(spark, d), QUALITY_FEATURES, equal_var_cols=["k_chars", "toxic"]
    ))


@query
def f9_split_balance(spark, d):
    df = tables.stored(sampling.random_split(orders_frame(spark, d), 0.25, "yd"))
    return tidy(hypothesis.split_balance(df, ["price", "balance", "quantity", "lines"]))


@query
def f10_point_biserial(spark, d):
    return tidy(hypothesis.point_biserial(quality_frame(spark, d), QUALITY_FEATURES))


@query
def f10_point_biserial_train(spark, d):
    """Minimum slice: complete cases, index, odd rows, correlation table."""
    df = study.split_complete_rows(
        events_frame(spark, d).withColumnRenamed("id", "row_key"), ["yd", "value"], "row_key"
    )
    return tidy(hypothesis.point_biserial(df.where("dumVE = 0"), EVENT_FEATURES))


@query
def f11_equivalence(spark, d):
    return tidy(association.equivalence_check(quality_frame(spark, d), "word_density"))


# ---------------------------------------------------------------- correlation


@query
def g1_strong_pairs(spark, d):
    return tidy(association.strong_pairs(orders_frame(spark, d), ORDER_FEATURES))


@query
def g2_correlation_pairs(spark, d):
    return tidy(association.correlation_pairs(orders_frame(spark, d), [*ORDER_FEATURES, "yd"]))


@query
def g2_correlation_matrix(spark, d):
    return tidy(association.correlation_matrix(events_frame(spark, d), EVENT_FEATURES))


@query
def g3_lower_triangle(spark, d):
    return tidy(association.lower_triangle(orders_frame(spark, d), ORDER_FEATURES))


@query
def g4_strong_columns(spark, d):
    return association.strong_columns(orders_frame(spark, d), ORDER_FEATURES)


@query
def g5_pair_lines(spark, d):
    return tidy(association.pair_lines(orders_frame(spark, d), ORDER_FEATURES))


# ---------------------------------------------------------------- regression


@query
def h1_ols(spark, d):
    df = orders_frame(spark, d)
    return tidy(regression.ols(df, ["quantity", "lines"], "price").table(spark).drop("ci_low", "ci_high"))


@query
def h2_logit(spark, d):
    return tidy(regression.logit(quality_frame(spark, d), ["word_density"]).table(spark), 5)


@query
def h2_logit_four_features(spark, d):
    """The whole coefficient table of a fit on four features."""
    return tidy(regression.logit(tables.stored(orders_frame(spark, d)), ORDER_FEATURES[:4]).table(spark), 4)


@query
def h3_probit_four_features(spark, d):
    return tidy(regression.probit(tables.stored(orders_frame(spark, d)), ORDER_FEATURES[:4]).table(spark), 4)


@query
def h3_probit(spark, d):
    return tidy(regression.probit(quality_frame(spark, d), ["word_density"]).table(spark), 5)


@query
def h3_probit_expected(spark, d):
    fit = regression.probit(quality_frame(spark, d), ["word_density"], information="expected")
    return tidy(fit.table(spark), 5)


@query
def h4_coefficients(spark, d):
    _, fits, _ = scored_quality(spark, d)
    return tidy(regression.coefficient_table(spark, fits).select("model", "term", "coef", "std_err"), 5)


@query
def h5_ols_summary(spark, d):
    df = tables.stored(orders_frame(spark, d))
    return tidy(regression.fit_summary(df, regression.ols(df, ["quantity", "lines"], "price")), 4)


@query
def h6_h7_binary_summary(spark, d):
    df = tables.stored(quality_frame(spark, d))
    fits = [regression.logit(df, ["word_density"]), regression.probit(df, ["word_density"])]
    table = fits[0].summary(spark).unionByName(fits[1].summary(spark))
    return tidy(table.where(~F.col("measure").isin("iterations", "lr_p_value", "converged")), 5)


@query
def h8_predictions(spark, d):
    df = tables.stored(orders_frame(spark, d))
    return tidy(regression.logit(df, ["price"]).transform(df, "p").select("id", "p"))


@query
def h9_scores(spark, d):
    return tidy(scored_quality(spark, d)[2], 5)


@query
def h10_comparison(spark, d):
    df, fits, _ = scored_quality(spark, d)
    return regression.comparison_table(df, fits)


@query
def h11_validation_refit(spark, d):
    """Same formula on the other sample, with the AUC of both fits on their own rows."""
    df = study.split_complete_rows(
        quality_frame(spark, d).withColumnRenamed("id", "row_key"), ["yd", "k_chars"], "row_key"
    )
    parts = []
    for sample, name in ((0, "train"), (1, "valid")):
        rows = df.where(F.col("dumVE") == sample)
        fit = regression.logit(rows, ["word_density"])
        area = evaluate.auc(fit.transform(rows, "p"), "p")
        parts.append(area.select(
            F.lit(name).alias("sample"), F.lit(float(fit.coef[0])).alias("b0"),
            F.lit(float(fit.coef[1])).alias("b1"), "auc",
        ))
    return tidy(parts[0].unionByName(parts[1]), 5)


@query
def h12_leverage(spark, d):
    df, cut, _ = regression.leverage(orders_frame(spark, d), ORDER_FEATURES)
    return tidy(df.select("id", (F.col("leverage") * 1000).alias("leverage"), "high_leverage"))


@query
def h13_pearson_residuals(spark, d):
    df = tables.stored(orders_frame(spark, d))
    p = regression.logit(df, ["price"]).transform(df, "p")
    return tidy(p.select("id", standardized_residual("yd", "p").alias("residual")))


@query
def h14_residual_table(spark, d):
    return tidy(regression.residual_table(scored_quality(spark, d)[2]), 4)


@query
def h14_outliers(spark, d):
    table = regression.residual_table(scored_quality(spark, d)[2])
    return tidy(regression.outliers(table, " logit").select("id", "y", "residual"), 4)


@query
def h15_dummy_trap(spark, d):
    df = frame.with_complement(tables.stored(quality_frame(spark, d)))
    full = regression.ols(df, ["yd", "ynd"], "word_density", "minimum norm")
    less = regression.ols(df, ["yd", "ynd"], "word_density", "dropped", drop_collinear=True)
    table = regression.coefficient_table(spark, [full, less])
    return tidy(table.select("model", "term", "coef"))


@query
def h16_contrast_regression(spark, d):
    df = frame.with_complement(quality_frame(spark, d))
    return tidy(regression.ols(df, ["z"], "word_density").table(spark).select("term", "coef", "std_err"))


@query
def h17_gaussian_fit(spark, d):
    """Identity link, Gaussian errors: least squares estimates with the log-likelihood."""
    fit = regression.ols(events_frame(spark, d), ["k", "hour"], "value", "Gaussian")
    return tidy(fit.table(spark).select("term", "coef", F.lit(fit.loglik).alias("loglik")), 5)


@query
def h18_constrained_fit(spark, d):
    df = frame.with_complement(quality_frame(spark, d))
    fit = regression.constrained_ols(df, ["yd", "ynd"], "word_density", [{"yd": 1.0, "ynd": 1.0}])
    return tidy(fit.table(spark).select("term", "coef"))


@query
def h19_linear_hypothesis(spark, d):
    df = tables.stored(orders_frame(spark, d))
    return tidy(regression.linear_hypothesis(
        df, ["quantity", "lines"], "price", [{"quantity": 1.0}, {"lines": 1.0}]
    ))


# ---------------------------------------------------------------- preprocessing and selection


@query
def i1_standardize(spark, d):
    return tidy(impute.standardize(orders_frame(spark, d), ORDER_FEATURES))


@query
def i2_knn_events(spark, d):
    return tidy(impute.knn_impute(tables.stored(events_frame(spark, d)), EVENT_FEATURES))


@query
def i3_knn_orders(spark, d):
    return tidy(impute.knn_impute(tables.stored(orders_frame(spark, d)), ORDER_FEATURES))


@query
def i4_one_hot(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    customers = frames.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    # Learned without one segment, which then counts as unseen.
    seen = customers.where(F.col("c_mktsegment") != "MACHINERY")
    stages = classifiers.preprocessor(seen, ["c_mktsegment"])
    coded = Pipeline(stages=stages).fit(seen).transform(customers)
    x = vector_to_array(classifiers.VECTOR)
    return coded.select(
        "c_custkey", F.size(x).alias("width"),
        F.aggregate(x, F.lit(0.0), lambda a, b: a + b).cast("int").alias("hot"),
    )


@query
def i5_preprocessor(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    customers = frames.table(spark, d, "customer")
    stages = classifiers.preprocessor(customers, ["c_acctbal", "c_mktsegment"])
    x = vector_to_array(classifiers.VECTOR)
    coded = Pipeline(stages=stages).fit(customers).transform(customers)
    return tidy(coded.select("c_custkey", x[0].alias("scaled"), F.size(x).alias("width")))


@query
def i6_class_weights(spark, d):
    df, total = classifiers.balanced(orders_frame(spark, d), "yd")
    return tidy(df.groupBy("yd").agg(F.max("_w").alias("weight"), F.sum("_w").alias("total")))


def quality_split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = tables.stored(sampling.random_split(quality_frame(spark, d), 0.25, "yd"))
    return df.where("in_test = 0"), df.where("in_test = 1")


def fitted_scores(spark, d, estimator, features) -> DataFrame:
    train, test = quality_split(spark, d)
    model = classifiers.pipeline(train, features, estimator).fit(train)
    return model.transform(test).select("id", "score", F.col("prediction").cast("int").alias("said"))


@query
def i7_penalized_logit(spark, d):
    return tidy(fitted_scores(spark, d, classifiers.PenalizedLogit(C=1.0), ["word_density"]), 4)


@query
def i8_probit_estimator(spark, d):
    return tidy(fitted_scores(spark, d, classifiers.Probit(), ["word_density"]), 4)


@query
def i9_linear_probability(spark, d):
    return tidy(fitted_scores(spark, d, classifiers.LinearProbability(), ["k_chars", "word_density"]))


@query
def i10_ridge(spark, d):
    return tidy(fitted_scores(spark, d, classifiers.Ridge(alpha=3.0), ["word_density"]))


@query
def i11_forest(spark, d):
    return fitted_scores(spark, d, classifiers.Forest(trees=600, depth=5, leaf=2), QUALITY_FEATURES)


@query
def i12_boosting(spark, d):
    return fitted_scores(
        spark, d, classifiers.Boosting(rate=0.1, depth=3, rounds=100), QUALITY_FEATURES
    )


#: Folds of the model comparison.
FOLDS = 5
SEARCHES: dict[tuple, selection.Search] = {}
FORESTS, BOOSTING = ({n: selection.TREE_GRIDS[n]} for n in ("rf", "hgb"))


def quality_search(spark: SparkSession, d: str, grids: dict = selection.LINEAR_GRIDS) -> selection.Search:
    """The search over whole grids on the quality frame; queries of one session read one search."""
    key = (spark.sparkContext.applicationId, d, *grids)
    if key not in SEARCHES:
        train, test = quality_split(spark, d)
        SEARCHES[key] = selection.search_models(train, test, QUALITY_FEATURES, k=FOLDS, grids=grids)
    return SEARCHES[key]


def settings_text(params: dict[str, str]) -> str:
    return ",".join(f"{k}={v}" for k, v in params.items())


def grid_table(spark: SparkSession, search: selection.Search) -> DataFrame:
    rows = [(model, settings_text(params), accuracy, best) for model, params, accuracy, best in search.grid]
    return tidy(spark.createDataFrame(rows, "model string, settings string, accuracy double, best boolean"))


def leaderboard_table(search: selection.Search) -> DataFrame:
    text = F.array_join(F.transform(F.map_entries("best_params"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return tidy(selection.leaderboard(search).withColumn("best_params", text))


@query
def i13_grid_search(spark, d):
    """Every setting of the linear families with its accuracy over the folds."""
    return grid_table(spark, quality_search(spark, d))


@query
def i13_forest_grid_search(spark, d):
    """Every setting of the forests with its accuracy over the folds."""
    return grid_table(spark, quality_search(spark, d, FORESTS))


@query
def i13_boosting_grid_search(spark, d):
    return grid_table(spark, quality_search(spark, d, BOOSTING))


@query
def i14_i15_out_of_fold_auc(spark, d):
    """Linear probability scores of unseen folds, AUC per fold."""
    train, _ = quality_split(spark, d)
    folded = tables.stored(sampling.stratified_folds(train.select("id", "yd", "word_density"), 3))
    search = selection.linear_search(folded, None, ["word_density"], k=3, grids={"ols": classifiers.GRIDS["ols"]})
    return tidy(selection.fold_aucs(search).select("fold", "auc"))


@query
def i15_cross_validated_auc(spark, d):
    """AUC of the unseen rows of five folds, for every linear family at its best setting."""
    return tidy(selection.fold_aucs(quality_search(spark, d)))


@query
def i15_forest_cross_validated_auc(spark, d):
    return tidy(selection.fold_aucs(quality_search(spark, d, FORESTS)))


@query
def i16_train_test_auc(spark, d):
    _, scores = study.holdout_scores(tables.stored(quality_frame(spark, d)), ["word_density"])
    return tidy(evaluate.auc(scores, "score_logit", "yd", ["in_test"]))


@query
def i17_leaderboard(spark, d):
    return leaderboard_table(quality_search(spark, d))


@query
def i17_forest_leaderboard(spark, d):
    return leaderboard_table(quality_search(spark, d, FORESTS))


@query
def i17_boosting_leaderboard(spark, d):
    return leaderboard_table(quality_search(spark, d, BOOSTING))


def both_splits(spark: SparkSession, d: str, grids: dict) -> DataFrame:
    df = tables.stored(sampling.systematic_split(
        quality_frame(spark, d).withColumnRenamed("id", "row_key"), ["yd", "k_chars"], "row_key"
    ))
    return tidy(selection.compare_splits(df, QUALITY_FEATURES, k=FOLDS, grids=grids))


@query
def i18_split_comparison(spark, d):
    return both_splits(spark, d, selection.LINEAR_GRIDS)


@query
def i18_forest_split_comparison(spark, d):
    return both_splits(spark, d, FORESTS)


@query
def i19_model_rocs(spark, d):
    return tidy(selection.model_rocs(quality_search(spark, d)))


@query
def i19_forest_rocs(spark, d):
    return tidy(selection.model_rocs(quality_search(spark, d, FORESTS)))


# ---------------------------------------------------------------- evaluation


@query
def j1_auc(spark, d):
    scores = frame.long_form(orders_frame(spark, d), ["id", "yd"], ORDER_FEATURES, "model", "score")
    return tidy(evaluate.auc(scores, "score", "yd", ["model"]))


@query
def j2_roc_curve(spark, d):
    return tidy(evaluate.roc_curve(events_frame(spark, d), "k"))


@query
def j2_roc_curve_full(spark, d):
    df = tables.stored(events_frame(spark, d).select("yd", "value"))
    return tidy(evaluate.roc_curve(df, "value", prune=False))


@query
def j3_roc_area(spark, d):
    df = tables.stored(events_frame(spark, d).select("yd", "value"))
    return tidy(evaluate.trapezoid_area(evaluate.roc_curve(df, "value")))


@query
def j4_concordance(spark, d):
    scores = frame.long_form(events_frame(spark, d), ["id", "yd"], EVENT_FEATURES, "model", "score")
    return tidy(evaluate.concordance(scores, "score", "yd", ["model"]))


@query
def j5_concordance_check(spark, d):
    return tidy(evaluate.concordance_check(orders_frame(spark, d), "price"))


@query
def j6_one_class_auc(spark, d):
    return tidy(evaluate.auc(events_frame(spark, d).where("yd = 1"), "value", "yd", ["hour"]))


def share_score() -> Column:
    return 1 - F.exp(-F.col("value") / 200)


@query
def j7_j8_confusion(spark, d):
    df = events_frame(spark, d).withColumn("score", share_score())
    return tidy(evaluate.confusion(df, "score", 0.25))


@query
def j9_j11_cutoffs(spark, d):
    df = tables.stored(events_frame(spark, d).withColumn("score", share_score()))
    return tidy(evaluate.empirical_cutoff(df, "score"))


@query
def j10_cost_curve(spark, d):
    df = events_frame(spark, d).withColumn("score", F.col("k") / 100)
    return tidy(evaluate.cost_curve(df, "score"))


@query
def j10_cheapest_cutoffs(spark, d):
    df = events_frame(spark, d).withColumn("score", F.col("k") / 100)
    return tidy(evaluate.cheapest_cutoffs(evaluate.cost_curve(df, "score", cost_fn=4.0)))


@query
def study_refit(spark, d):
    """Whole first study on orders: complete rows, split, fits, refit, residual outliers per model."""
    indexed = study.split_complete_rows(
        orders_frame(spark, d).withColumnRenamed("id", "row_key"), ["yd", "price"], "row_key"
    )
    result = study.refit_study(indexed, ["price", "quantity"])
    return result["residuals"].groupBy("model").agg(
        F.count("*").alias("n"), F.count_if("outlier").alias("n_outliers")
    )


@query
def study_holdout(spark, d):
    """Whole third study on orders: impute, random split, fits, train and test AUC."""
    df = tables.stored(orders_frame(spark, d))
    return study.holdout_study(df, ["price", "quantity"], impute=ORDER_FEATURES)["auc"]


@query
def study_comparison(spark, d):
    """Whole second study on document quality: split, impute, the linear families under both splits.

    The forests of both splits are `i18_forest_split_comparison`.
    """
    df = quality_frame(spark, d).withColumnRenamed("id", "row_key")
    return tidy(study.comparison_study(
        tables.stored(df), QUALITY_FEATURES, ["yd", "k_chars"], "row_key", k=FOLDS, grids=selection.LINEAR_GRIDS
    ))
