import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import manyfits
from riskloom.operators.evaluate import auc
from riskloom.operators.regression import probit
from riskloom.operators.sampling import random_split, stratified_folds
from riskloom.plans import catalog, classifiers, selection
from riskloom.sources.tables import stored


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=240) > 0.3).astype(int)
    rows = [(i, int(t), float(a), float(b), "uvw"[i % 3]) for i, (t, (a, b)) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, yd int, p double, q double, kind string").coalesce(2).cache()


def matrices(df):
    rows = df.orderBy("id").collect()
    x = np.array([[r["p"], r["q"]] for r in rows])
    y = np.array([r["yd"] for r in rows], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    return (x - x.mean(0)) / x.std(0), y, w


def test_penalized_logit_matches_newton(cases):
    x, y, w = matrices(cases)
    design, b = np.c_[np.ones(len(x)), x], np.zeros(3)
    penalty = np.diag([0, 2.0, 2.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ b))
        b -= np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + penalty,
                             design.T @ (w * (p - y)) + penalty @ b)
    model = classifiers.pipeline(cases, ["p", "q"], classifiers.PenalizedLogit(C=0.5)).fit(cases)
    inner = model.stages[-1].inner
    assert [inner.intercept, *inner.coefficients] == pytest.approx(list(b), abs=1e-5)


def test_ridge_matches_closed_form(cases):
    x, y, w = matrices(cases)
    t = 2 * y - 1
    centred = x - (w[:, None] * x).sum(0) / w.sum()
    b = np.linalg.solve((centred * w[:, None]).T @ centred + 3 * np.eye(2),
                        (centred * w[:, None]).T @ (t - (w * t).sum() / w.sum()))
    model = classifiers.pipeline(cases, ["p", "q"], classifiers.Ridge(alpha=3.0)).fit(cases)
    assert list(model.stages[-1].inner.coefficients) == pytest.approx(list(b), abs=1e-8)


def test_unseen_text_is_all_zeros(cases):
    from pyspark.ml import Pipeline

    stages = classifiers.preprocessor(cases, ["p", "kind"])
    fitted = Pipeline(stages=stages).fit(cases.where("kind != 'w'"))
    row = fitted.transform(cases.where("kind = 'w'")).first()[classifiers.VECTOR]
    assert len(row) == 3 and list(row)[1:] == [0.0, 0.0]


def test_trees_beat_a_floor(cases):
    for estimator in (classifiers.Forest(trees=10, depth=4, leaf=2),
                      classifiers.Boosting(rate=0.2, depth=2, rounds=5)):
        scored = classifiers.pipeline(cases, ["p", "q"], estimator).fit(cases).transform(cases)
        assert auc(scored, "score").first()["auc"] > 0.85


def test_leaderboard_and_rocs(cases):
    split = random_split(cases, 0.25, "yd")
    train, test = split.where("in_test = 0"), split.where("in_test = 1")
    grids = {"ols": classifiers.GRIDS["ols"], "ridge": (classifiers.Ridge, {"alpha": [0.5, 3.0]}, {})}
    board, search = selection.compare_models(train, test, ["p", "q"], k=2, grids=grids)
    rows = board.collect()
    assert [r["model"] for r in rows] and rows[0]["test_auc"] >= rows[1]["test_auc"]
    assert all(0.8 < r["cv_auc"] <= 1 for r in rows)
    assert {r["model"]: set(r["best_params"]) for r in rows} == {"ols": set(), "ridge": {"alpha"}}
    curves = selection.model_rocs(search)
    best = {r["model"]: r["auc"] for r in curves.select("model", "auc").distinct().collect()}
    assert best == pytest.approx({r["model"]: r["test_auc"] for r in rows})


def test_one_class_fold_is_left_out(cases):
    folded = stratified_folds(cases, 2).withColumn("fold", F.when(F.col("yd") == 1, 0).otherwise(F.col("fold")))
    scores = folded.withColumn("score", F.col("p"))
    per_fold = {r["fold"]: r["auc"] for r in auc(scores, "score", "yd", ["fold"]).collect()}
    assert per_fold[1] is None and per_fold[0] is not None


#: The axes of GRIDS with fewer and smaller settings.
SMALL_GRIDS = {
    "logreg": (classifiers.PenalizedLogit, {"C": [0.1, 1.0]}, {}),
    "probit": (classifiers.Probit, {}, {}),
    "ols": (classifiers.LinearProbability, {}, {}),
    "ridge": (classifiers.Ridge, {"alpha": [0.5, 3.0]}, {}),
    "rf": (classifiers.Forest, {"trees": [3, 5], "depth": [2], "leaf": [2]}, {}),
    "hgb": (classifiers.Boosting, {"rate": [0.1], "depth": [2, 3]}, {"rounds": 2}),
}


@pytest.mark.parametrize("name", ["rf", "hgb"])
def test_trees_on_a_small_grid(cases, name):
    assert {n: (k, set(g), set(f)) for n, (k, g, f) in SMALL_GRIDS.items()} == {
        n: (k, set(g), set(f)) for n, (k, g, f) in classifiers.GRIDS.items()}
    folded, held = stored(stratified_folds(cases, 2)), cases.where("id % 10 = 0")
    search = selection.tree_search(folded, held, ["p", "q", "kind"], k=2, grids={name: SMALL_GRIDS[name]})
    assert set(search.params[name]) == set(SMALL_GRIDS[name][1])
    assert len(search.grid) == 2 and sum(best for *_, best in search.grid) == 1
    assert {r["sample"]: r["count"] for r in search.scores.groupBy("sample").count().collect()} == {
        "cv": 240, "train": 240, "test": 24}


def test_a_cut_forest_is_the_forest_of_its_first_trees_and_upper_nodes(spark, cases):
    from pyspark.ml import Pipeline

    stages = classifiers.preprocessor(cases, ["p", "q", "kind"])
    rows = Pipeline(stages=stages).fit(cases).transform(cases)
    model = classifiers.Forest(trees=6, depth=5, leaf=2).fit(rows)
    nodes = selection.forest_nodes(spark, model.inner)
    x = np.array([r[0].toArray() for r in rows.orderBy("id").select(classifiers.VECTOR).collect()])
    own = [r[0] for r in model.transform(rows).orderBy("id").select("score").collect()]
    settings = nodes.probabilities(x, [2, 6], [0, 3, 5])
    assert settings[:, 5] == pytest.approx(own)  # six trees, whole depth

    def share(at, row, depth):
        if depth == 0 or nodes.feature[at] < 0:
            return nodes.share[at]
        value, side = row[nodes.feature[at]], nodes.sides[at]
        left = value <= nodes.threshold[at] if np.isnan(side[0]) else bool(side[int(value)])
        return share(nodes.left[at] if left else nodes.right[at], row, depth - 1)

    for j, (trees, depth) in enumerate([(2, 0), (2, 3), (2, 5), (6, 0), (6, 3), (6, 5)]):
        want = [np.mean([share(root, row, depth) for root in nodes.first[:trees]]) for row in x]
        assert settings[:, j] == pytest.approx(want)


LINEAR_SETTINGS = {"logreg": [0.1, 3.0], "probit": [None], "ols": [None], "ridge": [0.5, 10.0]}


def test_many_fits_equal_single_ones(cases):
    """Each fit from the shared scans against the estimator on the rows it learns from."""
    features = ["p", "q", "kind"]
    folded = stored(stratified_folds(cases, 3))
    plan = manyfits.design(folded, features)
    fits = manyfits.many_fits(plan, LINEAR_SETTINGS, k=3)
    assert len(fits) == 6 * 4 and all(f.settled for f in fits)
    scores = {(r[0], r[1], r[2], r[3]): r[4] for r in manyfits.scores(plan, fits).select(
        "family", "setting", "fold", "_key", "score").collect()}
    kinds = {"logreg": lambda v: classifiers.PenalizedLogit(C=v), "ridge": lambda v: classifiers.Ridge(alpha=v),
             "ols": lambda v: classifiers.LinearProbability()}
    for fold in (0, 2):
        train, rest = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        for family, values in LINEAR_SETTINGS.items():
            for value in values if family in kinds else ():
                model = classifiers.pipeline(train, features, kinds[family](value)).fit(train)
                for r in model.transform(rest).select("id", "score").collect():
                    assert scores[family, value, fold, r["id"]] == pytest.approx(r["score"], abs=1e-5), family


def test_many_probits_equal_the_generalised_linear_model(cases):
    folded = stored(stratified_folds(cases, 2))
    plan = manyfits.design(folded, ["p", "q"])
    fits = [f for f in manyfits.many_fits(plan, {"probit": [None]}, k=2) if f.fold == -1]
    fit = probit(cases, ["p", "q"])
    scored = {r["_key"]: r["score"] for r in manyfits.scores(plan, fits, plan.rows).collect()}
    for r in fit.transform(cases, "p_hat").select("id", "p_hat").collect():
        assert scored[r["id"]] == pytest.approx(r["p_hat"], abs=1e-7)


def test_separated_classes_do_not_settle_and_missing_cells_take_the_mean(spark):
    rows = [(i, int(i > 10), None if i == 3 else float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, yd int, x double")
    plan = manyfits.design(stored(stratified_folds(df, 2)), ["x"])
    fits = {(f.family, f.fold): f for f in manyfits.many_fits(plan, {"probit": [None], "logreg": [1.0]}, k=2)}
    assert not fits["probit", -1].settled and fits["logreg", -1].settled
    at = [r["_x"] for r in plan.rows.where("_key = 3").collect()]
    assert at == [[0.0]]


def test_queries_use_the_whole_grids(spark, monkeypatch):
    seen, held = [], {}

    def search(train, valid, features, target="yd", key="id", k=5, grids=classifiers.GRIDS, parallelism=2):
        seen.append((k, grids))
        scores = spark.createDataFrame([], "model string, sample string, fold int, id long, yd int, score double")
        return selection.Search({n: {} for n in grids}, scores)

    def scores(spark, d, estimator, features):
        held.update({p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.isDefined(p)})

    assert {**selection.LINEAR_GRIDS, **selection.TREE_GRIDS} == classifiers.GRIDS
    monkeypatch.setattr(selection, "search_models", search)
    monkeypatch.setattr(catalog, "fitted_scores", scores)
    monkeypatch.setattr(catalog, "SEARCHES", {})
    for query in ("i13_grid_search", "i15_cross_validated_auc", "i17_leaderboard", "i19_model_rocs"):
        catalog.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert seen == [(5, selection.LINEAR_GRIDS)]  # one search for all four
    for query in ("i13_forest_grid_search", "i15_forest_cross_validated_auc", "i17_forest_leaderboard",
                  "i19_forest_rocs", "i13_boosting_grid_search", "i17_boosting_leaderboard"):
        catalog.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert seen[1:] == [(5, catalog.FORESTS), (5, catalog.BOOSTING)]
    assert {**catalog.FORESTS, **catalog.BOOSTING} == selection.TREE_GRIDS
    for query, grids in (("i18_split_comparison", selection.LINEAR_GRIDS),
                         ("i18_forest_split_comparison", catalog.FORESTS),
                         ("study_comparison", selection.LINEAR_GRIDS)):
        seen.clear()
        catalog.QUERIES[query](spark, "/root/testdata/sf0.001")
        assert seen == [(5, grids)] * 2, query
    catalog.QUERIES["i11_forest"](spark, "")
    catalog.QUERIES["i12_boosting"](spark, "")
    assert held["trees"] == 600 and held["rounds"] == 100
