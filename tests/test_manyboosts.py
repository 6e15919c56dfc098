import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import manyboosts
from riskloom.operators.evaluate import auc
from riskloom.operators.sampling import stratified_folds
from riskloom.plans import classifiers, selection
from riskloom.sources.tables import stored

FEATURES = ["p", "q", "flag", "kind"]


@pytest.fixture(scope="module")
def folded(spark):
    """A smooth column, one of few values, a yes/no one and texts."""
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=400), np.round(rng.normal(size=400), 1)
    y = (1.5 * p - q + rng.normal(size=400) > 0.3).astype(int)
    rows = [(i, int(t), float(a), float(b), float(i % 5 == 0), "uvw"[i % 3]) for i, (t, a, b) in enumerate(zip(y, p, q))]
    df = spark.createDataFrame(rows, "id long, yd int, p double, q double, flag double, kind string").coalesce(2)
    return stored(stratified_folds(df, 2))


def grids(rounds, depths=(2, 5)):
    return {"hgb": (classifiers.Boosting, {"rate": [0.1, 0.4], "depth": list(depths)}, {"rounds": rounds})}


def scores(search):
    return {(r["sample"], r["fold"], r["id"]): r["score"] for r in search.scores.collect()}


def test_borders():
    assert list(manyboosts.column_borders(np.array([2.0, 1.0, 5.0, 1.0]))) == [1.5, 3.5]
    assert len(manyboosts.column_borders(np.ones(9))) == 0 and len(manyboosts.column_borders(np.array([]))) == 0
    assert manyboosts.column_borders(np.arange(3200.0)) == pytest.approx(np.arange(1, 32) * 100 - 0.5)
    heavy = np.r_[np.zeros(960), np.arange(1.0, 65.0)]  # a stride of 32: the goals inside the zeros are missed
    assert list(manyboosts.column_borders(heavy)) == [*(x + 0.5 for x in range(30)), 32.5]


def test_borders_come_from_the_rows_outside_the_fold(spark, monkeypatch):
    rows = spark.createDataFrame([(None, i % 2, float(i)) for i in range(40)], "id long, fold int, x double")
    vectors = VectorAssembler(inputCols=["x"], outputCol="v").transform(rows)
    cuts = manyboosts.borders(vectors, "v", "id", [0, -1])
    assert list(cuts[0][0]) == [2.0 * i + 2 for i in range(19)] and len(cuts[-1][0]) in range(20, 32)
    monkeypatch.setattr(manyboosts, "SAMPLE", 20)
    few = manyboosts.borders(vectors, "v", "id", [-1])[-1][0]
    assert len(few) in range(5, 31)  # keys say nothing here
    other = VectorAssembler(inputCols=["x"], outputCol="v").transform(rows.withColumn("x", F.col("x") * (1 + 1e-14)))
    assert list(manyboosts.borders(other, "v", "id", [-1])[-1][0]) == pytest.approx(list(few))
    monkeypatch.setattr(manyboosts, "SAMPLE", 0)
    assert [len(c) for c in manyboosts.borders(vectors, "v", "id", [-1])[-1]] == [0]


@pytest.mark.parametrize("parts", [1, 5])
def test_fits_equal_those_of_spark(folded, parts):
    """For every setting and fold, however the rows are stored."""
    prepared = Pipeline(stages=classifiers.preprocessor(folded, FEATURES)).fit(folded).transform(folded)
    rows = stored(prepared.select("id", "yd", "fold", classifiers.VECTOR).repartition(parts))
    kind, grid, fixed = grids(4)["hgb"]
    settings = selection.settings_of(grid)
    wanted = [(1, 0), (2, 1), (3, 0), (3, -1)]
    grown = selection.boosted_fits(rows, rows.drop("fold").limit(50), "hgb", fixed, settings, wanted, "yd", "id")
    found = {(r["setting"], r["fold"], r["id"]): r["score"] for r in selection.stack(grown).collect()}
    sizes = {r[0]: r[1] for r in rows.groupBy("fold").count().collect()}
    assert len(found) == sum(sizes.get(fold, 400 + 50) for _, fold in wanted)
    for place, fold in wanted:
        model = kind(**fixed, **settings[place]).fit(rows.where(F.col("fold") != fold))
        for r in model.transform(rows.where((F.col("fold") == fold) | F.lit(fold < 0))).collect():
            assert found[place, fold, r["id"]] == pytest.approx(r["score"], abs=1e-9)


def test_rounds_and_settings_of_a_search_share_its_jobs(spark, folded):
    """Every level of every round of every fit had jobs of its own."""
    def jobs(name, wanted):
        spark.sparkContext.setJobGroup(name, "")
        search = selection.tree_search(folded, None, FEATURES, k=2, grids=wanted)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert search.sample("cv").count() == search.sample("train").count() == 400
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few = jobs("few", grids(1, [1]))
    assert jobs("many", grids(30, [2, 5, 8])) <= few + 2 and few < 60


def test_cells_too_many_for_a_task_are_fitted_by_spark(folded, monkeypatch):
    one = {"hgb": (classifiers.Boosting, {"rate": [0.3], "depth": [3]}, {"rounds": 3})}
    whole = selection.tree_search(folded, folded, FEATURES, k=2, grids=one)
    monkeypatch.setattr(manyboosts, "TASK_BINS", 10)
    dealt = selection.tree_search(folded, folded, FEATURES, k=2, grids=one)
    assert scores(dealt) == pytest.approx(scores(whole), abs=1e-9) and dealt.params == whole.params
    assert auc(whole.sample("cv"), "score").first()["auc"] > 0.8


def test_a_leaderboard_equals_that_of_spark_in_few_jobs(spark, folded, monkeypatch):
    one = {"hgb": (classifiers.Boosting, {"rate": [0.2], "depth": [2]}, {"rounds": 12})}
    parts = [stored(folded.drop("fold").where(c)) for c in ("id % 4 > 0", "id % 4 = 0")]

    def board(name):
        spark.sparkContext.setJobGroup(name, "")
        rows = [tuple(r) for r in selection.compare_models(*parts, ["p", "q"], k=2, grids=one)[0].collect()]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    whole, few = board("whole")
    monkeypatch.setattr(manyboosts, "TASK_BINS", 10)
    dealt, many = board("dealt")
    assert few < 80 < many
    assert len(whole) == len(dealt) == 1 and whole[0][1:4] == pytest.approx(dealt[0][1:4])
    assert whole[0][0] == "hgb" and whole[0][4] == dealt[0][4] and 0.8 < whole[0][1] < whole[0][2] <= 1


def test_a_target_of_other_values_is_an_error(folded):
    with pytest.raises(Exception, match="0 or 1"):
        selection.tree_search(folded.withColumn("yd", F.col("yd") + 1), None, ["p"], k=2, grids=grids(1, [1]))
