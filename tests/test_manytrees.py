import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from riskloom.operators import manytrees
from riskloom.operators.sampling import stratified_folds
from riskloom.plans import classifiers, selection
from riskloom.sources.tables import stored


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x @ [1.5, -1.0, 0.3] + rng.normal(size=300) > 0.4).astype(int)
    rows = [(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, yd int, p double, q double, r double").coalesce(2)
    folds = stratified_folds(df, 2)
    stages = classifiers.preprocessor(folds, ["p", "q", "r"])
    return stored(Pipeline(stages=stages).fit(folds).transform(folds).select("id", "yd", "fold", classifiers.VECTOR))


def binned(folded):
    cuts = manytrees.borders(folded, classifiers.VECTOR, "yd", "id")
    return stored(manytrees.with_bins(folded, classifiers.VECTOR, cuts)), cuts


def test_borders():
    few = manytrees.column_borders(np.array([2.0, 1.0, 5.0, 1.0]), np.ones(4))
    assert list(few) == [1.5, 3.5] and len(manytrees.column_borders(np.ones(9), np.ones(9))) == 0
    many = manytrees.column_borders(np.arange(3200.0), np.ones(3200))
    assert many == pytest.approx(np.arange(1, 32) * 100 - 0.5)


def test_draws():
    u = manytrees.uniform(manytrees.mixed(np.arange(20_000, dtype=np.uint64)), np.array([5]))
    assert u.mean() == pytest.approx(0.5, abs=0.01) and len(np.unique(u)) == 20_000
    for n in (1, 40, 3000):
        drawn = manytrees.poisson(u, np.full(len(u), n))
        assert drawn.mean() == pytest.approx(n, rel=0.03) and drawn.var() == pytest.approx(n, rel=0.05)
    assert not manytrees.poisson(u, np.zeros(len(u), np.int64)).any()


@pytest.mark.parametrize("slice_", [10_000, 40])
def test_each_tree_equals_a_recursion_over_its_rows(folded, monkeypatch, slice_):
    """Also with cells in many slices and trees in several groups."""
    monkeypatch.setattr(manytrees, "SLICE", slice_)
    monkeypatch.setattr(manytrees, "GROUP", 2)
    rows, _ = binned(folded)
    cells = stored(manytrees.cells_of(rows, "yd", 2))
    forests, trees, depth, seed = [(2, 0), (2, -1), (9, 1)], 3, 4, 7
    grown = manytrees.grow_forests(cells, forests, trees, depth, seed)
    table = cells.collect()
    bins = np.array([list(r["_bins"]) for r in table], np.uint8)
    y, n = np.array([r["y"] for r in table]), np.array([r["n"] for r in table])
    h = np.full(len(y), seed, np.uint64)
    text = np.zeros((len(y), 8), np.uint8)
    text[:, :3], text[:, 3] = bins, y + 1
    h = manytrees.mixed(h ^ manytrees.mixed(text.view(np.uint64)[:, 0] + np.uint64(0x9E3779B97F4A7C15)))
    gini = lambda a, b: 2 * a * b / (a + b) ** 2 if a + b else 0.0
    for t in range(trees):
        drawn = manytrees.poisson(manytrees.uniform(h[:, None], t * 2 + np.array([[1, 2]])), n)
        allowed = manytrees.subsets(seed, t, 2**depth - 1, 3)
        for f, (leaf, fold) in enumerate(forests):
            learnt = n.sum(1) - (n[:, fold] if fold >= 0 else 0)
            weight = drawn.sum(1) - (drawn[:, fold] if fold >= 0 else 0)
            scale = [learnt.sum() / (2 * learnt[y == c].sum()) for c in (0, 1)]

            def grow(place, here):
                """Inner places below, and whether the node says 1."""
                size = [weight[here & (y == c)].sum() * scale[c] for c in (0, 1)]
                says = size[1] > size[0]
                best, cut = 1e-12, None
                for column in allowed[place] if place < 2**depth - 1 and min(size) > 0 else ():
                    for b in range(manytrees.BINS):
                        sides = [here & (bins[:, column] <= b), here & (bins[:, column] > b)]
                        if min(weight[s].sum() for s in sides) < leaf:
                            continue
                        parts = [[weight[s & (y == c)].sum() * scale[c] for c in (0, 1)] for s in sides]
                        gain = gini(*size) - sum(sum(p) * gini(*p) for p in parts) / sum(size)
                        if gain > best + 1e-12:
                            best, cut = gain, (column * manytrees.BINS + b, sides)
                if cut is None:
                    return {}, says
                (low, left), (high, right) = (grow(2 * place + 1 + i, s) for i, s in enumerate(cut[1]))
                if not low and not high and left == right:
                    return {}, says
                return {place: cut[0], **low, **high}, None

            want, _ = grow(0, np.ones(len(y), bool))
            got = {int(p): int(c) for p, c in enumerate(grown.codes[t, f]) if c >= 0}
            assert got == want


def test_scores_follow_spark_forests(folded):
    rows, cuts = binned(folded)
    cells = stored(manytrees.cells_of(rows, "yd", 2))
    grown = manytrees.grow_forests(cells, [(2, -1)], 150, 6, 42)
    nodes = selection.grown_nodes(grown, 0)
    scored = selection.forest_scores(nodes, rows.withColumn("fold", F.lit(0)), "rf", [0], [150], [6], 0, "yd", "id")
    own = np.array([r[0] for r in scored.orderBy("id").select("score").collect()])
    model = classifiers.Forest(trees=150, depth=6, leaf=2).fit(folded)
    theirs = np.array([r[0] for r in model.transform(folded).orderBy("id").select("score").collect()])
    assert np.corrcoef(own, theirs)[0, 1] > 0.99 and np.abs(own - theirs).mean() < 0.03


def test_a_search_does_not_depend_on_how_rows_are_stored_and_shares_its_jobs(spark, folded):
    """Draws went by partition, and every leaf size and fold had jobs of its own."""
    def search(df, leaves):
        grids = {"rf": (classifiers.Forest, {"trees": [4, 6], "depth": [2, 4], "leaf": leaves}, {})}
        context = spark.sparkContext
        context.setJobGroup(f"leaves{len(leaves)}", "")
        found = selection.tree_search(df, None, ["p", "q"], k=2, grids=grids)
        context.setLocalProperty("spark.jobGroup.id", None)
        jobs = len(context.statusTracker().getJobIdsForGroup(f"leaves{len(leaves)}"))
        return {tuple(r)[1:4]: r["score"] for r in found.scores.collect()}, found.grid, jobs

    plain = stored(folded.select("id", "yd", "fold", F.round(F.rand(5), 2).alias("p"), F.round(F.rand(6), 2).alias("q")))
    a, grid, jobs = search(plain, [2])
    b, same, more = search(stored(plain.repartition(5, "p")), [2, 4, 8])
    again, dealt, _ = search(stored(plain.repartition(7, "q")), [2])
    assert again == pytest.approx(a) and dealt == grid
    assert more <= jobs + 2


def test_boosting_reads_a_small_table_in_one_task(folded, monkeypatch):
    """As many tasks as files, each of a few rows, in hundreds of jobs a fit."""
    seen, whole = [], selection.plain_fits
    monkeypatch.setattr(selection, "plain_fits", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or whole(df, *a))
    grids = {"hgb": (classifiers.Boosting, {"rate": [0.1], "depth": [1]}, {"rounds": 1})}
    rows = folded.select("id", "yd", "fold", (F.col("id") % 17).cast("double").alias("p"))
    found = selection.tree_search(stored(rows.repartition(7)), None, ["p"], k=2, grids=grids)
    assert seen == [1, 1] and found.sample("cv").count() == 300
