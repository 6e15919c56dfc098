import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordering, sampling


@pytest.fixture(scope="module")
def hot(spark):
    """One value holds half of the rows; ties everywhere."""
    random.seed(3)
    rows = [
        (i, i % 2, 5.0 if i % 2 else float(random.randint(0, 60)), None if i % 11 == 0 else random.random())
        for i in range(2000)
    ]
    random.shuffle(rows)
    return spark.createDataFrame(rows, "key long, yd int, x double, w double").repartition(5).cache()


def local(df):
    return [tuple(r) for r in df.collect()]


def test_runs_match_sorted_counts(hot):
    rows = local(hot.select("yd", "x"))
    for yd, x, n, below, total in local(ordering.runs(hot, "x", ["yd"])):
        group = [v for g, v in rows if g == yd]
        assert (n, below, total) == (group.count(x), sum(v < x for v in group), len(group))


@pytest.mark.parametrize("keys", [["yd", "x"], ["w"], []])
def test_global_index_is_the_sorted_position(hot, keys):
    rows = local(hot.select("key", *keys))
    last = float("inf")
    want = sorted(rows, key=lambda r: [*(last if v is None else v for v in r[1:]), r[0]])
    got = local(ordering.global_index(hot, keys, "key").select("id", "key").orderBy("id"))
    assert got == [(i, r[0]) for i, r in enumerate(want)]


def test_index_does_not_depend_on_partitions(spark, hot):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        many = local(ordering.global_index(hot.orderBy(F.rand(1)), ["x"], "key").select("id", "key"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(many) == sorted(local(ordering.global_index(hot, ["x"], "key").select("id", "key")))


def test_neighbours(hot):
    got = local(ordering.with_neighbour(hot, "key", ["x"], ["yd"]).select("key", "prev_x"))
    x = {k: v for k, v in local(hot.select("key", "x"))}
    assert all(p == x.get(k - 2) for k, p in got)
    ahead = local(ordering.with_neighbour(hot, "key", ["x"], [], ahead=True).select("key", "next_x"))
    assert all(p == x.get(k + 1) for k, p in ahead)


def test_quantiles(spark, hot):
    import numpy as np

    values = [r[0] for r in local(hot.select("w")) if r[0] is not None]
    got = ordering.quantiles(hot, "w", [0.0, 0.25, 0.5, 1.0]).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 1])), abs=1e-12)
    near = ordering.quantiles(hot, "x", [0.5], ["yd"], "nearest")
    assert {r["yd"]: r["q_0"] for r in near.collect()}[1] == 5.0
    assert ordering.quantiles(hot.limit(0), "w", [0.5], ["yd"]).count() == 0


def test_split_sizes(hot):
    df = hot.withColumnRenamed("key", "id")
    test = sampling.random_split(df, 0.25).where("in_test = 1")
    assert test.count() == 500
    small = df.where("id < 181")
    assert sampling.random_split(small, 0.25).where("in_test = 1").count() == 46
    split = sampling.random_split(small, 0.25, "yd").groupBy("yd", "in_test").count()
    sizes = {(r["yd"], r["in_test"]): r["count"] for r in split.collect()}
    assert sizes[(0, 1)] + sizes[(1, 1)] == 46 and abs(sizes[(0, 1)] - sizes[(1, 1)]) <= 1
    again = sampling.random_split(small.repartition(7), 0.25, "yd").select("id", "in_test")
    assert sorted(local(again)) == sorted(local(sampling.random_split(small, 0.25, "yd").select("id", "in_test")))


def test_folds_and_small_groups(spark, hot):
    df = hot.withColumnRenamed("key", "id").where("id < 203")
    folds = sampling.stratified_folds(df, 5).groupBy("yd", "fold").count().collect()
    for yd in (0, 1):
        counts = [r["count"] for r in folds if r["yd"] == yd]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    tiny = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, yd int")
    placed = sampling.stratified_folds(tiny, 5)
    assert placed.count() == 3 and placed.where("fold between 0 and 4").count() == 3
    assert sampling.hash_segments(tiny, [0.0, 0.5], name="s").where("s = 0").count() == 0


def test_systematic_split(hot):
    df = sampling.systematic_split(hot, ["yd", "x"], "key")
    counts = {(r["yd"], r["dumVE"]): r["count"] for r in df.groupBy("yd", "dumVE").count().collect()}
    assert all(v == 500 for v in counts.values())
    third = sampling.systematic_split(hot, ["x"], "key", every=3)
    assert third.where("dumVE = 1").count() == 667


@pytest.mark.parametrize("value", ["rand(1)", "exp(10 * rand(1))", "floor(10 * rand(1)) + rand(2) / 1000"])
def test_ranges_stay_balanced_with_many_partitions(spark, value):
    df = spark.range(300_000).selectExpr(f"CAST({value} AS DOUBLE) AS v")
    bounds = ordering.range_bounds(df, ["v"], 1000)[0]
    assert len(bounds) > 950
    found = np.histogram(df.toPandas()["v"], bounds[1:-1])[0]
    assert found.max() <= 3 * 300


def test_splits_scan_their_input_once(spark, tmp_path):
    rows = [(i, ["a", "b", None][i % 3] if i % 7 else "a") for i in range(500)]
    spark.createDataFrame(rows, "id long, level string").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    for split in (sampling.random_split(df, 0.25, "level"), sampling.random_split(df, 0.25),
                  sampling.stratified_folds(df, 5, "level")):
        assert len([f for f in split.inputFiles() if str(tmp_path) + "/rows" in f]) == len(df.inputFiles())
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 2  # the table and the few cut rows
    test = sampling.random_split(df, 0.25, "level").where("in_test = 1")
    assert test.count() == 125
    sizes = {r["level"]: (r["n"], r["t"]) for r in sampling.random_split(df, 0.25, "level").groupBy("level").agg(
        F.count("*").alias("n"), F.sum("in_test").alias("t")).collect()}
    assert set(sizes) == {"a", "b", None} and all(abs(t - n / 4) < 1 for n, t in sizes.values())
    assert sampling.random_split(df.limit(0), 0.25, "level").count() == 0
