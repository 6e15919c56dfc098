import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import impute, neighbours


def brute(rows, k):
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    sd[sd == 0] = 1
    z, out, p = (x - mean) / sd, x.copy(), x.shape[1]
    for i, j in np.argwhere(np.isnan(x)):
        near = []
        for d in range(len(x)):
            both = ~np.isnan(z[i]) & ~np.isnan(z[d])
            if not np.isnan(x[d, j]) and both.any():
                near.append((round(p / both.sum() * ((z[i, both] - z[d, both]) ** 2).sum(), 9), d))
        near = sorted(near)[:k]
        out[i, j] = np.mean([x[d, j] for _, d in near]) if near else mean[j]
    return out


def check(spark, rows, k):
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{c} double" for c in names)
    ).coalesce(2)
    got = impute.knn_impute(df, names, k).orderBy("id").collect()
    assert len(got) == len(rows)
    np.testing.assert_allclose([[r[c] for c in names] for r in got], brute(rows, k), atol=1e-9)


def sample(n, p, gap, levels):
    random.seed(n + p)
    draw = lambda i: float(random.randint(0, 4)) if i < levels else random.expovariate(1)
    return [tuple(None if random.random() < gap else draw(i) for i in range(p)) for _ in range(n)]


def test_hand_sized(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.0, 6.0), (3.0, None, 9.0), (4.0, 8.0, 12.0), (5.0, 10.0, 15.0)]
    check(spark, rows, 2)


def test_against_brute_force(spark):
    check(spark, sample(700, 3, 0.1, 1), 3)


def test_one_point_holds_a_third_of_the_rows(spark):
    check(spark, [(1.0, 1.0, 1.0)] * 300 + sample(500, 3, 0.1, 2), 3)


def test_many_patterns_and_too_few_donors(spark):
    check(spark, sample(150, 4, 0.4, 4), 2)
    check(spark, [(None, 1.0), (2.0, None), (None, 3.0)], 3)


def test_scaling_and_fit_sample(spark, mini):
    scaled = impute.standardize(mini, ["a"]).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert list(scaled) == pytest.approx([0, 1], abs=1e-12)
    scaler = impute.fit_scaler(mini, ["a", "b"])
    back = scaler.inverse(scaler.transform(mini)).orderBy("id").collect()
    assert [r["a"] for r in back] == pytest.approx([r["a"] for r in mini.orderBy("id").collect()])
    gappy = mini.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    donors = gappy.where("id in (6, 7, 8)")
    filled = impute.knn_impute(gappy, ["a", "b"], 3, fit_on=donors)
    assert filled.where("id = 3").first()["a"] == pytest.approx(4.0)


def test_nothing_missing_and_empty_column(spark, mini):
    assert impute.knn_impute(mini, ["a", "b"]).count() == 12
    blank = mini.withColumn("b", F.lit(None).cast("double"))
    assert impute.knn_impute(blank, ["a", "b"]).where("b is null").count() == 12


@pytest.mark.parametrize("k, leaf, visits, boxes", [(3, 4, 2048, 50_000), (2, 16, 3, 5)])
def test_small_boxes_and_split_visits(spark, monkeypatch, k, leaf, visits, boxes):
    """Deep trees, boxes of several tasks and lists of boxes in blocks give the same donors."""
    monkeypatch.setattr(neighbours, "VISITS", visits)
    monkeypatch.setattr(neighbours, "BOXES", boxes)
    monkeypatch.setattr(neighbours.means_of_nearest, "__defaults__", (leaf,))
    monkeypatch.setattr(neighbours.math, "isqrt", lambda n: leaf)
    check(spark, sample(300, 4, 0.15, 2), k)


def test_fourteen_features_and_more_than_a_machine_word(spark):
    check(spark, sample(400, 14, 0.1, 3), 3)
    check(spark, sample(30, 70, 0.05, 10), 2)


def test_tree_cells_are_prefixes_and_boxes_bound_their_donors():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(500, 3))
    tree = neighbours.medians(z, 4, {"111": 4, "011": 2})
    fine, coarse = tree.cells(z, ["111"] * 500), tree.cells(z, ["011"] * 500)
    assert np.array_equal(fine >> 2, coarse) and np.bincount(fine, minlength=16).min() > 15
    low, high = (np.array([f(z[fine == c], 0) for c in range(16)]) for f in (np.min, np.max))
    boxes = neighbours.Boxes(np.arange(16), np.bincount(fine), np.ones((16, 3), bool), low, high)
    points = np.where(rng.random((20, 3)) < 0.3, np.nan, rng.normal(size=(20, 3)) * 2)
    bound = boxes.distances(points)
    for p, away in zip(points, bound):
        seen = ~np.isnan(p)
        for c in range(16):
            if seen.any():
                real = ((z[fine == c][:, seen] - p[seen]) ** 2).sum(1).min() * 3 / seen.sum()
                assert away[c] <= real + 1e-12
            else:
                assert away[c] == np.inf


def test_points_meet_only_donors_near_in_the_features_they_have(spark, monkeypatch):
    """Cuts along absent features made every point read a large share of all boxes."""
    rng = np.random.default_rng(9)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(3000, 5))]
    rows += [(*map(float, r), None, None, None) for r in rng.normal(size=(60, 2))]
    counted = []
    whole = neighbours.met
    monkeypatch.setattr(neighbours, "met", lambda asked, *a: counted.append(asked.count()) or whole(asked, *a))
    monkeypatch.setattr(neighbours.means_of_nearest, "__defaults__", (32,))
    check(spark, rows, 3)
    assert sum(counted) <= 60 * 6


def test_more_patterns_than_trees_and_few_near_boxes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TREES", 2)
    monkeypatch.setattr(neighbours, "NEAR", 2)
    monkeypatch.setattr(neighbours.means_of_nearest, "__defaults__", (8,))
    check(spark, sample(300, 4, 0.25, 1), 3)


def test_lowest_takes_the_first_of_equal_ones():
    rng = np.random.default_rng(2)
    distance = rng.integers(0, 5, (40, 30)).astype(float)
    distance[distance == 4] = np.inf
    for k in (1, 3, 30, 50):
        row, column = neighbours.lowest(distance, k)
        want = np.argsort(distance, axis=1, kind="stable")[:, :k]
        assert np.array_equal(column.reshape(40, -1), want) and np.array_equal(row, np.repeat(np.arange(40), want.shape[1]))
