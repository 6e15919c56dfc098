"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bond

SCHEMA = "vec_id long, label int, vector array<long>, seal string, block string, size string, score string"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    rows = list({(i, k, tuple(v)): 0 for i, k, v in rows
                 if i is not None and k is not None and v is not None and None not in v})
    out = []
    for i, k, v in [r for r in rows if r[0] % 5 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v))
        near = [(-s, j) for s, j, m in scored if m == k][:positives]
        for p, j in near:
            hits = [(-s, n) for s, n, m in scored if m != k and low * p <= 100 * -s <= high * p][:negatives]
            out += [(i, j, r, n, p, s) for r, (s, n) in enumerate(hits, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def vectors(seed, count, spread, size=7):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.randrange(-spread, spread + 1) for _ in range(size)]) for i in range(count)]


@pytest.mark.parametrize("spread", [2, 300, 40_000])  # ties, usual values, values wider than 16 bits
def test_hard_negatives_equal_brute_force(spark, spread):
    rows = vectors(spread, 90, spread)
    rows += [(i, 1, rows[0][2]) for i in range(100, 130)]  # one vector many times
    rows += [rows[5], rows[5], (7, 2, [1] * 7), (200, 0, []), (205, 0, []), (201, 1, []), (210, 1, [3]), (211, 1, [4]),
             (212, 2, [2]), (None, 1, [1] * 7), (215, None, [1] * 7), (220, 1, None), (225, 1, [1, None, 1, 1, 1, 1, 1])]
    got = bond.hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0, block=40, group=8)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_negative_scores_and_empty_table(spark):
    rows = [(5, 0, [1, 0]), (1, 0, [-3, 1]), (2, 1, [-2, 0]), (3, 1, [5, 5])]
    anchors = F.col("vec_id") % 5 == 0
    assert bond.hard_negatives(table(spark, rows), anchors).count() == len(brute(rows)) == 0
    assert bond.hard_negatives(table(spark, rows).limit(0), anchors).count() == 0


def test_whole_numbers_beyond_floating_point_stay_exact():
    big = (1 << 27) + 1
    columns = np.array([[big, big + 1, -big], [3, 3, 3]], np.int64)
    anchor = np.array([[big, 1]], np.int64)
    kind = bond.matched_type(columns, anchor)
    block = bond.Columns(np.arange(3), np.zeros(3, int), columns.astype(kind))
    rows, score, _ = bond.scan(block, anchor[0].astype(kind), np.ones(3, bool), [(-np.inf, np.inf)], 3)
    assert kind is np.int64 and score.tolist() == [big * big + 3, big * (big + 1) + 3, -big * big + 3]
    with pytest.raises(ValueError):
        bond.matched_type(columns << 6, anchor << 6)


def test_scan_reads_few_columns_where_one_dimension_decides():
    rng = np.random.default_rng(3)
    columns = rng.integers(-3, 4, (64, 2000))
    columns[10] = rng.integers(-1000, 1000, 2000)
    block = bond.Columns(np.arange(2000), np.zeros(2000, int), columns.astype(float))
    anchor = np.ones(64)
    anchor[10] = 1000
    rows, score, read = bond.scan(block, anchor, np.ones(2000, bool), [(-np.inf, np.inf)], 5)
    exact = anchor @ block.columns
    assert read < 0.4 * columns.size
    assert set(np.argsort(-exact)[:5]) <= set(rows.tolist()) and np.array_equal(score, exact[rows])
