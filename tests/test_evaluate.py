import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate


def test_concordance(mini):
    r = evaluate.concordance(mini, "a").first()
    assert (int(r["concordant"]), int(r["discordant"]), int(r["ties"])) == (30, 4, 2)
    assert r["percent_concordant"] == pytest.approx(83.3333333333) and r["auc"] == pytest.approx(0.8611111111)
    assert not evaluate.concordance_check(mini, "a").first()["equal"]
    assert evaluate.concordance_check(mini, "id").first()["equal"]


def test_concordance_against_all_pairs(spark):
    random.seed(5)
    rows = [(random.randint(0, 1), 3.0 if random.random() < 0.4 else random.random() * 6) for _ in range(400)]
    c = sum(a > b for y, a in rows if y for z, b in rows if not z)
    t = sum(a == b for y, a in rows if y for z, b in rows if not z)
    r = evaluate.concordance(spark.createDataFrame(rows, "yd int, s double"), "s").first()
    assert (int(r["concordant"]), int(r["ties"])) == (c, t)


def test_roc(mini):
    full = evaluate.roc_curve(mini, "a", prune=False)
    points = [(round(r["fpr"] * 6), round(r["tpr"] * 6)) for r in full.orderBy(F.desc("threshold")).collect()]
    assert points == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (1, 4), (2, 5), (3, 6), (5, 6), (6, 6)]
    pruned = evaluate.roc_curve(mini, "a")
    assert pruned.count() == 8
    for curve in (full, pruned):
        assert evaluate.trapezoid_area(curve).first()["area"] == pytest.approx(0.8611111111)


def test_one_class_and_tied_scores(mini):
    one = mini.where("yd = 0")
    r = evaluate.concordance(one, "a").first()
    assert r["auc"] is None and r["percent_concordant"] == 0
    tied = evaluate.concordance(mini.withColumn("s", F.lit(0.3)), "s").first()
    assert tied["auc"] == 0.5 and int(tied["ties"]) == 36
    assert evaluate.roc_curve(mini.limit(0), "a").count() == 0


def test_costs(mini):
    df = mini.withColumn("s", F.col("a") / 10)
    r = evaluate.empirical_cutoff(df, "s").first()
    assert r["t_star"] == pytest.approx(1 / 11) and r["cost_star"] == pytest.approx(0.5)
    assert (r["cost_emp"], r["n_tied"]) == (0.25, 20) and r["t_emp"] == pytest.approx(0.2525)
    assert [c["thr"] for c in evaluate.cheapest_cutoffs(evaluate.cost_curve(df, "s"), 2).collect()] == [0.205, 0.21]
    m = evaluate.confusion(df, "s", 0.95).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"], m["cost"]) == (6, 0, 6, 0, 5.0)


def test_cost_curve_counts_directly(spark):
    random.seed(9)
    rows = [(random.randint(0, 1), random.choice([0.1, 0.145, 0.29, 0.57, 1.2, -0.3, random.random()]))
            for _ in range(300)]
    curve = evaluate.cost_curve(spark.createDataFrame(rows, "yd int, s double"), "s")
    for r in curve.collect():
        loss = sum(10 if y and s < r["thr"] else 1 if not y and s >= r["thr"] else 0 for y, s in rows)
        assert r["cost"] == pytest.approx(loss / 300)


def test_area_reads_its_curve_once(spark, mini):
    """Each of its passes repeated all steps behind the curve."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    curve = evaluate.roc_curve(mini, "a", prune=False)
    area = evaluate.trapezoid_area(curve.mapInArrow(watched, curve.schema)).first()["area"]
    assert seen.value == curve.count()
    assert area == pytest.approx(evaluate.auc(mini, "a").first()["auc"])
