import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import frame, regression


def terms(fit):
    return {r[1]: r for r in fit.rows()}


def measures(df):
    return {r["measure"]: r["value"] for r in df.collect()}


def test_ols(spark, mini):
    fit = regression.ols(mini, ["a", "b"])
    assert fit.coef == pytest.approx([0.8663028649, 0.0368349250, -0.2128240109])
    assert [r[3] for r in fit.rows()] == pytest.approx([0.58916209, 0.06965283, 0.12237819], abs=1e-7)
    m = measures(regression.fit_summary(mini, fit))
    assert m["r2"] == pytest.approx(0.5361527968) and m["durbin_watson"] == pytest.approx(1.4425099644)
    assert m["condition_number"] == pytest.approx(
        np.linalg.cond(np.array([[1, r["a"], r["b"]] for r in mini.collect()])))


def test_leverage(mini):
    want = [0.356867, 0.201342, 0.190427, 0.187699, 0.135857, 0.239541,
            0.239541, 0.370509, 0.135857, 0.190427, 0.348681, 0.403251]
    df, cut, rank = regression.leverage(mini, ["a", "b"])
    rows = df.orderBy("id").collect()
    assert [r["leverage"] for r in rows] == pytest.approx(want, abs=1e-6)
    assert (cut, rank) == (0.5, 3) and not any(r["high_leverage"] for r in rows)
    doubled, _, rank = regression.leverage(mini.withColumn("c", F.col("a") * 2), ["a", "b", "c"])
    assert rank == 3 and doubled.agg(F.sum("leverage")).first()[0] == pytest.approx(3)


def test_logit_and_probit(spark, mini):
    logit = regression.logit(mini, ["a"])
    assert logit.coef == pytest.approx([-3.1809506, 0.73624158], abs=1e-6)
    assert logit.loglik == pytest.approx(-5.6217103) and logit.pseudo_r2 == pytest.approx(0.3241322, abs=1e-6)
    probit = regression.probit(mini, ["a"])
    assert probit.coef == pytest.approx([-1.96862278, 0.45130512], abs=1e-6)
    assert [r[3] for r in probit.rows()] == pytest.approx([1.0814816, 0.2369233], abs=1e-6)
    expected = regression.probit(mini, ["a"], information="expected")
    assert [r[3] for r in expected.rows()] == pytest.approx([1.0374208, 0.2283638], abs=1e-6)
    for fit in (logit, probit):
        assert fit.converged
        assert all(abs(r["gradient"]) < 1e-8 for r in regression.score_gradient(mini, fit).collect())


def test_separation_is_reported(mini):
    fit = regression.logit(mini.withColumn("x", F.col("id") - 5.5), ["x"])
    assert not fit.converged


def test_scores_keep_rows_with_missing_features(spark, mini):
    fits = regression.three_fits(mini, ["a"])
    gappy = mini.withColumn("a", F.when(F.col("id") > 0, F.col("a")))
    rows = regression.score_table(gappy, fits, ["a"]).orderBy("id").collect()
    assert len(rows) == 12
    assert [rows[0][c] for c in ("score_ols", "score_logit", "score_probit")] == [None] * 3
    assert rows[5]["score_probit"] == pytest.approx(0.770109634)
    residuals = regression.residual_table(regression.score_table(gappy, fits, ["a"]))
    assert residuals.count() == 33
    assert regression.outliers(residuals, " LOGIT ").where("abs(residual) <= 2").count() == 0
    table = regression.comparison_table(mini, fits).collect()
    assert [r["term"] for r in table] == ["const", "const", "a", "a", "N", "R2", "loglik", "AUC"]
    assert table[-1]["Logit"] == "0.861"


def test_dummy_trap_and_constraint(mini):
    df = frame.with_complement(mini)
    full = regression.ols(df, ["yd", "ynd"], "a")
    assert full.rank == 2 and full.coef == pytest.approx([3, 3, 0], abs=1e-9)
    assert regression.ols(df, ["yd", "ynd"], "a", drop_collinear=True).dropped == ("ynd",)
    bound = regression.constrained_ols(df, ["yd", "ynd"], "a", [{"yd": 1, "ynd": 1}])
    assert bound.coef == pytest.approx([4.5, 1.5, -1.5])
    z = regression.ols(df, ["z"], "a")
    assert z.coef == pytest.approx([4.5, 1.5]) and z.sse == pytest.approx(bound.sse)
    assert [r[3] for r in z.rows()] == pytest.approx([r[3] for r in bound.rows()][:2])


def test_linear_hypothesis(mini):
    df = frame.with_complement(mini)
    r = regression.linear_hypothesis(df, ["yd", "ynd"], "a", [{"yd": 1, "ynd": 1}]).first()
    assert not r["estimable"] and r["f"] is None
    both = regression.linear_hypothesis(mini, ["a", "b"], "yd", [{"a": 1}, {"b": 1}]).first()
    assert both["f"] == pytest.approx(5.201470588) and both["df2"] == 9


def test_large_offsets_do_not_cancel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = 2 + 3 * x + rng.normal(size=400)
    df = spark.createDataFrame(
        [(float(a + 1e7), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = regression.ols(df, ["x"], "y")
    assert fit.coef[1] == pytest.approx(np.polyfit(x, y, 1)[0], rel=1e-6)
