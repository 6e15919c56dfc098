import math

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import association, describe, hypothesis
from tests.conftest import A, B


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_moments(mini):
    m = by(describe.moments(mini, ["a"], ["yd"]), "yd")
    assert (m[0]["mean"], m[1]["mean"]) == (3.0, 6.0)
    assert (m[0]["variance"], m[1]["variance"]) == pytest.approx((3.2, 5.6))
    assert m[0]["skewness"] == pytest.approx(0.6889189902) and m[1]["skewness"] == pytest.approx(0, abs=1e-12)
    s = by(describe.shape(mini, ["a"], pearson=True), "yd")
    assert (s[0]["kurtosis"], s[1]["kurtosis"]) == pytest.approx((3 - 0.65625, 1.5))


def test_describe_linear_and_nearest(mini):
    d = by(describe.describe(mini, ["a", "b"]), "variable")
    assert [d["a"][c] for c in ("p25", "p50", "p75")] == pytest.approx(list(np.quantile(A, [0.25, 0.5, 0.75])))
    n = by(describe.describe(mini, ["a"], ["yd"], nearest=True), "yd")
    assert [n[0][c] for c in ("p25", "p50", "p75")] == [2.0, 3.0, 4.0]


def test_histogram_counts_every_row(mini):
    h = describe.histogram(mini, ["a", "b"], ["yd"], 4).collect()
    assert sum(r["n"] for r in h) == 24
    assert sum(r["share"] for r in h if r["variable"] == "a" and r["yd"] == 1) == pytest.approx(1)


def test_box_and_outliers(spark):
    rows = [(i, 0, float(i)) for i in range(10)] + [(10, 0, 100.0)]
    df = spark.createDataFrame(rows, "id long, yd int, x double")
    box = describe.box_statistics(df, ["x"]).first()
    assert (box["lower_whisker"], box["upper_whisker"], box["n_outliers"]) == (0.0, 9.0, 1)
    assert [r["id"] for r in describe.box_outliers(df, ["x"]).collect()] == [10]


def test_density_matches_direct_sum(mini):
    got = {r["x"]: r["density"] for r in describe.density(mini, "a", [], -4, 4, 9).collect()}
    h = np.std(A, ddof=1) * 12 ** -0.2
    for x, d in got.items():
        assert d == pytest.approx(np.mean(np.exp(-((x - np.array(A)) / h) ** 2 / 2)) / h / math.sqrt(2 * math.pi))


def test_degenerate_shapes(spark):
    flat = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 1, None)], "id long, yd int, x double")
    m = by(describe.moments(flat, ["x"], ["yd"]), "yd")
    assert m[0]["skewness"] is None and m[1]["mean"] is None and m[1]["n_missing"] == 1
    assert describe.density(flat, "x", ["yd"]).count() == 0
    assert describe.histogram(flat, ["x"], ["yd"], 3).collect()[0]["n"] == 2


def test_shapiro_published_example(spark):
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(0, float(v)) for v in x], "yd int, x double")
    r = hypothesis.shapiro_wilk(df, ["x"]).first()
    assert r["w"] == pytest.approx(0.788814695, abs=1e-8) and r["p_value"] == pytest.approx(0.006703814, abs=1e-8)


def test_shapiro_long_runs_are_split(mini, monkeypatch):
    whole = {r["yd"]: r["w"] for r in hypothesis.shapiro_wilk(mini, ["a"]).collect()}
    monkeypatch.setattr(hypothesis, "CHUNK", 1)
    split = {r["yd"]: r["w"] for r in hypothesis.shapiro_wilk(mini, ["a"]).collect()}
    assert whole == pytest.approx(split)


def test_variance_tests(mini):
    assert hypothesis.levene(mini, ["a"]).first()["statistic"] == pytest.approx(1.2307692308)
    assert hypothesis.levene(mini, ["a"], center="mean").first()["statistic"] == pytest.approx(1.4285714286)
    assert hypothesis.bartlett(mini, ["a"]).first()["statistic"] == pytest.approx(0.3513257923)


def test_homogeneity_decisions(spark):
    rows = [(g, float(v), 1.0 if g == 0 else float(v), 2.0, float(v)) for g in (0, 1) for v in range(6)]
    df = spark.createDataFrame(rows, "yd int, x double, half double, flat double, y double")
    r = by(hypothesis.variance_homogeneity(df, ["x", "half", "flat"]), "variable")
    assert r["x"]["test"] == "bartlett" and r["x"]["equal_variances"] is True
    assert r["half"]["test"] == "undefined (zero variance)" and r["half"]["equal_variances"] is False
    assert r["flat"]["equal_variances"] is True and r["flat"]["pvalue"] is None
    few = df.where("yd = 0 or x < 2")
    tiny = hypothesis.variance_homogeneity(few, ["x"]).first()
    assert tiny["test"] is None and tiny["n1"] == 2 and tiny["equal_variances"] is None


def test_means(mini):
    welch = hypothesis.equal_means(mini, ["a"]).first()
    assert welch["t_statistic"] == pytest.approx(-2.4771684715) and welch["df"] == pytest.approx(9.3076923077)
    pooled = hypothesis.equal_means(mini, ["a"], equal_var_cols=["a"]).first()
    assert pooled["df"] == 10


def test_point_biserial(spark, mini):
    r = by(hypothesis.point_biserial(mini, ["a"]), "variable")["a"]
    assert r["r"] == pytest.approx(0.6166698388) and r["t_stat"] == pytest.approx(2.4771684715)
    flat = mini.selectExpr("yd", "1.0D as x", "cast(null as double) as y")
    assert all(row["r"] is None for row in hypothesis.point_biserial(flat, ["x", "y"]).collect())
    assert hypothesis.point_biserial(mini.limit(0), ["a"]).count() <= 1


def test_four_views_agree(mini):
    t = {r["test"]: abs(r["t_stat"]) for r in association.equivalence_check(mini, "a").collect()}
    assert len({round(t[k], 9) for k in ("pooled", "correlation", "x_on_y", "y_on_x")}) == 1


def test_correlations(mini):
    m = by(association.correlation_matrix(mini, ["a", "b", "yd"]), "variable")
    assert m["a"]["b"] == pytest.approx(np.corrcoef(A, B)[0, 1]) and m["a"]["a"] == pytest.approx(1)
    assert association.strong_pairs(mini, ["a", "b", "yd"], 0.7).count() == 2
    assert association.lower_triangle(mini, ["a", "b"]).first()["var1"] == "b"
    line = association.pair_lines(mini, ["a", "b"]).first()
    assert line["slope"] == pytest.approx(np.polyfit(A, B, 1)[0])
    constant = mini.selectExpr("a", "1.0D as c")
    assert association.correlation_pairs(constant, ["a", "c"]).first()["r"] is None


def test_quantiles_of_large_groups_by_bands(spark, monkeypatch):
    """Ties that fill whole bands, skew, gaps and groups of every size give the ranks of a full sort."""
    monkeypatch.setattr(describe, "ACCURACY", 200)
    monkeypatch.setattr(describe, "MARGIN", 3 / 200)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"yd": rng.choice([0, 1, 2], 6000, p=[0.7, 0.29, 0.01]),
                          "a": np.round(rng.lognormal(0, 2, 6000), 1), "b": rng.normal(size=6000)})
    frame.loc[rng.random(6000) < 0.4, "a"] = 5.0
    frame.loc[rng.random(6000) < 0.1, "b"] = np.nan
    df = spark.createDataFrame(frame).repartition(3)
    points = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    for method in ("linear", "nearest"):
        got = describe.value_quantiles(df, ["a", "b"], points, ["yd"], method).collect()
        assert len(got) == 6
        for row in got:
            values = np.sort(frame.loc[frame.yd == row["yd"], row["variable"]].dropna().to_numpy())
            at = np.array(points) * (len(values) - 1)
            want = (np.quantile(values, points) if method == "linear"
                    else values[np.floor(at + 0.5).astype(int)])
            assert np.allclose([row[f"q_{i}"] for i in range(len(points))], want)
