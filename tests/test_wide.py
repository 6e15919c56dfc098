"""More columns than the bits of an integer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import association, impute, regression


def test_forty_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 40)) + rng.normal(size=(120, 1))
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(x)], ["id", *names]).repartition(3)
    for r in association.correlation_pairs(df, names).collect():
        a, b = x[:, names.index(r["var1"])], x[:, names.index(r["var2"])]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert r["n"] == both.sum() and r["r"] == pytest.approx(np.corrcoef(a[both], b[both])[0, 1])


def test_imputing_beyond_an_integers_bits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *[float(v) for v in rng.normal(size=34)]) for i in range(12)]
    rows[3] = (*rows[3][:-1], None)
    names = [f"c{i}" for i in range(34)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names))
    filled = impute.knn_impute(df, names, 3, scale=False).where("id = 3").first()["c33"]
    near = sorted((sum((a - b) ** 2 for a, b in zip(r[1:-1], rows[3][1:-1])), r[-1]) for r in rows if r[0] != 3)[:3]
    assert filled == pytest.approx(np.mean([v for _, v in near]))


def test_tables_for_any_fits(spark, mini):
    gappy = mini.withColumn("a", F.when(F.col("id") > 0, F.col("a")).otherwise(float("nan")))
    fits = regression.three_fits(mini, ["a"])
    first = regression.score_table(gappy, fits, ["a"]).where("id = 0").first()
    assert [first[c] for c in ("score_ols", "score_logit", "score_probit")] == [None] * 3
    one = regression.comparison_table(mini, fits[1:2])
    assert one.columns == ["term", "line", "Logit"]
    with pytest.raises(ValueError):
        regression.score_table(mini, [fits[0], fits[0]], ["a"])
