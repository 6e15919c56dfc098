import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import frame
from riskloom.sources import tables


@pytest.fixture(scope="module")
def coded(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, 1.5), (1, 1, nan), (2, 0, None), (3, 1, inf), (4, 1, -inf), (5, 0, -99.99)]
    return spark.createDataFrame(rows, "id long, yd int, x double").coalesce(1)


def test_delimited_read_with_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"yd;a;b\r\n0;1.5;-99.99\r\n1;NA;2\r\n1;;3.25\r\n")
    schema = spark.createDataFrame([], "yd int, a double, b double").schema
    rows = [tuple(r) for r in tables.read_delimited(spark, str(path), schema).collect()]
    assert rows == [(0, 1.5, None), (1, None, 2.0), (1, None, 3.25)]
    one = tables.read_delimited(spark, str(path), schema, null_tokens=("-99.99",))
    assert one.where("b is null").count() == 1
    assert tables.STUDY_SCHEMA.names[:3] == ["yd", "tdta", "reta"]


def test_delimited_read_by_name_and_loud(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b;extra;yd;a\n 2 ;x;0;1.5\n-99.99;y;1;12,5\n")
    schema = spark.createDataFrame([], "yd int, a double, b double").schema
    for tokens in (("-99.99",), tables.NULL_TOKENS, ()):
        got = tables.read_delimited(spark, str(path), schema, null_tokens=tokens, malformed="null").collect()
        assert [tuple(r) for r in got] == [(0, 1.5, 2.0), (1, None, None if tokens else -99.99)]
        with pytest.raises(Exception, match="malformed cell in column a"):
            tables.read_delimited(spark, str(path), schema, null_tokens=tokens).collect()
    with pytest.raises(ValueError, match="absent"):
        tables.read_delimited(spark, str(path), schema.add("absent", schema["yd"].dataType))


def test_samples_and_results_round_trip(spark, mini, tmp_path):
    df = mini.withColumn("dumVE", (F.col("id") % 2).cast("byte"))
    tables.write_samples(df, str(tmp_path / "s"))
    assert tables.read_sample(spark, str(tmp_path / "s"), 1).count() == 6
    tables.write_result(mini, str(tmp_path / "r"), "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 12


def test_missing_values(spark, coded):
    clean = tables.sentinel_to_null(coded)
    assert [r["x"] for r in clean.orderBy("id").collect()][:3] == [1.5, None, None]
    assert clean.where("x is null").count() == 3
    assert frame.finite_rows(coded, ["x"]).count() == 2
    assert frame.complete_cases(coded).count() == 4
    assert frame.nulls_for_nan(coded).where("x is null").count() == 2
    assert {r[0]: r[1] for r in frame.missing_cells(coded).collect()} == {"id": 0, "yd": 0, "x": 2}


def test_features_and_target(spark, mini):
    assert frame.resolve_features(mini, ["b", "zz", "a"]) == ["b", "a"]
    assert frame.resolve_features(mini) == ["a", "b"]
    with pytest.raises(ValueError):
        frame.resolve_features(mini, ["zz"])
    assert frame.numeric_features(mini) == ["a", "b"]
    with pytest.raises(ValueError, match="2"):
        frame.check_binary_target(mini.withColumn("yd", F.lit(2)))
    with pytest.raises(ValueError):
        frame.check_binary_target(mini.drop("yd"))
    assert frame.check_binary_target(mini).count() == 12
    z = frame.with_complement(mini).select("ynd", "z").distinct().collect()
    assert sorted(tuple(r) for r in z) == [(0, 1), (1, -1)]


def test_fill_keeps_observed_cells(spark, coded):
    values = coded.select("id", F.lit(7.0).alias("x"))
    filled = {r["id"]: r["x"] for r in frame.fill_gaps(coded, values, ["x"]).collect()}
    assert filled[0] == 1.5 and filled[1] == 7.0 and filled[2] == 7.0 and math.isinf(filled[3])
