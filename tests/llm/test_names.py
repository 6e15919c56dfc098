"""Columns of the caller whose names are those of helper columns stay as they are."""

import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from riskloom.llm import decontam, lines, queries, shards, suffix, urls

ODD = ["_doc", "_cut", "_shared", "_stays", "_node", "_text", "_spans", "_place", "_cell", "_n", "_before", "_rank",
       "_host", "_day", "_lists", "_since", "_Doc_"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"line {i}\nbanner", f"s{i}", f"http://h{i}.org/") for i in range(6)] + [(6, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, url string")
    return frame.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ODD})


def intact(result, into):
    rows = result.collect()
    assert set(result.columns) == {"doc_id", "text", "source", "url", *ODD, *into} and len(rows) == 7
    for r in rows:
        assert all(r[c] == f"{c}{r.doc_id}" for c in ODD)
    return rows


def test_lines(docs):
    rows = intact(lines.remove_shared_lines(docs, threshold=3), ["cleaned"])
    assert {r.cleaned.text for r in rows} == {None, *(f"line {i}" for i in range(6))}


def test_repeats(docs):
    rows = intact(suffix.remove_repeats(docs, length=6, gram=3), ["kept"])
    # "\nbanner" is in all texts; "line " is shorter than a window, also with the digit that tells texts apart.
    assert {r.kept.kept_sha256 for r in rows if r.text} == {
        hashlib.sha256(f"line {i}".encode()).hexdigest() for i in range(6)}


def test_shards(docs):
    rows = intact(shards.numbered(shards.assign(docs, [1.0, 1.0]), F.col("doc_id").cast("string")), ["shard", "slot"])
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_spans(docs):
    spans = F.when(F.col("text").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.lit(5).cast("long").alias("end"))))
    rows = intact(decontam.cut_spans(docs.withColumn("spans", spans)).drop("spans"), [])
    assert {r.text for r in rows} == {None, *(f"{i}\nbanner" for i in range(6))}


def test_lists(spark, docs):
    entry = [("spam", "host", "h2.org", datetime.date(2024, 1, 1), "add")]
    held = urls.validity(spark.createDataFrame(entry, "list string, kind string, value string, day date, action string"))
    rows = intact(urls.judge(docs.withColumn("fetched", F.to_date(F.lit("2024-02-01"))), held).drop("fetched"), ["filter"])
    assert [r.doc_id for r in rows if r.filter.blocked] == [2]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the given tables")
def test_language_of_held_out_rows(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text RLIKE '[a-z]'")
    right = got.join(lang.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95


def test_shard_folders(spark, docs, tmp_path):
    many = docs.select("doc_id", "text").union(docs.select("doc_id", "text").where("doc_id = 6"))
    odd = many.union(spark.createDataFrame([(None, "no key")], "doc_id long, text string"))
    shards.write_shards(odd.withColumn("shard", F.lit("old")), f"{tmp_path}/out", [1.0, 2.0])
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 9 and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1}
    assert back.where("doc_id = 6").select("shard").distinct().count() == 1
