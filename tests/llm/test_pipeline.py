"""Each stage of the pipeline on NULLs, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, language int, spans int, _cut int, _doc int"
PROSE = ["the old miller walked to the river and counted his sacks before the rain came over the hill",
         "le vieux meunier marchait vers la rivière et comptait ses sacs avant la pluie du soir"]


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 1, 2, 3, 4) if len(r) == 4 else r for r in rows], SCHEMA)


def base(spark):
    rows = [(i, f"{PROSE[i % 2]} number {i}", ["en", "fr"][i % 2], f"s{i % 3}") for i in range(40)]
    rows += [(50, None, "en", "s1"), (51, "", "en", "s1"), (52, " 12 ... 34 ", "en", None), (None, "no id " * 9, None, "s2"),
             (53, "very long " * 40_000, "en", "s2"), rows[0], (0, PROSE[1], None, None)]
    return table(spark, rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    bench = [(1, "counted his sacks before the rain came over the hill number 4"), (2, None), (3, ""), (1, "river bank")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    base(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_and_odd_columns(spark, folder, name, stage):
    want = corpus_pipeline.COLUMNS if name != "sentencepiece" else stage(spark, base(spark).limit(0), folder).columns
    assert stage(spark, base(spark).limit(0), folder).columns == want
    assert stage(spark, base(spark).limit(0), folder).count() == 0


def test_language_rejects_what_has_no_letters(spark, folder):
    got = [r.doc_id for r in corpus_pipeline.language(spark, base(spark), folder).collect()]
    want = [r.doc_id for r in base(spark).where("text RLIKE '[a-z]'").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_document_of_each_group_of_near_copies_stays(spark, folder):
    words = [f"w{i}" for i in range(200)]
    edit = [*words[:100], "other", *words[101:]]
    rows = [(9, " ".join(words), "en", "a"), (4, " ".join(edit), "en", "b"), (4, " ".join(words), "en", "c"),
            (None, " ".join(words), "en", "d"), (7, "alone here", "en", "e"), (7, "alone here", "fr", "f"),
            (None, "without an id", "en", "g"), (None, "without an id", "en", "h"), (8, None, "en", "i"),
            (8, None, "en", "i"), (11, "...", "en", "j"), (12, "...", "en", "j")]
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), folder).collect()
    kept = sorted((str(r.doc_id), (r.text or "-")[:13]) for r in got)
    four = [t for i, t in kept if i == "4"]
    assert len(four) == 1
    assert [k for k in kept if k[0] != "4"] == [
        ("11", "..."), ("7", "alone here"), ("8", "-"), ("8", "-"), ("None", "without an id")]


def test_near_copies_of_rows_that_do_not_repeat(spark, folder):
    rows = [(i, " ".join(f"w{i // 3}x{k}" for k in range(60)) + f" {i}", "en", "s") for i in range(30)]
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), folder).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 30, 3))


def test_benchmark_passages_go_and_clean_documents_stay(spark, folder):
    rows = [(1, f"before it {PROSE[0]} number 4 behind it", "en", "s"),
            (2, "counted his sacks before the rain came over the hill number 4", "en", "s"),
            (3, "river bank", "en", "s"), (4, "a river bank", "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"),
            (7, "clean", "en", "s"), (7, "clean", "en", "s"), (None, "clean too", None, None)]
    got = corpus_pipeline.benchmark(spark, table(spark, rows), folder).collect()
    left = sorted((str(r.doc_id), r.text) for r in got if r.text)
    assert left == [("1", "before it the old miller walked to the river and  behind it"), ("4", "a "), ("7", "clean"),
                    ("7", "clean"), ("None", "clean too")]
    assert sorted(r.doc_id for r in got if not r.text) == [5, 6]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_every_row_is_encoded(spark, folder):
    got = corpus_pipeline.tokens(spark, base(spark), folder)
    assert got.count() == base(spark).count()
    assert [r.n_tokens for r in got.where("doc_id IN (50, 51)").collect()] == [0, 0]


def test_whole_run_keeps_one_row_per_document(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    counts = got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    # Id 0 stands for two texts, and each is the smallest id of its group.
    assert {r.doc_id: r.n for r in counts if r.n > 1} == {0: 2}
    assert {50, 51, 52}.isdisjoint(r.doc_id for r in counts)
