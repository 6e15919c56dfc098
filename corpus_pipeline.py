"""A training-corpus pipeline over `documents`, stage by stage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, jaccard, langid, lines, pieces
from riskloom.llm.queries import BATCH_ROWS, SITES, held_out, table, tokenizer
from riskloom.sources.tables import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_text(docs: DataFrame, text) -> DataFrame:
    """The document columns with another text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language: those without letters or text go."""
    # The first stage; the later ones run in the same session.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    found = langid.identify(docs, langid.fit(docs.where(~held_out())))
    return found.where(F.col("language.lang") != langid.UND).select(*COLUMNS)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the lines that many sites share out of the texts; copies of nothing else wait for the next stage."""
    return with_text(lines.remove_shared_lines(docs, threshold=SITES, only_copies=True), F.col("cleaned.text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id stays.

    A NULL id comes after all others. Of several texts with that id one stays, of rows that repeat id and
    text one too. Texts without words are no copies and all stay.
    """
    found = jaccard.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
    last = stored(found.where("kept").groupBy("doc_id", "text_hash").agg(
        F.max(F.when(F.col("n_shingles") > 0, 1).otherwise(0)).alias("worded"), F.count("*").alias("n")), "kept")
    mine = [docs["doc_id"].eqNullSafe(last["doc_id"]), F.xxhash64(docs["text"]) == last["text_hash"]]
    once = docs.join(last.where("worded = 0 OR n = 1"), mine, "left_semi").select(*COLUMNS)
    if last.where("worded = 1 AND n > 1").isEmpty():
        return once
    again = docs.join(last.where("worded = 1 AND n > 1"), mine, "left_semi").select(*COLUMNS)
    return once.union(again.dropDuplicates(["doc_id", "text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; a document of which no word is left goes."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    left = found.where("hits.n_words = 0 OR hits.n_hit < hits.n_words")
    cut = decontam.cut_spans(left.withColumn("spans", F.col("hits.spans")))
    return with_text(cut, F.col("text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return pieces.round_trip(docs, tokenizer()).select("doc_id", "tokens.*")


STAGES = [
    ("language_id", language),
    ("line_dedup", shared_lines),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", benchmark),
    ("sentencepiece", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
