"""Scoring frames: one row per case with key `id`, target `yd` and numeric features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.tables import SENTINEL, sentinel_to_null

QUALITY_FEATURES = ["k_chars", "word_density", "digit_share", "toxic"]
ORDER_FEATURES = ["price", "balance", "quantity", "discount", "tax", "lines"]
EVENT_FEATURES = ["value", "k", "hour"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: low quality against simple measures of the whole text."""
    text = F.col("text")
    size = F.greatest(F.length(text), F.lit(1))
    measures = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        (F.length(text) / 1000).alias("k_chars"),
        ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / size).alias("word_density"),
        ((F.length(text) - F.length(F.translate(text, "0123456789", ""))) / size).alias("digit_share"),
    )
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        (1 - F.col("quality")).cast("int").alias("yd"),
        F.col("toxic").cast("double").alias("toxic"),
    )
    return labels.join(measures, "id").select("id", "yd", *QUALITY_FEATURES)


def orders_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status F against price and balance (thousands) and lines; no lines leave NULLs."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.avg("l_discount").alias("discount"),
            F.avg("l_tax").alias("tax"),
            F.count("*").cast("double").alias("lines"),
        )
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 1000).alias("balance")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("yd"),
        (F.col("o_totalprice") / 1000).alias("price"),
    )
    return (
        orders.join(lines, "id", "left")
        .join(customers, "o_custkey", "left")
        .select("id", "yd", *ORDER_FEATURES)
    )


def coded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events; a reading whose counter is below 3 carries the missing-value code."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "error").cast("int").alias("yd"),
        F.when(k < 3, F.lit(SENTINEL)).otherwise(F.col("value")).alias("value"),
        k.alias("k"),
        F.hour("ts").cast("double").alias("hour"),
    )


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentinel_to_null(coded_events(spark, sf_dir), EVENT_FEATURES)
