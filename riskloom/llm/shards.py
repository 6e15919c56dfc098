"""Placing records into shards by rendezvous hashing, with DataFrame functions alone.

Each shard draws a number from the record's key and its own name; the record goes to the shard that
draws best. A shard that is added takes records only into itself, one that leaves gives away only its
own, and a change of one weight moves records only to or from that shard.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import free_names

#: Hex digits of an MD5 that make a draw, and those that make a cell for numbering.
DRAW, CELL = 13, 3


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the key and the shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, DRAW)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** DRAW)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0.. of a key: the smallest -ln(draw) / weight, ties to the lower shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    draws = [F.struct((-F.ln(draw(key, i)) / float(w)).alias("cost"), F.lit(i).alias("shard"))
             for i, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def record_key(column: str) -> Column:
    """The key as text; NULL keys share the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", into: str = "shard") -> DataFrame:
    """Add the shard of each row. No shuffle; equal keys share a shard, rows with a NULL key the one of
    the empty key. All other columns stay; one called `into` is replaced."""
    return docs.withColumn(into, shard_of(record_key(key), weights))


def numbered(docs: DataFrame, order: Column, shard: str = "shard", into: str = "slot") -> DataFrame:
    """Add a gapless number from 0 within each shard, in the order of an MD5 of `order`.

    Rows are ranked within the cell of their leading digits and completed by the counts of the cells
    before it, so that no task sorts a shard. Equal rows take neighbouring numbers in any order. All
    other columns stay; one called `into` is replaced.
    """
    place, cell, n, ahead, at = free_names(docs, "_place", "_cell", "_n", "_before", "_rank")
    marked = docs.withColumn(place, F.md5(order)).withColumn(cell, F.left(place, F.lit(CELL)))
    counts = marked.groupBy(shard, cell).agg(F.count("*").alias(n))
    before = Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    # At most 16 ** CELL rows a shard.
    offsets = counts.select(shard, cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    rank = F.row_number().over(Window.partitionBy(shard, cell).orderBy(place))
    return (marked.withColumn(at, rank).join(offsets, [shard, cell])
            .withColumn(into, F.col(ahead) + F.col(at) - 1)
            .drop(place, cell, at, ahead))


def placed(docs: DataFrame, weights: Sequence[float], grown: Sequence[float],
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot and its shard among `grown`.

    Size is the text's UTF-8 bytes plus one; a NULL text has size 1 and the checksum of no bytes.
    Rows with equal keys share a shard; rows equal in key and text take neighbouring slots.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"))
    identity = F.concat_ws("/", record_key("doc_id"), "text_crc32", "size")
    sharded = assign(rows, weights, "doc_id").withColumn("grown_shard", shard_of(record_key("doc_id"), grown))
    return numbered(sharded, identity).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id") -> None:
    """One folder per shard, written by as many tasks as the data has.

    Rows with a NULL key go to the shard of the empty key, rows that repeat stay together; a column
    `shard` of the table is replaced by the shard, which is in the folders' names.
    """
    assign(docs, weights, key).write.partitionBy("shard").parquet(path)
