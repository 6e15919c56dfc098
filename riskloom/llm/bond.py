"""Hard negatives by branch-and-bound scans over vertically stored dimensions.

Vectors are kept in blocks of a bounded number of rows, each dimension of a block a column of its own.
An anchor reads the columns of a block in descending order of its own magnitudes; after every few
columns the smallest and largest contribution that the unread ones can still make bound each score,
and rows leave the candidate bitmap once they can neither reach a window nor its best rows. What is
left after the last column has its exact score. Every block meets every group of anchors once, and
only the best few rows of each meeting travel on.
"""

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.tables import stored

#: Rows of a block, anchors of a group, and columns read between two looks at the bounds.
BLOCK, GROUP, STEP = 8192, 512, 16
#: Whole numbers below this are exact as floating-point numbers, and those below the second as longs.
EXACT, LARGEST = 1 << 53, 1 << 63


class Columns:
    """A block: ids, labels and one array per dimension, with the least and largest value of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.low = columns.min(1) if columns.size else np.zeros(len(columns), columns.dtype)
        self.high = columns.max(1) if columns.size else np.zeros(len(columns), columns.dtype)
        self.by_label: dict[int, Columns] = {}

    def of_label(self, label: int) -> "Columns":
        if label not in self.by_label:
            at = np.flatnonzero(self.labels == label)
            self.by_label[label] = Columns(
                self.ids[at], self.labels[at], np.ascontiguousarray(self.columns[:, at]))
        return self.by_label[label]


def matched_type(columns: np.ndarray, anchors: np.ndarray) -> type:
    """Floating point where it is exact, else whole numbers; scores beyond a long are an error."""
    reach = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (columns, anchors)]
    bound = max(1, len(columns)) * reach[0] * reach[1]
    if bound >= LARGEST:
        raise ValueError("components are too large: a score may not fit in a long")
    return np.float64 if bound < EXACT else np.int64


def scan(block: Columns, anchor: np.ndarray, allowed: np.ndarray, windows: Iterable, best: int) -> tuple:
    """Rows that may be among the `best` highest of a window, their exact scores, and the cells read.

    `windows` are pairs (lowest, highest score), both included; rows outside the mask `allowed` are no
    candidates. Of rows with equal scores all stay.
    """
    windows = list(windows)
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = anchor[order]
    ends = np.stack([weights * block.low[order], weights * block.high[order]])
    after = np.zeros((2, len(order) + 1), ends.dtype)
    after[0, :-1] = np.cumsum(ends.min(0)[::-1])[::-1]
    after[1, :-1] = np.cumsum(ends.max(0)[::-1])[::-1]
    rows, score, read = None, np.zeros(len(block.ids), ends.dtype), 0
    for at in range(0, max(1, len(order)), STEP):
        dims = order[at:at + STEP]
        part = block.columns[dims] if rows is None else block.columns[dims[:, None], rows]
        score = score + weights[at:at + STEP] @ part
        read += part.size
        done = min(at + STEP, len(order))
        least, most = score + after[0, done], score + after[1, done]
        here = allowed if rows is None else allowed[rows]
        keep = np.zeros(len(score), bool)
        for low, high in windows:
            inside = least[here & (least >= low) & (most <= high)]
            bar = max(low, np.partition(inside, -best)[-best]) if len(inside) >= best else low
            keep |= (most >= bar) & (least <= high)
        keep &= here
        if not keep.all():
            rows = np.flatnonzero(keep) if rows is None else rows[keep]
            score = score[keep]
        if not len(score):
            break
    return np.arange(len(block.ids)) if rows is None else rows, score, read


def leaders(block: Columns, rows: np.ndarray, score: np.ndarray, low, high, best: int) -> np.ndarray:
    """Places of the best rows of a window: higher scores first, ties by smaller id."""
    inside = np.flatnonzero((score >= low) & (score <= high))
    return inside[np.lexsort((block.ids[rows[inside]], -score[inside]))[:best]]


def pack(key: tuple, table: pa.Table) -> pa.Table:
    """One row per block: ids in order, labels, and each dimension as the bytes of its column."""
    size = key[0].as_py()
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = pa.compute.list_flatten(table["vector"]).to_numpy()
    columns = np.ascontiguousarray(flat.reshape(len(ids), size)[order].T)
    kind = np.int64
    for smaller in (np.int32, np.int16, np.int8):
        if columns.size == 0 or np.iinfo(smaller).min <= columns.min() and columns.max() <= np.iinfo(smaller).max:
            kind = smaller
    return pa.table({
        "size": pa.array([size], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()),
        "ids": pa.array([ids[order]], pa.list_(pa.int64())),
        "labels": pa.array([table["label"].to_numpy()[order]], pa.list_(pa.int64())),
        "bits": pa.array([np.dtype(kind).itemsize * 8], pa.int32()),
        "columns": pa.array([[c.astype(kind).tobytes() for c in columns]], pa.list_(pa.binary()))})


def opened(table: pa.Table, anchors: np.ndarray) -> Columns:
    row = table.slice(0, 1).to_pylist()[0]
    kind = np.dtype(f"int{row['bits']}")
    ids = np.array(row["ids"], np.int64)
    columns = np.array([np.frombuffer(c, kind) for c in row["columns"]], np.int64).reshape(row["size"], len(ids))
    return Columns(ids, np.array(row["labels"], np.int64), columns.astype(matched_type(columns, anchors)))


TILE = "anchor long, seal long, slot int, target long, found long, score long"


def tile(best: int, other_label: bool):
    """Best rows of one block for each window of each anchor of one group."""

    def meet(key: tuple, blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.split()[0]: [] for f in TILE.split(", ")}
        if blocks.num_rows and anchors.num_rows:
            vectors = pa.compute.list_flatten(anchors["vector"]).to_numpy().reshape(anchors.num_rows, -1)
            block = opened(blocks, vectors)
            vectors = vectors.astype(block.columns.dtype)
            asked = zip(vectors, *(anchors[c].to_pylist() for c in ("id", "seal", "label", "windows")))
            for vector, own, seal, label, windows in asked:
                part = block if other_label else block.of_label(label)
                allowed = part.labels != label if other_label else part.ids != own
                limits = [(-np.inf if w["low"] is None else w["low"], np.inf if w["high"] is None else w["high"])
                          for w in windows]
                rows, score, _ = scan(part, vector, allowed, limits, best)
                for w, (low, high) in zip(windows, limits):
                    at = leaders(part, rows, score, low, high, best)
                    out["anchor"] += [own] * len(at)
                    out["seal"] += [seal] * len(at)
                    out["slot"] += [w["slot"]] * len(at)
                    out["target"] += [w["target"]] * len(at)
                    out["found"] += part.ids[rows[at]].tolist()
                    out["score"] += score[at].astype(np.int64).tolist()
        return pa.table({c: pa.array(v, pa.int32() if c == "slot" else pa.int64()) for c, v in out.items()})

    return meet


def best_of(found: DataFrame, best: int) -> DataFrame:
    """The `best` highest of each anchor and window over all blocks; Spark cuts before the shuffle too."""
    each = Window.partitionBy("anchor", "seal", "slot").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= best)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "vector",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives, from vectors of whole numbers.

    An anchor's positives are the `positives` other ids of its label with the highest inner products;
    its negatives for a positive are the first `negatives` rows of another label with low * positive
    <= 100 * negative <= high * positive. Higher scores come first, ties go to the smaller id.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows whose key,
    label or vector is NULL, or whose vector holds a NULL, take no part; rows that repeat whole count
    once, and rows of one id with different content are rows of their own that are no partners of each
    other as positives. Vectors meet those of their own length alone; empty ones have the score 0. An
    empty table gives no rows, other columns are not read. Components so large that a score may not fit
    in a long are an error.
    """
    known = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<bigint>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    known = known.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    seal = F.xxhash64("id", "label", "vector")
    table = stored(known.dropDuplicates(["id", "label", "vector"]).withColumn("seal", seal)
                   .withColumn("size", F.size("vector")), "vectors")
    counts = table.agg(F.count("*").alias("rows"), F.count_if("asks").alias("anchors")).first()
    blocks, groups = -(-counts["rows"] // block) or 1, -(-counts["anchors"] // group) or 1
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    placed = table.withColumn("block", F.pmod(F.xxhash64("seal"), F.lit(blocks)).cast("long"))
    upright = stored(
        placed.select("size", "block", "id", "label", "vector").groupBy("size", "block").applyInArrow(
            pack, "size int, block long, ids array<long>, labels array<long>, bits int, columns array<binary>"),
        "columns")
    anchors = table.where("asks").withColumn("group", F.pmod(F.xxhash64("seal", F.lit(1)), F.lit(groups)).cast("long"))
    keys = ["size", "block", "group"]
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    each_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")

    def meetings(asked: DataFrame, best: int, other_label: bool) -> DataFrame:
        left = upright.select("*", each_group).repartition(parts, *keys).groupBy(*keys)
        right = asked.select("*", each_block).repartition(parts, *keys).groupBy(*keys)
        return best_of(left.cogroup(right).applyInArrow(tile(best, other_label), TILE), best)

    open_window = F.array(F.struct(F.lit(0).alias("slot"), F.lit(0).cast("long").alias("target"),
                                   F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    nearest = stored(meetings(anchors.withColumn("windows", open_window), positives, False), "positives")
    # 50 p <= 100 n <= 95 p in whole numbers: n from the ceiling of the one to the floor of the other.
    p = F.col("score").cast("decimal(20,0)")
    limits = nearest.groupBy("anchor", "seal").agg(F.array_agg(F.struct(
        F.col("rank").alias("slot"), F.col("score").alias("target"),
        F.ceil(p * low / F.lit(100)).cast("long").alias("low"),
        F.floor(p * high / F.lit(100)).cast("long").alias("high"))).alias("windows"))
    asked = anchors.join(limits.withColumnRenamed("anchor", "id"), ["id", "seal"])
    found = meetings(asked, negatives, True)
    pairs = nearest.select("anchor", "seal", F.col("rank").alias("slot"), F.col("found").alias("positive"))
    return found.join(pairs, ["anchor", "seal", "slot"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("found").alias("negative_id"), F.col("target").alias("positive_score"),
        F.col("score").alias("negative_score"))
