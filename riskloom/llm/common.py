"""Helpers shared by the operators: Arrow text access, bounded slices, connected components."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.tables import stored

#: Bytes of text that a task turns into numpy arrays at once; longer texts form a slice of their own.
SLICE_BYTES = 1 << 20


def free_names(table: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the table has, for helper columns that go again."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; NULL is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows of at most `limit` bytes together, one row at least."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def table_batches(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links u-v and the smallest node each is connected with."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[:len(u)], index[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(links: DataFrame, u: str = "u", v: str = "v", rounds: int = 100) -> DataFrame:
    """Connected components: (node, root) for each node of a link, root being the smallest node.

    Alternating stars: every node hands its larger neighbours (first half of a round) and then its
    smaller ones (second half) to the smallest node it knows, until nothing changes. The table has
    at most as many rows as links at any time; each round is written to the shared folder. NULL
    ends and loops link nothing.
    """
    pairs = links.select(F.least(u, v).alias("v"), F.greatest(u, v).alias("u")).where("u > v").distinct()
    pairs = stored(pairs, "links")
    mark = None
    for _ in range(rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
                         .alias("e")).select("e.u", "e.v").where("u > v").distinct())
        pairs = stored(small, "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        mark = now
    raise RuntimeError("components did not settle")
