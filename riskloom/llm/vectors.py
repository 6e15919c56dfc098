"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated to their principal axes and cut into blocks. Two vectors of cosine c have the
squared distance 2 - 2c; each block gets a share of that budget in proportion to its variance, and a
pair within the whole budget is within its share in one block at least. Each block is joined by a grid
over its two widest axes, the block distance selects the candidates, and their cosine decides. Vectors
of each length have axes, blocks and grids of their own.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import components, local_components
from riskloom.sources.tables import stored

#: A cell's vectors are dealt to chunks of at most so many; a task joins two chunks.
CHUNK = 4096
#: Rows of a chunk compared at once with the other chunk.
ROWS = 256
FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """One unit vector per row, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1)
    # Scaling first keeps squares of very large or small components finite.
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Every length of a batch's vectors with the rows that have it."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths).tolist():
        yield size, pa.array(np.flatnonzero(lengths == size))


def rotations(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the axes (columns) and variances, widest first, of its unit vectors."""
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, rows in by_length(batch.column(0)):
                x = matrix(batch.column(0).take(rows))
                total[size] = total.get(size, 0) + x.T @ x
        for size, sums in total.items():
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(sums[i, j])], ["size", "i", "j", "v"])

    sums = (classes.select("vector").mapInArrow(gram, "size int, i int, j int, v double")
            .groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect())  # size * (size + 1) / 2 rows a length
    grams: dict[int, np.ndarray] = {}
    for r in sums:
        out = grams.setdefault(r["size"], np.zeros((r["size"], r["size"])))
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    found = {}
    for size, out in grams.items():
        values, axes = np.linalg.eigh(out)
        found[size] = axes[:, ::-1], np.maximum(values[::-1], 0)
    return found


class Blocks:
    """Which axes make a block, its share of the budget, and the grid over its two widest axes."""

    def __init__(self, axes: np.ndarray, values: np.ndarray, count: int, cosine: float):
        self.axes = axes
        size = len(values)
        count = max(1, min(count, size // 2 or 1))
        order = np.arange(size)
        turn = np.where((order // count) % 2 == 0, order % count, count - 1 - order % count)
        self.parts = [np.flatnonzero(turn == b) for b in range(count)]
        spread = np.array([values[p].sum() for p in self.parts]) + 1e-6 * (values.sum() + 1e-300)
        self.budgets = (2 - 2 * cosine) * spread / spread.sum() + SLACK
        self.widths = np.sqrt(self.budgets) * (1 + 1e-6)
        self.cosine = cosine

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Grid cell of every vector in every block: (rows, blocks, 2)."""
        out = np.zeros((len(unit), len(self.parts), 2), np.int32)
        for b, part in enumerate(self.parts):
            at = unit @ self.axes[:, part[:2]]
            out[:, b, :at.shape[1]] = np.floor(at / self.widths[b])
        return out


def spread_out(number: np.ndarray) -> np.ndarray:
    x = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(33)).astype(np.int64)


def join_chunks(blocks: Blocks, block: int, same: bool, left: tuple, right: tuple):
    """Links of two chunks that this block is the first to find: weights per vector and a forest."""
    ids_a, n_a, x_a = left
    ids_b, n_b, x_b = right
    y_a, y_b = x_a @ blocks.axes, x_b @ blocks.axes
    part = blocks.parts[block]
    a, b = y_a[:, part].astype(np.float32), y_b[:, part].astype(np.float32)
    a = np.concatenate([-2 * a, (a * a).sum(1, keepdims=True), np.ones((len(a), 1), np.float32)], axis=1)
    b = np.concatenate([b, np.ones((len(b), 1), np.float32), (b * b).sum(1, keepdims=True)], axis=1).T
    near = np.float32(blocks.budgets[block] + 1e-5)
    weight_a, weight_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    forest_u, forest_v = [], []
    for low in range(0, len(ids_a), ROWS):
        i, j = np.nonzero(a[low:low + ROWS] @ b <= near)
        i += low
        keep = i < j if same else slice(None)
        i, j = i[keep], j[keep]
        linked = []
        for at in range(0, len(i), 1 << 16):
            p, q = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            good = np.einsum("ij,ij->i", x_a[p], x_b[q]) >= blocks.cosine
            p, q = p[good], q[good]
            squares = (y_a[p] - y_b[q]) ** 2
            first = np.ones(len(p), bool)
            for k in range(block):
                first &= squares[:, blocks.parts[k]].sum(1) > blocks.budgets[k]
            first &= squares[:, part].sum(1) <= blocks.budgets[block]
            linked.append((p[first], q[first]))
        if not linked:
            continue
        p, q = np.concatenate([x for x, _ in linked]), np.concatenate([x for _, x in linked])
        np.add.at(weight_a, p, n_b[q])
        np.add.at(weight_b, q, n_a[p])
        if len(p):
            node, root = local_components(ids_a[p], ids_b[q])
            forest_u.append(node[node != root])
            forest_v.append(root[node != root])
    if forest_u:
        node, root = local_components(np.concatenate(forest_u), np.concatenate(forest_v))
        forest_u, forest_v = node[node != root], root[node != root]
    return weight_a, weight_b, np.array(forest_u, np.int64), np.array(forest_v, np.int64)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    cosine: float = 0.9, blocks: int = 4) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    n_links counts the other rows of the same length and cosine >= `cosine`, component_id is the
    smallest key reachable by links and kept marks it. Vectors that are NULL, all zero, or with a
    NULL or non-finite component link with nothing, nor do rows with a NULL key (component_id NULL,
    not kept). Equal vectors are one class that is joined once, so copies cost nothing beyond their
    rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    usable = (F.col("vector").isNotNull() & (F.size("vector") > 0)
              & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull())
    classes = stored(rows.where(usable).groupBy("vector").agg(
        F.min("id").alias("class"), F.count("*").alias("n")), "classes")
    # A class that is alone in its length has nothing to be joined with.
    number = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d"))
              .agg(F.count("*").alias("n")).where("n > 1").collect()}
    joinable = classes.where(F.size("vector").isin(list(number)))
    plans = {d: Blocks(*found, blocks, cosine) for d, found in rotations(joinable).items()}
    held = spark.sparkContext.broadcast(plans)  # size * size numbers for each length

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, of in by_length(batch.column(0)):
                cells = held.value[size].cells(matrix(batch.column(0).take(of)))
                b = np.broadcast_to(np.arange(cells.shape[1], dtype=np.int32), cells.shape[:2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.size, size), pa.int32()), pa.array(b.ravel()),
                     pa.array(cells[..., 0].ravel()), pa.array(cells[..., 1].ravel())],
                    ["size", "block", "cx", "cy"])

    # Coordinates of unit vectors are within 1, so the number of cells has a bound.
    filled = {(r["size"], r["block"], r["cx"], r["cy"]): r["n"] for r in
              joinable.select("vector").mapInArrow(count_cells, "size int, block int, cx int, cy int")
              .groupBy("size", "block", "cx", "cy").agg(F.count("*").alias("n")).collect()}
    limit = {d: min(CHUNK, max(256, n // 16)) for d, n in number.items()}
    home = {c: -(-n // limit[c[0]]) for c, n in filled.items()}
    guests = {(d, b, x, y): -(-sum(filled.get((d, b, x - i, y - j), 0) for i, j in FORWARD) // limit[d])
              for d, b, x, y in filled}
    dealt = spark.sparkContext.broadcast((home, guests))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visitors = dealt.value
        for batch in batches:
            tasks: dict[str, list] = {"row": [], "task": [], "side": []}

            def put(row, cell, kind, i, j, side):
                tasks["row"].append(row)
                tasks["task"].append("/".join(map(str, (*cell, kind, i, j))))
                tasks["side"].append(side)

            salts = spread_out(batch.column(0).to_numpy())
            for size, of in by_length(batch.column(2)):
                cells = held.value[size].cells(matrix(batch.column(2).take(of)))
                for at, row in enumerate(of.to_pylist()):
                    salt = int(salts[row])
                    for b in range(cells.shape[1]):
                        x, y = cells[at, b].tolist()
                        k = homes[size, b, x, y]
                        i = salt % k
                        for j in range(k):
                            put(row, (size, b, x, y), "own", min(i, j), max(i, j), 0 if i <= j else 1)
                        for j in range(visitors[size, b, x, y]):
                            put(row, (size, b, x, y), "next", i, j, 0)
                        for dx, dy in FORWARD:
                            cell = size, b, x + dx, y + dy
                            if cell in homes:
                                j = salt % visitors[cell]
                                for i2 in range(homes[cell]):
                                    put(row, cell, "next", i2, j, 1)
            take = pa.array(tasks["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tasks["task"], pa.string()), pa.array(tasks["side"], pa.int8()), batch.column(0).take(take),
                 batch.column(1).take(take), batch.column(2).take(take)], ["task", "side", "class", "n", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()

    def join(group: pa.Table) -> pa.Table:
        name = group.column("task")[0].as_py().split("/")
        size, block, own = int(name[0]), int(name[1]), name[4] == "own"
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        ids, n = group.column("class").to_numpy(), group.column("n").to_numpy()
        x = matrix(group.column("vector").chunk(0))
        # A chunk joined with itself comes once, all on side 0.
        same = own and name[5] == name[6]
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        wa, wb, u, v = join_chunks(held.value[size], block, same, (ids[a], n[a], x[a]), (ids[b], n[b], x[b]))
        node = np.concatenate([ids[a], ids[b], u])
        links = np.concatenate([wa, wb, np.zeros(len(u), np.int64)])
        root = pa.array(np.concatenate([np.zeros(len(wa) + len(wb), np.int64), v]),
                        mask=np.arange(len(node)) < len(wa) + len(wb))
        use = pa.array((links > 0) | (np.arange(len(node)) >= len(wa) + len(wb)))
        return pa.table({"node": node, "links": links, "root": root}).filter(use)

    found = stored(
        joinable.select("class", "n", "vector")
        .mapInArrow(deal, f"task string, side byte, class long, n long, vector {kind}")
        .groupBy("task").applyInArrow(join, "node long, links long, root long"), "found")
    links = found.where("root IS NULL").groupBy(F.col("node").alias("class")).agg(F.sum("links").alias("links"))
    roots = components(found.where("root IS NOT NULL"), "node", "root").withColumnRenamed("node", "class")
    described = (classes.join(links, "class", "left").join(roots, "class", "left")
                 .select("vector", "class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                         F.coalesce("root", "class").alias("component")))
    joined = rows.withColumn("_use", F.coalesce(usable, F.lit(False))).withColumn(
        "vector", F.when(F.col("_use"), F.col("vector"))).join(described, "vector", "left")
    return joined.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"))
