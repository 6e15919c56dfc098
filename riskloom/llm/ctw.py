"""Language-model scores by context-tree weighting.

A byte is eight binary decisions, each made at a node: the bits of the byte so far. For every node and
every context of up to DEPTH earlier bytes the training texts give a pair of counts, whose
Krichevsky-Trofimov estimate is mixed with those of all longer contexts: with weight 1/2 a context
stands for itself, with 1/2 for the product over the contexts one byte longer. The counts are frozen,
so the probability of a bit is the exact ratio of two such mixtures.

Counting and scoring read texts in slices of a bounded size. A slice asks for its distinct byte
strings of length DEPTH + 1 (and its distinct words, for the base score), in buckets by recent context;
lists of a bucket are united over all slices. The tree is built upwards and weighed downwards level by
level: in arrays within a bucket, where all longer contexts of a context are, and as joins on whole
numbers above. Every slice gets the code lengths of its own strings alone.
"""

import ctypes
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.jaccard import IS_SPACE, mix, rolling_hashes
from riskloom.sources.tables import scratch_path, stored

#: Bytes of context, and bytes of text that share one list of asked strings.
DEPTH, SLICE = 5, 32 << 20
#: Bytes of context up to which the tree is one of joins; behind it buckets of contexts are arrays.
BASE = 3
#: Slices whose lists of a bucket one task unites.
BAND = 64
#: Keys that a task holds before it unites them.
HELD = 2 << 20
#: Bytes that are arrays at once; a longer text is cut at white space.
PART = 1 << 20
#: The symbol behind the last byte of a text; UTF-8 has no such byte.
END = b"\xff"
SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- texts as arrays


@dataclass
class Stream:
    """Parts of texts one after the other, each behind DEPTH bytes of context."""

    rows: np.ndarray  # the row each part belongs to
    data: np.ndarray
    body: np.ndarray  # marks bytes of text
    coded: np.ndarray  # marks bytes of text and ends
    sizes: np.ndarray  # coded bytes of each part

    def strings(self) -> np.ndarray:
        """Each coded byte with its context, as one number."""
        n = len(self.data) - DEPTH
        out = np.zeros(n, np.int64)
        for d in range(DEPTH + 1):
            out <<= 8
            out |= self.data[d:d + n]
        return out[self.coded[DEPTH:]]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """A negative 63-bit hash of each word, and the part it is in."""
        inside = self.body & ~IS_SPACE[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes = mix(rolling_hashes(self.data, begins, ends)) | np.uint64(1 << 63)
        first = np.cumsum(np.concatenate([[0], np.diff(self.places)]))
        return hashes.view(np.int64), np.searchsorted(first, begins, "right") - 1

    @property
    def places(self) -> np.ndarray:
        """Where the context of each part begins."""
        return np.concatenate([[0], np.cumsum(self.sizes + DEPTH)[:-1]])


def parts(texts: Iterable[bytes]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(row, context, text, end symbol or nothing) of whole texts, or of parts of long ones."""
    for row, text in enumerate(texts):
        low, high = 0, 0
        while low == 0 or high < len(text):
            found = SPACE.search(text, low + PART) if len(text) - low > PART else None
            high = found.start() if found else len(text)
            before = (bytes(DEPTH) + text[max(0, low - DEPTH):low])[-DEPTH:]
            yield row, before, text[low:high], END if high == len(text) else b""
            if high == len(text):
                break
            low = high


def streams(texts: Iterable[bytes]) -> Iterator[Stream]:
    held, size = [], 0
    for part in parts(texts):
        if held and size + len(part[2]) > PART:
            yield stream(held)
            held, size = [], 0
        held.append(part)
        size += len(part[2])
    if held:
        yield stream(held)


def stream(held: list[tuple]) -> Stream:
    data = np.frombuffer(b"".join(b for part in held for b in part[1:]), np.uint8)
    sizes = np.array([len(part[2]) + len(part[3]) for part in held])
    closes = np.array([len(part[3]) for part in held])
    stops = np.cumsum(sizes + DEPTH)
    coded = np.ones(len(data), bool)
    for d in range(DEPTH):
        coded[stops - sizes - DEPTH + d] = False
    body = coded.copy()
    body[stops[closes > 0] - 1] = False
    return Stream(np.array([part[0] for part in held]), data, body, coded, sizes)


def encoded(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 texts with A-Z in lower case, made a few at a time."""
    for low in range(0, len(column), 100):
        for text in column.slice(low, 100).cast(pa.binary()).to_pylist():
            yield text.lower()  # of bytes: ASCII alone


def release() -> None:
    """Give freed memory back, which workers otherwise keep between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys)))


# ---------------------------------------------------------------- passes over the texts


def cut_slices(size: int):
    """Rows of a task with a slice number; a slice ends with the text that fills it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            # Short texts count a little too, so that rows are bounded as well.
            sizes = pa.compute.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            upto = filled + np.cumsum(sizes)
            yield batch.append_column("slice", pa.array(number + (upto - sizes) // size, pa.int64()))
            filled = int(upto[-1]) if len(upto) else filled

    return cut


def packed(numbers: np.ndarray) -> bytes:
    """Ascending whole numbers as the byte planes of their steps, which compress well."""
    return np.diff(numbers, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys, times = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


#: Spreads contexts over buckets; small enough that the product of any context of BASE bytes is a long.
SPREAD = 2654435761


def buckets_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Strings by the last BASE bytes of their context, words behind them by their hash."""
    recent = (keys >> 8) & ((1 << (8 * BASE)) - 1)
    return np.where(keys < 0, count + (keys >> 20) % count, ((recent * SPREAD) >> 12) % count)


def asker(count: int, schema: pa.Schema):
    def asked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of a slice and their times in training texts, a row for each bucket of keys."""

        def told(number: int, found: list) -> pa.RecordBatch:
            keys, times = merged(found)
            place = buckets_of(keys, count)
            order = np.argsort(place, kind="stable")
            keys, times, place = keys[order], times[order], place[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            spans = list(zip(cuts, [*cuts[1:], len(keys)]))
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(len(cuts), number)), pa.array(place[cuts].astype(np.int32)),
                pa.array([packed(keys[a:b]) for a, b in spans], pa.binary()),
                pa.array([packed(times[a:b]) for a, b in spans], pa.binary())], schema=schema)

        number, found = None, []
        for batch in batches:
            numbers = batch["slice"].to_numpy()
            cuts = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1)) if len(numbers) else []
            for low, high in zip(cuts, [*cuts[1:], len(numbers)]):
                if number is not None and numbers[low] != number and found:
                    yield told(number, found)
                    found = []
                number = int(numbers[low])
                trains = batch["trains"].slice(low, high - low).to_numpy(zero_copy_only=False).astype(bool)
                for s in streams(encoded(batch["text"].slice(low, high - low))):
                    learns = trains[s.rows]
                    strings, (words, at) = s.strings(), s.words()
                    for keys, use in ((strings, np.repeat(learns, s.sizes)), (words, learns[at])):
                        found.append(counted(keys[use]))
                        rest, _ = counted(keys[~use])
                        found.append((rest, np.zeros(len(rest), np.int64)))
                    if sum(len(f[0]) for f in found[1:]) > HELD:
                        found = [merged(found)]
        if found:
            yield told(number, found)
        release()

    return asked_keys


def united(key: tuple, table: pa.Table) -> pa.Table:
    """The lists of one bucket as one."""
    lists = zip(table["keys"].to_pylist(), table["times"].to_pylist())
    keys, times = merged([(unpacked(k), unpacked(t)) for k, t in lists])
    return pa.table({"bucket": table["bucket"].slice(0, 1), "keys": pa.array([packed(keys)], pa.binary()),
                     "times": pa.array([packed(times)], pa.binary()),
                     "n": pa.array([int(times.sum())], pa.int64()),
                     "kinds": pa.array([int((times > 0).sum())], pa.int64())})


SCORES = ("doc_id {}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, "
          "score double")


def scorer(end_count: int, tokens: int, kinds: int, schema: pa.Schema):
    """Scores of the texts of a slice, from the code lengths and counts it asked for."""

    def base(count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (tokens + 0.1 * (kinds + 1)))

    def score(key: tuple, rows: pa.Table, given: pa.Table) -> pa.Table:
        told = [(unpacked(k), v) for k, v in zip(given["keys"].to_pylist(), given["values"].to_pylist())]
        tables = []
        for kind, is_word in ((np.int64, True), (np.float32, False)):
            own = [(k, np.frombuffer(v, kind)) for k, v in told if (k[0] < 0) == is_word]
            keys, value = (np.concatenate([x[i] for x in own]) if own else np.zeros(0, kind) for i in (0, 1))
            order = np.argsort(keys)
            tables.append((keys[order], value[order].astype(np.float64)))
        known, words_, base_, score_ = (np.zeros(rows.num_rows) for _ in range(4))
        for s in streams(encoded(rows["text"])):
            strings, (words, at) = s.strings(), s.words()
            order = np.argsort(strings)
            logs = tables[1][1][np.searchsorted(tables[1][0], strings[order])]
            owner = np.repeat(np.arange(len(s.rows)), s.sizes)[order]
            count = tables[0][1][np.searchsorted(tables[0][0], words)] if len(words) else np.zeros(0)
            n = len(s.rows)
            np.add.at(score_, s.rows, np.bincount(owner, logs, minlength=n))
            np.add.at(words_, s.rows, np.bincount(at, minlength=n))
            np.add.at(known, s.rows, np.bincount(at, count > 0, minlength=n))
            np.add.at(base_, s.rows, np.bincount(at, base(count), minlength=n))
        ends = np.full(rows.num_rows, float(end_count))
        sizes = pa.compute.binary_length(rows["text"].cast(pa.binary()))
        release()
        return pa.table({
            "doc_id": rows["doc_id"], "held_out": pa.compute.invert(rows["trains"]),
            "n_bytes": sizes,
            "n_tokens": (words_ + 1).astype(np.int64), "n_known": (known + (ends > 0)).astype(np.int64),
            "base_score": base_ + base(ends), "score": score_ / math.log(10)}).cast(schema)

    return score


# ---------------------------------------------------------------- the tree


def log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, for x >= 0.5."""
    z, rising = x + 8, x
    for i in range(1, 8):
        rising = rising * (x + i)
    return ((z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi)
            + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.ln(rising))


def log_kt(zeros: Column, ones: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return (log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0)
            - F.lit(math.log(math.pi)))


def shorter(depth: int) -> int:
    """Mask that leaves a node the last `depth` bytes of its context."""
    return (1 << (8 * (depth + 1))) - 1


@dataclass
class Level:
    """Nodes of one depth in order, their counts and the logarithm of their mixture."""

    nodes: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    mixed: np.ndarray
    weight: np.ndarray  # of the node's own estimate against longer contexts

    @property
    def estimate(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def log_gamma_of(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps up, for x >= 0.5."""
    z, rising = x + 8, np.prod([x + i for i in range(8)], axis=0)
    return ((z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi)
            + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(rising))


def log_kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma_of(zeros + 0.5) + log_gamma_of(ones + 0.5) - log_gamma_of(zeros + ones + 1.0) - math.log(math.pi)


def nodes_of(keys: np.ndarray, k: int) -> np.ndarray:
    """Node of the k-th decision of each string's last byte: context, then a one and the bits so far."""
    symbol = keys & 255
    return (keys - symbol) | (1 << k) | (symbol >> (8 - k))


def local_levels(keys: np.ndarray, times: np.ndarray) -> list[Level]:
    """Levels BASE to DEPTH of the contexts of one bucket; strings come in order."""
    found = []
    for k in range(8):
        nodes, bit = nodes_of(keys, k), keys >> (7 - k) & 1
        first = np.flatnonzero(np.diff(nodes, prepend=-1))
        found.append((nodes[first], np.add.reduceat(times * (1 - bit), first), np.add.reduceat(times * bit, first)))
    nodes, zeros, ones = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(nodes)
    nodes, zeros, ones = nodes[order], zeros[order].astype(float), ones[order].astype(float)
    levels = [Level(nodes, zeros, ones, log_kt_of(zeros, ones), np.ones(len(nodes)))]
    for depth in range(DEPTH - 1, BASE - 1, -1):
        longer = levels[0]
        up = longer.nodes & shorter(depth)
        order = np.argsort(up, kind="stable")
        first = np.flatnonzero(np.diff(up[order], prepend=-1))
        zeros, ones, below = (np.add.reduceat(x[order], first) for x in (longer.zeros, longer.ones, longer.mixed))
        own = log_kt_of(zeros, ones)
        levels.insert(0, Level(up[order][first], zeros, ones, np.logaddexp(own, below) - math.log(2),
                               1 / (1 + np.exp(np.minimum(below - own, 700.0)))))
    return levels


NODES = "node long, zeros double, ones double, mixed double, weight double"


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of depth BASE of each bucket of strings."""
    for batch in batches:
        for keys, times in zip(batch["keys"].to_pylist(), batch["times"].to_pylist()):
            top = local_levels(unpacked(keys), unpacked(times))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (top.nodes, top.zeros, top.ones, top.mixed, top.weight)],
                ["node", "zeros", "ones", "mixed", "weight"])


def string_logs(key: tuple, strings: pa.Table, paths: pa.Table) -> pa.Table:
    """Log-probability of the last byte of each string of a bucket, from what is above depth BASE."""
    out = []
    for keys, times in zip(strings["keys"].to_pylist(), strings["times"].to_pylist()):
        keys = unpacked(keys)
        levels = local_levels(keys, unpacked(times))
        paths = paths.sort_by("node")
        above, p, rest = (paths[c].to_numpy() for c in ("node", "p", "rest"))
        for depth, level in enumerate(levels, BASE):
            at = np.searchsorted(above, level.nodes & shorter(max(depth - 1, BASE)))
            if depth == BASE:
                above, p, rest = level.nodes, p[at], rest[at]
            else:
                share = rest[at] * level.weight
                above, p, rest = level.nodes, p[at] + share * level.estimate, rest[at] - share
        logs = np.zeros(len(keys))
        for k in range(8):
            one = p[np.searchsorted(above, nodes_of(keys, k))]
            logs += np.log(np.where(keys >> (7 - k) & 1 == 1, one, 1 - one))
        out.append(logs.astype(np.float32).tobytes())
    return pa.table({"bucket": strings["bucket"], "keys": strings["keys"], "values": pa.array(out, pa.binary())})


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [unpacked(t).tobytes() for t in batch["times"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["bucket"], batch["keys"], pa.array(counts, pa.binary())],
                                         ["bucket", "keys", "values"])


def answered(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
    """Each list of a bucket with the values of its keys."""
    row = known.slice(0, 1).to_pylist()[0] if known.num_rows and asked.num_rows else None
    values = []
    if row:
        keys = unpacked(row["keys"])
        value = np.frombuffer(row["values"], np.int64 if keys[0] < 0 else np.float32)
        values = [value[np.searchsorted(keys, unpacked(k))].tobytes() for k in asked["keys"].to_pylist()]
    return pa.table({"slice": asked["slice"], "keys": asked["keys"], "values": pa.array(values, pa.binary())})


def shared_contexts(base: DataFrame) -> DataFrame:
    """(node, p, rest) of every node of depth BASE: what it and the shorter contexts give to a one, and
    the share that is left for longer ones."""
    zeros, ones = F.col("zeros"), F.col("ones")
    gap, short = F.col("below") - F.col("own"), lambda depth: F.col("node").bitwiseAND(F.lit(shorter(depth)))
    weight = 1 / (1 + F.exp(F.least(gap, F.lit(700.0))))
    levels = [base]
    for depth in range(BASE - 1, -1, -1):
        up = levels[0].groupBy(short(depth).alias("node")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("below"))
        mixed = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(gap))) - math.log(2)
        levels.insert(0, stored(up.withColumn("own", log_kt(zeros, ones)).select(
            "node", "zeros", "ones", mixed.alias("mixed"), weight.alias("weight")), "level"))
    estimate = (ones + 0.5) / (zeros + ones + 1)
    path = levels[0].select("node", (F.col("weight") * estimate).alias("p"), (1 - F.col("weight")).alias("rest"))
    for depth in range(1, BASE + 1):
        above = path.select(F.col("node").alias("up"), F.col("p").alias("p_up"), F.col("rest").alias("rest_up"))
        if depth <= 2:  # 255 and 255 * 256 nodes at most, whatever the corpus
            above = F.broadcast(above)
        share = F.col("rest_up") * F.col("weight")
        path = levels[depth].join(above, short(depth - 1) == F.col("up")).select(
            "node", (F.col("p_up") + share * estimate).alias("p"), (F.col("rest_up") - share).alias("rest"))
    return path


# ---------------------------------------------------------------- operator


def language_model_scores(
    docs: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE
) -> DataFrame:
    """Score every text under a model learnt from the rows for which `trains` holds.

    One row per row: doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte. Texts are taken with A-Z in lower case. `score` is the log10 probability of the
    UTF-8 bytes and their end under context-tree weighting; the probabilities of all texts add up to
    one. Tokens are words and one end per text; `base_score` is the log10 probability of the tokens one by one, with 0.1 added to
    each count, and n_known counts those that training has.

    A NULL text is empty and has its end alone, so its bits_per_byte is NULL; a NULL in `trains` means
    held out. Rows that repeat are scored and counted each. Without a training row every bit has
    probability 1/2. Texts of any length are read in parts. An empty table gives no rows; other
    columns are not read. Words are told apart by 63 bits of hash.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(trains, F.lit(False)).alias("trains"))
    schema = rows.withColumn("slice", F.lit(0).cast("long")).schema
    path = scratch_path(docs.sparkSession, "slices")
    rows.mapInArrow(cut_slices(slice_bytes), schema).write.option("compression", "zstd").parquet(path)
    sliced = docs.sparkSession.read.schema(schema).parquet(path)
    size = sliced.agg(F.count_if("trains").alias("texts"), F.count_distinct("slice").alias("slices")).first()
    buckets, bands = 8 * math.ceil(math.sqrt(size["slices"] or 1)), -(-(size["slices"] or 1) // BAND)
    row = T.StructType().add("slice", "long").add("bucket", "integer").add("keys", "binary").add("times", "binary")
    asked = stored(sliced.select("slice", "trains", "text").mapInArrow(
        asker(buckets, to_arrow_schema(row)), row), "asked")

    # Lists of a bucket are united BAND at a time, then over all of them.
    banded = asked.withColumn("band", F.pmod(F.xxhash64("slice"), F.lit(bands)).cast("int"))
    one = "bucket int, keys binary, times binary, n long, kinds long"
    parts = banded.select("bucket", "band", "keys", "times").groupBy("bucket", "band").applyInArrow(united, one)
    lists = stored(parts.groupBy("bucket").applyInArrow(united, one) if bands > 1 else parts, "lists")
    is_word = F.col("bucket") >= buckets
    words = lists.where(is_word).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                                     F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    texts, tokens, kinds = size["texts"], words["n"] + size["texts"], words["kinds"] + (size["texts"] > 0)

    strings = lists.where(~is_word)
    base = stored(strings.select("keys", "times").mapInArrow(grown, NODES), "base")
    recent = F.shiftright("node", 8) * F.lit(SPREAD)
    paths = shared_contexts(base).withColumn("bucket", F.pmod(F.shiftright(recent, 12), F.lit(buckets)).cast("int"))
    answer = "bucket int, keys binary, values binary"
    values = stored(
        strings.groupBy("bucket").cogroup(paths.groupBy("bucket")).applyInArrow(string_logs, answer).unionByName(
            lists.where(is_word).select("bucket", "keys", "times").mapInArrow(word_counts, answer)), "values")
    each_band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    given = banded.select("bucket", "band", "slice", "keys").groupBy("bucket", "band").cogroup(
        values.select("*", each_band).groupBy("bucket", "band")).applyInArrow(
        answered, "slice long, keys binary, values binary")

    ddl = SCORES.format(rows.schema["doc_id"].dataType.simpleString())
    schema = rows.sparkSession.createDataFrame([], ddl).schema
    scored = sliced.groupBy("slice").cogroup(given.groupBy("slice")).applyInArrow(
        scorer(texts, tokens, kinds, to_arrow_schema(schema)), schema)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long")).withColumn("bits_per_byte", bits)
