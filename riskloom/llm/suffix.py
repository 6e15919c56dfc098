"""Exact removal of repeated byte strings by difference-cover suffix sorting.

Suffixes that can share `length` bytes are brought together first. The smallest GRAM-byte hash within
each window of `length` bytes is its anchor, so equal windows have equal anchors at equal places;
consecutive windows with one anchor make a stretch. Anchors and stretches that occur once are settled
by counting, as are stretches equal as a whole. What is left, unequal stretches with one anchor, is
suffix-sorted shard by shard with the difference cover {1, 2} modulo 3: triples at the sampled places
are sorted and named, the names are sorted by recursion, the other suffixes are merged in, and
neighbours in that order are compared over `length` bytes.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_names, slices, text_bytes
from riskloom.sources.tables import stored

GRAM = 32
#: Bytes of stretches that one suffix sort takes; names of triples then fit 21 bits.
SHARD = 1 << 20
#: Anchors with more unequal stretches than this are refined by runs of RUN windows before sorting.
CROWD, RUN = 1000, 16
#: Longer texts are cut, with an overlap, before anchors are looked for.
PART = 1 << 22
#: Places of stretches up to this size go to every task.
BROADCAST_BYTES = 64 << 20

_random = np.random.default_rng(20240302)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0x5851F42D4C957F2D)
BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
PLACE = np.uint64((1 << 24) - 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place."""
    n = len(data)
    sums = np.concatenate([np.zeros(1, np.uint64),
                           np.cumsum(BYTE_VALUE[data] * powers(STEP, n)[:n], dtype=np.uint64)])
    out = (sums[size:] - sums[:-size]) * powers(BACK, n)[:n - size + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for every window start the place of the window's smallest (leftmost) gram."""
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    low = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    count, done = len(low) - width + 1, 1
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    return hashes, (np.minimum(low[:count], low[width - done:width - done + count]) & PLACE).astype(np.int64)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(anchor hash, first byte, number of windows, text) of every stretch of a slice of texts."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, np.uint64), empty, empty, empty
    hashes, place = anchors(data, length, gram)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(place)]
    at = np.flatnonzero(np.arange(len(place)) + length <= offsets[owner + 1])
    if not len(at):
        return np.empty(0, np.uint64), empty, empty, empty
    fresh = np.concatenate([[True], (place[at][1:] != place[at][:-1]) | (owner[at][1:] != owner[at][:-1])])
    starts = np.flatnonzero(fresh)
    first = at[starts]
    return hashes[place[first]], first, np.diff(np.append(starts, len(at))), owner[first]


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank, from 1, of every suffix of a sequence of numbers above 0."""
    n = len(text)
    pad = np.concatenate([text, np.zeros(3, np.int64)])
    base = int(text.max(initial=0)) + 1
    # The cover {1, 2} modulo 3; a last empty triple keeps the two halves of the names apart.
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    kinds, names = np.unique((pad[sample] * base + pad[sample + 1]) * base + pad[sample + 2], return_inverse=True)
    found = names.astype(np.int64) + 1
    if len(kinds) < len(sample):
        found = suffix_ranks(found)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = found
    scale = len(sample) + 1
    # Merge: the place of each other suffix among those at 1 and those at 2 modulo 3.
    rest = np.arange(0, n, 3)
    key = pad[rest] * scale + rank[rest + 1]
    order = np.argsort(key, kind="stable")
    rest, key = rest[order], key[order]
    sorted_sample = sample[np.argsort(found)]
    sorted_sample = sorted_sample[sorted_sample < n]
    one, two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(pad[one] * scale + rank[one + 1], key)
    before += np.searchsorted((pad[two] * base + pad[two + 1]) * scale + rank[two + 2],
                              (pad[rest] * base + pad[rest + 1]) * scale + rank[rest + 2])
    out = np.empty(n, np.int64)
    taken = before + np.arange(len(rest))
    out[rest] = taken
    free = np.ones(n, bool)
    free[taken] = False
    out[sorted_sample] = np.flatnonzero(free)
    return out + 1


def repeated_windows(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(body, window) of every window of `length` bytes that two of the bodies' windows share."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    offsets = np.cumsum([0] + [len(b) for b in bodies])
    ranks = suffix_ranks(data.astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(bodies)), np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(data)) + length <= offsets[owner + 1])
    starts = starts[np.argsort(ranks[starts])]
    # Neighbours in suffix order, compared eight bytes at a time.
    left, right = starts[:-1], starts[1:]
    words = np.lib.stride_tricks.as_strided(
        np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
    same = np.arange(len(left))
    for k in [*range(0, length - 7, 8), length - 8]:
        a = words[left[same] + k].view(np.uint64).ravel()
        b = words[right[same] + k].view(np.uint64).ravel()
        same = same[a == b]
    hit = np.zeros(len(starts), bool)
    hit[same] = hit[same + 1] = True
    found = np.sort(starts[hit])
    return owner[found], found - offsets[owner[found]]


def window_runs(owner: np.ndarray, window: np.ndarray, length: int):
    """(owner, first byte, byte after the last) of runs of consecutive windows."""
    if not len(owner):
        return owner, window, window
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], window[first], window[last] + length


def find_stretches(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, digest, node, first, windows) of every stretch of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for low, high in slices(offsets):
                # A text beyond PART bytes is a slice of its own and comes in parts.
                end = offsets[high]
                for begin in range(offsets[low], max(end, offsets[low] + 1), PART if high - low == 1 else end + 1):
                    part = data[begin:min(end, begin + PART + length - 1) if high - low == 1 else end]
                    own = offsets[low:high + 1] - begin if high - low > 1 else np.array([0, len(part)])
                    anchor, first, windows, owner = stretches(part, own, length, gram)
                    raw = part.tobytes()
                    digest = np.array([xxhash.xxh3_64_intdigest(raw[i:i + w - 1 + length])
                                       for i, w in zip(first.tolist(), windows.tolist())], np.uint64)
                    shift = begin - offsets[low]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)),
                         pa.array(nodes[low + owner], pa.int64()), pa.array(first - own[owner] + shift, pa.int64()),
                         pa.array(windows, pa.int32())], ["anchor", "digest", "node", "first", "windows"])

    return texts.mapInArrow(run, "anchor long, digest long, node long, first long, windows int")


RANGES = "anchor long, digest long, low int, high int"


def sort_shards(bodies: DataFrame, length: int) -> DataFrame:
    """Byte ranges of each stretch whose windows another stretch has too, by suffix sorting.

    The stretches of one anchor go to one shard; CROWD of them at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows):
            owner, low, high = window_runs(*repeated_windows([r[2] for r in rows], length), length)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in owner], pa.int64()), pa.array([rows[i][1] for i in owner], pa.int64()),
                 pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["anchor", "digest", "low", "high"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield from settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield from settle(held)

    return (bodies.select("anchor", "digest", "body").repartition("anchor")
            .sortWithinPartitions("anchor").mapInArrow(run, RANGES))


def settle_windows(bodies: DataFrame, length: int) -> DataFrame:
    """The same ranges for crowded anchors: windows of different stretches are counted by 128-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, digest, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                count = len(body) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * count, pa.int64()), pa.array([digest] * count, pa.int64()),
                     pa.array(range(count), pa.int32()),
                     pa.array([xxhash.xxh3_128_digest(body[i:i + length]) for i in range(count)])],
                    ["anchor", "digest", "low", "hash"])

    windows = bodies.select("anchor", "digest", "body").mapInArrow(
        run, "anchor long, digest long, low int, hash binary")
    shared = windows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    return windows.join(shared, "hash").select(
        "anchor", "digest", "low", (F.col("low") + length).cast("int").alias("high"))


def refine(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    """Cut the stretches of crowded anchors into runs of at most RUN windows, with finer keys.

    Runs are aligned at the anchor, so equal windows fall into runs alike; the key is a hash of the
    anchor, the run's place and the bytes that all windows of a full run have in common.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, digest, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                place = int(anchors(np.frombuffer(body, np.uint8), length, gram)[1][0])
                count = len(body) - length + 1
                for k in range(max(0, place - count + 1) // RUN, place // RUN + 1):
                    first, last = place - RUN * k - RUN + 1, place - RUN * k
                    core = body[last:first + length]
                    low, high = max(first, 0), min(last, count - 1)
                    key = xxhash.xxh3_64_intdigest(b"%d/%d/" % (anchor, k) + core)
                    part = body[low:high + length]
                    out.append((anchor, digest, low, key, xxhash.xxh3_64_intdigest(part), part))
            a, d, low, key, sub, part = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(low, pa.int32()),
                 pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(np.array(sub, np.uint64).view(np.int64)),
                 pa.array(part, pa.binary())], ["anchor", "digest", "shift", "key", "sub", "body"])

    return bodies.select("anchor", "digest", "body").mapInArrow(
        run, "anchor long, digest long, shift int, key long, sub long, body binary")


def settle_crowds(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    """The ranges of stretches with crowded anchors: refined, then sorted; what is still crowded is
    settled window by window."""
    runs = stored(refine(bodies, length, gram), "runs")
    counts = runs.groupBy("key", "sub").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).where("rows > 1")
    marked = stored(runs.join(counts.join(kinds, "key").select("key", "sub", "n", "kinds"), ["key", "sub"]), "runs")
    whole = marked.where("n > 1").select(
        "anchor", "digest", F.col("shift").alias("low"), (F.col("shift") + F.octet_length("body")).alias("high"))
    unequal = (marked.where("kinds > 1").groupBy("key", "sub", "kinds").agg(F.min("body").alias("body"))
               .select(F.col("key").alias("anchor"), F.col("sub").alias("digest"), "kinds", "body"))
    found = sort_shards(unequal.where(f"kinds <= {CROWD}"), length).union(
        settle_windows(unequal.where(f"kinds > {CROWD}"), length)).select(
        F.col("anchor").alias("key"), F.col("digest").alias("sub"), "low", "high")
    part = marked.where("n = 1").select("anchor", "digest", "key", "sub", "shift").join(found, ["key", "sub"]).select(
        "anchor", "digest", F.col("shift") + F.col("low"), F.col("shift") + F.col("high"))
    return whole.union(part)


def repeated_spans(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(node, spans) of the rows (node, text): byte ranges covered by strings that start elsewhere too."""
    found = find_stretches(texts, length, gram)
    counts = found.groupBy("anchor", "digest").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).where("rows > 1")
    marks = stored(counts.join(kinds, "anchor").select("anchor", "digest", "n", "kinds"), "marks")
    shared = stored(found.join(marks, ["anchor", "digest"]), "shared")

    # One place of each stretch that shares its anchor with others.
    places = (shared.where("kinds > 1").groupBy("anchor", "digest", "kinds")
              .agg(F.min(F.struct("node", "first", "windows")).alias("p"))
              .groupBy("p.node").agg(F.collect_list(F.struct(
                  "anchor", "digest", "kinds", F.col("p.first").alias("first"),
                  F.col("p.windows").alias("windows"))).alias("places")))
    places = stored(places, "places")
    size = places.agg(F.sum(F.size("places"))).first()[0] or 0
    near = F.broadcast(places) if size * 48 <= BROADCAST_BYTES else places
    # A node has rows of equal texts; one of them is enough.
    with_text = texts.join(near, "node").dropDuplicates(["node"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spots in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                out += [(s["anchor"], s["digest"], s["kinds"], raw[s["first"]:s["first"] + s["windows"] - 1 + length])
                        for s in spots.as_py()]
            a, d, k, b = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.binary())],
                ["anchor", "digest", "kinds", "body"])

    bodies = stored(with_text.select("text", "places").mapInArrow(
        extract, "anchor long, digest long, kinds long, body binary"), "bodies")
    ranges = sort_shards(bodies.where(f"kinds <= {CROWD}"), length).union(
        settle_crowds(bodies.where(f"kinds > {CROWD}"), length, gram))
    partial = (shared.where("n = 1").select("anchor", "digest", "node", "first").join(ranges, ["anchor", "digest"])
               .select("node", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high")))
    whole = shared.where("n > 1").select(
        "node", F.col("first").alias("low"), (F.col("first") + F.col("windows") - 1 + length).alias("high"))
    return whole.union(partial).groupBy("node").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, gram: int = GRAM,
                   into: str = "kept") -> DataFrame:
    """Add a struct: n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept.

    Every byte is removed that a string of `length` bytes covers which starts at another place of any
    row too; rows count one by one, so rows of equal texts of `length` bytes or more lose everything.
    Spans are maximal runs of removed bytes; what is kept need not be valid UTF-8. NULL is an empty
    text. All rows and columns stay, but one called `into` is replaced; rows are told apart by their
    text alone (64-bit hash).
    """
    if length < 2 * gram or length > 1 << 12:
        raise ValueError("length must be at least twice gram and at most 4096")
    body, node, found_spans = free_names(docs, "_text", "_node", "_spans")
    marked = docs.withColumns({body: F.coalesce(F.col(text), F.lit("")),
                               node: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    texts = marked.select(F.col(node).alias("node"), F.col(body).alias("text"))
    spans = stored(repeated_spans(texts, length, gram), "spans").withColumnsRenamed(
        {"node": node, "spans": found_spans})

    @F.arrow_udf(RESULT)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, found in batches:
            rows = []
            for value, runs in zip(column, found):
                raw = value.as_py().encode()
                merged = []
                for run in sorted((r["low"], r["high"]) for r in runs.as_py() or ()):
                    if merged and run[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], run[1])
                    else:
                        merged.append(list(run))
                kept, at = [], 0
                for low, high in merged:
                    kept.append(raw[at:low])
                    at = high
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = marked.join(spans, node, "left")
    return joined.withColumn(into, cut(F.col(body), F.col(found_spans))).drop(body, node, found_spans)
