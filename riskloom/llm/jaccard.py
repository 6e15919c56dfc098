"""Exact n-gram Jaccard join by vertical partitioning.

The hash order of all n-grams is the global order, and it is cut into fragments. Documents that may be
alike differ in at most h n-grams altogether (a bound from their sizes), so with more than h fragments
that are not empty one fragment of them is equal as a whole: equal fragments make the candidates. For
a candidate pair the overlap is counted fragment by fragment and summed. Documents already connected
need no further comparison, so a group of copies costs links in proportion to its size.

A set with f filled fragments shares at least f - h of them with any set it may link with. So it can do
without its f - h - 1 most frequent keys, and a set that shares fewer keys than that with all others
together takes no further part.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import components, slices, text_bytes
from riskloom.llm.decontam import BYTE_VALUE
from riskloom.sources.tables import stored

#: Ranges of the global order in which overlaps are counted.
FRAGMENTS = 8
#: Sizes of one class grow by this factor; documents of one class share its cuts.
GROWTH = 1.5
#: 64-bit words of a signature, and rounds of comparing with hubs before all remaining pairs.
SIGNATURE, ROUNDS = 8, 3
#: Partners of a hub whose overlaps one part of it counts.
PARTNERS = 500
#: Members of a key that one task pairs with all its members.
CROWD = 1000
#: The lowest bits of a key name its size class.
CLASS_BITS = np.uint64(127)
#: Lists of asked nodes up to this size go to every task.
BROADCAST_BYTES = 64 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Nodes a task remembers in order to send the keys of equal texts once.
REMEMBERED = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers; sorting in place beats np.unique, which hashes them first."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def rolling_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes, from running sums of value(byte) * ODD ** place, modulo 2 ** 64."""
    scale = np.full(len(data) + 1, ODD)
    scale[0] = 1
    np.multiply.accumulate(scale, out=scale)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * scale[:-1], out=sums[1:])
    back = np.full(len(data) + 1, np.uint64(pow(int(ODD), -1, 1 << 64)))
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return (sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """The sorted distinct n-gram hashes of each text of a slice, text by text."""
    data = LOWER[data]
    inside = ~IS_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    # A text begins a new word even where the one before it ends in one.
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = inside[first]
    begins = np.flatnonzero(starts)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | starts[1:]
    ends = np.flatnonzero(last) + 1
    words = mix(rolling_hashes(data, begins, ends))
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams = grams * ODD + words[k:k + len(grams)]
    grams = mix(grams + np.uint64(width))
    cuts = np.searchsorted(begins, offsets)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if high - low >= width:
            yield distinct(grams[low:high - width + 1])
        elif high > low:
            whole = np.zeros(1, np.uint64)
            for k in range(low, high):
                whole = whole * ODD + words[k]
            yield mix(whole + np.uint64(high - low))
        else:
            yield np.empty(0, np.uint64)


class Cuts:
    """Size classes, the differences each allows, and its number of fragments."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be above 0 and at most 100")
        # The first class ends where a single difference becomes possible.
        start = -(-(100 + percent) // (2 * (100 - percent))) if percent < 100 else 1 << 41
        self.percent, self.lows = percent, [1, start] if start > 1 else [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * GROWTH)))
        self.allowed = [(100 - percent) * 2 * (high - 1) // (100 + percent)
                        for high in self.lows[1:]]
        self.fragments = [1 if h == 0 else int(1.08 * (h + 1)) + 4 for h in self.allowed]

    def classes(self, size: int) -> range:
        """The classes of all sizes that are not smaller and may go with this one."""
        low = np.searchsorted(self.lows, size, "right") - 1
        high = np.searchsorted(self.lows, size * 100 // self.percent, "right") - 1
        return range(int(low), int(high) + 1)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """One key for each fragment that is not empty, in each class of this set."""
        out, spread = [], mix(tokens ^ ODD)
        for c in self.classes(len(tokens)):
            place, starts = self.filled(tokens, c)
            named = len(out)
            found = np.add.reduceat(spread, starts)
            label = np.uint64((c + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
            out.append(mix(found + label + place[starts] * ODD))
            if len(starts) <= self.allowed[c]:
                # Too few fragments to be sure of an equal one: any common n-gram is a key. Two sets
                # that are both so share one; otherwise the other set has fragments enough.
                out.append(mix(tokens + label + np.uint64(1)))
            out[named:] = [(k & ~CLASS_BITS) | np.uint64(c) for k in out[named:]]
        return np.concatenate(out)

    def filled(self, tokens: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The fragment of each n-gram in a class, and where each fragment that is not empty starts."""
        place = ((tokens >> np.uint64(32)) * np.uint64(self.fragments[c])) >> np.uint64(32)
        return place, np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))

    def needs(self, tokens: np.ndarray) -> list[int]:
        """For each class of this set, the keys it shares at least with a set that it links with there."""
        n, out = len(tokens), []
        for c in self.classes(n):
            largest = min(n * 100 // self.percent, self.lows[c + 1] - 1)
            out.append(len(self.filled(tokens, c)[1]) - (100 - self.percent) * (n + largest) // (100 + self.percent))
        return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signature(tokens: np.ndarray) -> list[int]:
    """Parity bitmap of a set: two sets differ in at least as many n-grams as their bitmaps in bits."""
    bits = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (64 * SIGNATURE - 1),
                       minlength=64 * SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def sizes(docs: DataFrame, text: str, width: int, percent: int, into: str) -> DataFrame:
    """Add a struct: the number n of distinct n-grams of each text, the signature of their set, the first
    of its size classes and what it needs in each."""
    @F.arrow_udf("n int, bits array<long>, first int, needs array<int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cuts = Cuts(percent)
        for column in batches:
            data, offsets = text_bytes(column)
            n, bits, first, needs = [], [], [], []
            for a, b in slices(offsets):
                for tokens in shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width):
                    n.append(len(tokens))
                    bits.append(signature(tokens))
                    first.append(cuts.classes(len(tokens)).start if len(tokens) else 0)
                    needs.append(cuts.needs(tokens) if len(tokens) else [])
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(first, pa.int32()),
                 pa.array(needs, pa.list_(pa.int32()))], ["n", "bits", "first", "needs"])

    return docs.withColumn(into, count(F.col(text)))


def each_set(rows: DataFrame, width: int, schema: str, out_of, of=iter):
    """Rows made by out_of(node, set) from every (node, text) of the batches that `of` makes of a task's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches):
            nodes = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for low, high in slices(offsets):
                sets = shingle_sets(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], width)
                yield from out_of(nodes[low:high], list(sets))

    return rows.mapInArrow(run, schema)


def fragment_keys(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, node) for every fragment of every set; a task sends those of equal texts it remembers once."""
    def out_of(nodes, sets):
        cuts = Cuts(percent)
        keys = [cuts.keys(s) if len(s) else np.empty(0, np.uint64) for s in sets]
        repeated = np.repeat(nodes, [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays(
            [signed(np.concatenate(keys) if keys else np.empty(0, np.uint64)), pa.array(repeated, pa.int64())],
            ["key", "node"])

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            new = [k for k, node in zip(first.tolist(), nodes.tolist()) if node not in seen]
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(nodes.tolist())
            yield batch.take(pa.array(sorted(new), pa.int64()))

    return each_set(rows, width, "key long, node long", out_of, fresh)


def with_hubs(keys: DataFrame) -> DataFrame:
    """(key, node, hub): the other nodes of every key that several share, with one of them, its hub.

    Rows of a key come one after another (one sort column, so Spark sorts by radix) and are passed by
    once; nothing of a group is held but its hub. Copies that several tasks sent go afterwards.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            start = np.concatenate([[True], key[1:] != key[:-1]])
            if last_key is not None and key[0] == last_key:
                start[0] = False
            group = np.cumsum(start)
            hubs = np.concatenate([[last_hub if last_hub is not None else 0], node[start]])
            hub = hubs[group]
            use = node != hub
            last_key, last_hub = key[-1], hub[-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(node[use]), pa.array(hub[use])],
                                             ["key", "node", "hub"])

    return (keys.repartition("key").sortWithinPartitions("key")
            .mapInArrow(run, "key long, node long, hub long").distinct())


def rare_keys(members: DataFrame, size: DataFrame) -> DataFrame:
    """The (key, node) that candidates are made of: each set leaves out its most frequent keys.

    Two sets that link share as many keys as either needs. The rarest of these stands, by frequency and
    key, behind all the others in both sets, so it stays in both when as many less one go.
    """
    held = members.groupBy("key").agg(F.count("*").alias("held"))
    label = F.col("key").bitwiseAND(F.lit(int(CLASS_BITS))).cast("int")
    place = F.row_number().over(Window.partitionBy("node", "label").orderBy(F.col("held").desc(), "key"))
    return (members.join(held, "key").join(size.select("node", "first", "needs"), "node")
            .withColumn("label", label).withColumn("place", place)
            .where(F.col("place") >= F.get("needs", F.col("label") - F.col("first")))
            .select("key", "node"))


def meeting(members: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) of different components that share a key and may link; a crowded key is split."""
    split = members.groupBy("key").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    dealt = members.join(split, "key").join(size, "node")
    one = side(dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")), "u")
    all_parts = side(dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "v")
    return (one.join(all_parts, ["key", "part"]).where(f"ru < rv AND {possible(percent)}")
            .dropDuplicates(["u", "v"]))


def crowds(pairs: DataFrame) -> DataFrame:
    """(node, hub, part): where each set of the pairs goes. A hub with many partners has several parts."""
    hubs = stored(pairs.groupBy("hub").agg(F.ceil(F.count("*") / PARTNERS).cast("long").alias("parts")), "hubs")
    ends = pairs.join(hubs, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    return ends.union(hubs.select(F.col("hub").alias("node"), "hub",
                                  F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))


def cut_sets(rows: DataFrame, width: int) -> DataFrame:
    """(hub, part, fragment, node, tokens): every set cut into the fragments of the global order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(k).to_numpy() for k in range(3)]
            data, offsets = text_bytes(batch.column(3))
            for low, high in slices(offsets):
                at, fragment, tokens = [], [], []
                sets = shingle_sets(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], width)
                for k, s in enumerate(sets, low):
                    place = s >> np.uint64(64 - FRAGMENTS.bit_length() + 1)
                    bounds = np.searchsorted(place, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                    for f in range(FRAGMENTS):
                        if bounds[f] < bounds[f + 1]:
                            at.append(k)
                            fragment.append(f)
                            tokens.append(s[bounds[f]:bounds[f + 1]].view(np.int64))
                if at:
                    lengths = np.cumsum([0] + [len(t) for t in tokens])
                    node, hub, part = (pa.array(x[at], pa.int64()) for x in names)
                    yield pa.RecordBatch.from_arrays(
                        [hub, part, pa.array(fragment, pa.int32()), node,
                         pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(tokens)))],
                        ["hub", "part", "fragment", "node", "tokens"])

    return rows.select("node", "hub", "part", "text").mapInArrow(
        run, "hub long, part long, fragment int, node long, tokens array<long>")


def overlaps(parts: DataFrame) -> DataFrame:
    """(node, hub, overlap) of every fragment both have.

    The hub's row comes first in its part and is the only one held; a node that repeats counts once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = held = last = None
        for batch in batches:
            hub, part, fragment, node = (batch.column(k).to_pylist() for k in range(4))
            ends, tokens = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            found = []
            for k, here in enumerate(zip(hub, part, fragment)):
                mine = tokens[ends[k]:ends[k + 1]]
                if here != group:
                    group, held = here, mine.copy() if node[k] == hub[k] else None
                elif node[k] != last and held is not None:
                    place = np.minimum(np.searchsorted(held, mine), len(held) - 1)
                    found.append((node[k], hub[k], int((held[place] == mine).sum())))
                last = node[k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["node", "hub", "overlap"])

    place = ["hub", "part", "fragment"]
    return (parts.repartition(*place).sortWithinPartitions(*place, F.col("node") != F.col("hub"), "node")
            .mapInArrow(run, "node long, hub long, overlap long"))


def linked(pairs: DataFrame, texts: DataFrame, size: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (u, v) among pairs (node, hub, nu, nv): overlaps summed over the fragments reach the threshold.

    Each set travels once, to its hub; `size` names one row (mark) of those with equal texts.
    """
    asked = stored(crowds(pairs).join(size.select("node", "mark"), "node"), "asked")
    small = asked.count() * 32 <= BROADCAST_BYTES
    mine = texts.join(F.broadcast(asked) if small else asked, ["node", "mark"])
    sums = overlaps(cut_sets(mine, width)).groupBy("node", "hub").agg(F.sum("overlap").alias("overlap"))
    return stored(pairs.join(sums, ["node", "hub"])
                  .where(f"100 * overlap >= {percent} * (nu + nv - overlap)")
                  .select(F.col("node").alias("u"), F.col("hub").alias("v")), "links")


def possible(percent: int) -> str:
    """Condition on two nodes (u, nu, u0..) and (v, nv, v0..): sizes and signatures allow a link."""
    differ = " + ".join(f"bit_count(u{i} ^ v{i})" for i in range(SIGNATURE))
    return (f"100 * nu >= {percent} * nv AND 100 * nv >= {percent} * nu "
            f"AND {100 + percent} * ({differ}) <= {100 - percent} * (nu + nv)")


def side(described: DataFrame, name: str) -> DataFrame:
    return described.select(
        F.col("node").alias(name), F.col("n").alias(f"n{name}"),
        *[F.get("bits", F.lit(i)).alias(f"{name}{i}") for i in range(SIGNATURE)],
        *[F.col(c).alias(f"r{name}" if c == "root" else c) for c in ("key", "part", "root") if c in described.columns])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4,
                    percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, text_hash, kept) for every row.

    Words are runs of bytes other than ASCII white space, A-Z lowered; a text of fewer than `width`
    words is one n-gram as a whole. Two texts link when 100 * intersection >= percent * union of their
    sets; component_id is the smallest key reachable by links. NULL and wordless texts have 0 n-grams
    and link with nothing. Equal texts are one node; a NULL key is ignored as a smallest key and such
    a row gets its group's. Texts and n-grams are told apart by 64-bit hashes. Other columns are not
    read; rows that repeat give rows that repeat. `kept` names one (key, text) of each group, the
    smallest key and of its texts the one with the smallest hash, and every row without n-grams.

    In each of some rounds every text is compared with the most similar hub of the keys it shares
    with texts it is not connected with. Then all pairs that share a key, are not connected and may
    be similar by size and signature are compared, so that no link is lost between components.
    """
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"),
                        F.xxhash64(text).alias("node"),
                        F.xxhash64(key).alias("mark"))
    rows = stored(sizes(named, "text", width, percent, "_set").select("id", "node", "mark", "_set.*"), "sizes")
    texts = named.where("text IS NOT NULL").select("node", "mark", "text")
    groups = stored(with_hubs(fragment_keys(texts.select("node", "text"), width, percent)), "groups")
    # One row for each text.
    size = rows.where("n > 0").groupBy("node").agg(F.min("mark").alias("mark"),
                                                   *[F.max(c).alias(c) for c in ("n", "bits", "first", "needs")])
    size = stored(size, "nodes")
    shared = groups.select("key", "node").union(groups.select("key", F.col("hub").alias("node")).distinct())
    members = stored(rare_keys(shared, size), "members")

    roots = tried = None
    for turn in range(ROUNDS + 1):
        if roots is None:
            rooted = members.withColumn("root", F.col("node"))
        else:
            rooted = (members.join(roots, "node", "left")
                      .withColumn("root", F.coalesce("root", "node")))
            mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
            rooted = stored(rooted.join(mixed.select("key"), "key"), "members")
            members = rooted.drop("root")
            if members.isEmpty():  # every two texts that share a key are connected
                break
        if turn < ROUNDS:
            # Sizes and signatures join the distinct pairs, not every key they share.
            hub = rooted.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("h"))
            pairs = (rooted.join(hub, "key").where("root <> h.root")
                     .select(F.col("node").alias("u"), F.col("h.node").alias("v")).distinct()
                     .join(side(size, "u"), "u").join(side(size, "v"), "v").where(possible(percent)))
        else:
            pairs = meeting(rooted, size, percent)
        differ = sum((F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(SIGNATURE)), F.lit(0))
        pairs = pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "u", "v", "nu", "nv",
                             differ.alias("differ"))
        # (a, b) is the pair; sizes matter by their sum alone.
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        if turn < ROUNDS:
            best = F.struct("differ", "v", "nu", "nv", "a", "b")
            pairs = pairs.groupBy("u").agg(F.min(best).alias("p")).select("u", "p.*")
        checked = stored(pairs.select("a", "b", F.col("u").alias("node"), F.col("v").alias("hub"), "nu", "nv")
                         .dropDuplicates(["a", "b"]), "pairs")
        if checked.isEmpty():
            continue
        names = checked.select("a", "b")
        tried = names if tried is None else tried.union(names)
        found = linked(checked, texts, size, width, percent)
        if found.isEmpty():
            continue
        # Known components stand for their links.
        edges = found if roots is None else found.union(
            roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = stored(components(edges), "roots")
    if roots is None:
        roots = size.select("node", F.col("node").alias("root"))
    grouped = rows.join(roots, "node", "left").withColumn(
        "group", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    # A NULL id comes last.
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    smallest = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min(rank).alias("least"))
    return grouped.join(smallest, "group", "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id")).alias("component_id"),
        F.col("node").alias("text_hash"), (F.col("least").isNull() | rank.eqNullSafe(F.col("least"))).alias("kept"))
