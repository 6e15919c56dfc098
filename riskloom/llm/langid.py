"""Language identification by prediction by partial matching.

A trie over the byte n-grams of a bounded training sample holds, for each language, the symbol
counts behind every context of up to `order` bytes. A symbol unseen behind a context costs the
escape probability q / (N + q) of that context (N symbols, q distinct ones) and is coded by the next
shorter context; below the empty context every byte has probability 1/256. The statistics are frozen,
so the exact code length of a byte depends on the bytes before it alone and whole slices of text are
scored by a few table lookups per byte.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import text_bytes

UND = "und"
#: Bytes scored at once; a slice starts with the contexts of the bytes before it.
CHUNK = 1 << 18


def training_sample(labelled: DataFrame, text: str, label: str, rows: int, max_bytes: int) -> list:
    """(label, text) of at most `rows` distinct texts and `max_bytes` bytes for each label.

    Texts are taken in the order of a hash of their content; the one that would pass `max_bytes` is
    taken in part. Counts of distinct texts decide the share of the hash range that is looked at, so
    no task sees all texts of a label, and copies do not thin the sample out.
    """
    known = labelled.select(F.col(label).alias("label"), F.col(text).alias("text")).where(
        "label IS NOT NULL AND length(text) > 0").withColumn("hash", F.xxhash64("text"))
    counts = {r["label"]: r["n"] for r in known.select("label", "hash").distinct()
              .groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * rows / n))])
    place = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    picked = (known.withColumn("place", place).where(F.col("place") < share[F.col("label")])
              .select("label", "text", "place").distinct())
    upto = Window.partitionBy("label").orderBy("place", "text")
    room = F.greatest(F.lit(max_bytes) - (F.col("bytes") - F.octet_length("text")), F.lit(0))
    taken = (picked.withColumns({"n": F.row_number().over(upto),
                                 "bytes": F.sum(F.octet_length("text")).over(upto)})
             .withColumn("room", room.cast("int")).where((F.col("n") <= rows) & (F.col("room") > 0))
             .select("label", F.expr("left(text, room)").alias("text"), "room").collect())
    # A character has a byte at least; what is over the bound goes here, with a character cut in two.
    cut = [(r["label"], r["text"].encode()[:r["room"]].decode(errors="ignore")) for r in taken]
    return [(k, t) for k, t in cut if t]


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", order: int = 4,
        rows: int = 400, max_bytes: int = 500_000, min_context: int = 4,
        max_contexts: int = 40_000) -> dict:
    """Context trees of all labels, learnt from a bounded sample of the labelled rows.

    Bounds: `rows` texts and `max_bytes` bytes per label; a context seen fewer than `min_context`
    times is not expanded, and of more than `max_contexts` / `order` contexts of one length the most
    frequent are. Rows without a label or text are not used; without any the model is empty.
    """
    sample = training_sample(labelled, text, label, rows, max_bytes)
    return grow(sample, order, min_context, max_contexts)


def grow(sample: list, order: int = 4, min_context: int = 4, max_contexts: int = 40_000) -> dict:
    labels = sorted({k for k, _ in sample})
    if not labels:
        return {"labels": [], "order": order}
    width = len(labels)
    encoded = [(labels.index(k), np.frombuffer(t.encode(), np.uint8)) for k, t in sample]
    flat = np.concatenate([b for _, b in encoded])
    lang = np.concatenate([np.full(len(b), k) for k, b in encoded])
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0] + [len(b) for _, b in encoded])[:-1]] = True

    # Node 0 is "no node", node 1 the empty context.
    parent, symbol = [np.zeros(2, np.int64)], [np.zeros(2, np.int64)]
    count, suffix = [np.zeros((2, width))], [np.zeros(2, np.int64)]
    context, shorter, made = np.ones(len(flat), np.int64), None, 2
    expanded, levels = np.ones(2, bool), []
    for _ in range(order + 1):
        at = np.flatnonzero((context > 0) & expanded[context])
        keys, where, inverse = np.unique(context[at] * 256 + flat[at], return_index=True, return_inverse=True)
        seen = np.bincount(inverse * width + lang[at], minlength=len(keys) * width).reshape(-1, width)
        here = np.zeros(len(flat), np.int64)
        here[at] = made + inverse
        parent.append(keys // 256)
        symbol.append(keys % 256)
        count.append(seen.astype(float))
        suffix.append(np.zeros(len(keys), np.int64) if shorter is None else shorter[at][where])
        levels.append((made, made + len(keys)))
        total = seen.sum(1)
        keep = total >= min_context
        room = max(256, max_contexts // max(1, order))
        if keep.sum() > room:
            keep &= total >= np.sort(total)[-room]
        if shorter is not None:
            keep &= expanded[suffix[-1]]  # so that the suffix of every node is a node
        expanded = np.concatenate([expanded, keep])
        made += len(keys)
        shorter = here
        context = np.concatenate([[0], here[:-1]])
        context[first] = 0
    parent, symbol = np.concatenate(parent), np.concatenate(symbol)
    count, suffix = np.concatenate(count), np.concatenate(suffix)

    total, kinds = np.zeros((made, width)), np.zeros((made, width))
    np.add.at(total, parent[2:], count[2:])
    np.add.at(kinds, parent[2:], (count[2:] > 0).astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, np.log2(kinds / (total + kinds)), 0.0)
        escape[0] = 0.0
        cost = np.zeros((made, width))
        cost[0] = escape[1] - 8  # a byte that no language has
        for start, stop in levels:  # a suffix is on an earlier level than its node
            a = slice(start, stop)
            up = parent[a]
            seen = np.log2(count[a] / (total[up] + kinds[up]))
            below = np.where(suffix[a, None] > 0, cost[suffix[a]], -8.0)
            cost[a] = np.where(count[a] > 0, seen, escape[up] + below)
    inner = np.unique(parent[2:])
    return {"labels": labels, "order": order, "parent": parent[2:].astype(np.int32),
            "symbol": symbol[2:].astype(np.uint8), "inner": inner.astype(np.int32),
            "cost": cost, "escape": escape}


class Scorer:
    """Code lengths, in bits, of whole texts under every language of a model."""

    def __init__(self, model: dict):
        self.model = model
        if model["labels"]:
            self.row = np.zeros(len(model["cost"]), np.int32)
            self.row[model["inner"]] = np.arange(1, len(model["inner"]) + 1)
            self.child = np.zeros((len(model["inner"]) + 1) * 256, np.int32)
            at = self.row[model["parent"]].astype(np.int64) * 256 + model["symbol"]
            self.child[at] = np.arange(2, len(model["parent"]) + 2)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        model, out = self.model, np.zeros((len(offsets) - 1, len(self.model["labels"])))
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[:-1]] = True
        for low in range(0, len(data), CHUNK):
            back = max(0, low - model["order"])
            part, fresh = data[back:low + CHUNK].astype(np.int64), begins[back:back + len(data[back:low + CHUNK])]
            context, deepest, misses = np.ones(len(part), np.int32), None, []
            for _ in range(model["order"] + 1):
                node = self.child[self.row[context].astype(np.int64) * 256 + part]
                missed = np.flatnonzero((node == 0) & (context > 0))
                misses.append((missed, context[missed]))
                deepest = node if deepest is None else np.where(node > 0, node, deepest)
                context = np.concatenate([[0], node[:-1]]).astype(np.int32)
                context[fresh] = 0
            bits = -model["cost"][deepest]
            for k, (missed, known) in enumerate(misses):
                if k:  # the empty context's escape is part of the cost of an unknown byte
                    bits[missed] -= model["escape"][known]
            cuts = np.flatnonzero(fresh[low - back:])
            cuts = cuts if len(cuts) and cuts[0] == 0 else np.concatenate([[0], cuts])
            owner = np.searchsorted(offsets, low + cuts, "right") - 1
            out[owner] += np.add.reduceat(bits[low - back:], cuts, axis=0)
        return out


def identify(docs: DataFrame, model: dict, text: str = "text", into: str = "language") -> DataFrame:
    """Add a struct column (lang, score, bits_per_byte) to every row; all other columns stay.

    `lang` is the label with the shortest code (ties: the first in alphabetical order), `score` its
    share after turning code lengths into probabilities. A NULL or letterless text, and any text
    under an empty model, is `und` with score 0. Reads the text alone; one pass, no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_contexts

    @F.arrow_udf("lang string, score double, bits_per_byte double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(held.value)
        labels = np.array(scorer.model["labels"] or [UND], dtype=object)
        for column in batches:
            data, offsets = text_bytes(column)
            if not scorer.model["labels"]:
                bits = np.zeros((len(column), 1))
            else:
                bits = scorer.bits(data, offsets)
            best = bits.argmin(1) if len(bits) else np.zeros(0, int)
            least = bits.min(1) if len(bits) else np.zeros(0)
            share = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1) if len(bits) else least
            size = np.maximum(np.diff(offsets), 1)
            yield pa.StructArray.from_arrays(
                [pa.array(labels[best], pa.string()), pa.array(share), pa.array(least / size)],
                ["lang", "score", "bits_per_byte"])

    found = predict(F.col(text))
    decided: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model["labels"]))
    return docs.withColumn(into, found).withColumn(into, F.struct(
        F.when(decided, F.col(into)["lang"]).otherwise(UND).alias("lang"),
        F.when(decided, F.col(into)["score"]).otherwise(0.0).alias("score"),
        F.when(decided, F.col(into)["bits_per_byte"]).alias("bits_per_byte")))
