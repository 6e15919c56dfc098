"""Context-tree weighting against a recursion over dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ctw

SCHEMA = "doc_id long, text string, learns boolean, slice string, key string, value string"


def decisions_of(text):
    """(context of full depth, node, bit) of every bit of a text and its end."""
    raw = bytes(ctw.DEPTH) + text.lower() + b"\xff"
    for i in range(ctw.DEPTH, len(raw)):
        node = 1
        for k in range(7, -1, -1):
            bit = raw[i] >> k & 1
            yield raw[i - ctw.DEPTH:i], node, bit
            node = node * 2 + bit


class Tree:
    def __init__(self, texts):
        self.counts, self.longer, self.known = defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for text in texts:
            for context, node, bit in decisions_of(text):
                for d in range(ctw.DEPTH + 1):
                    short = context[ctw.DEPTH - d:]
                    self.counts[short, node][bit] += 1
                    if d < ctw.DEPTH:
                        self.longer[short, node].add(context[ctw.DEPTH - d - 1:])

    def own(self, context, node):
        a, b = self.counts.get((context, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixed(self, context, node):
        if (context, node) not in self.known:
            value = self.own(context, node)
            if len(context) < ctw.DEPTH:
                below = sum(self.mixed(c, node) for c in self.longer.get((context, node), ()))
                top = max(value, below)
                value = top + math.log(0.5 * math.exp(value - top) + 0.5 * math.exp(below - top))
            self.known[context, node] = value
        return self.known[context, node]

    def one(self, context, node, d=0):
        short = context[ctw.DEPTH - d:]
        a, b = self.counts.get((short, node), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == ctw.DEPTH:
            return estimate
        weight = 0.5 * math.exp(self.own(short, node) - self.mixed(short, node))
        return weight * estimate + (1 - weight) * self.one(context, node, d + 1)

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p)
                   for context, node, bit in decisions_of(text) for p in [self.one(context, node)])


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), None]


def brute(rows):
    train = [t or "" for _, t, learns in rows if learns]
    tree, counts = Tree([t.encode() for t in train]), Counter(w for t in train for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    return {i: (not learns, len(tokens(t or "")), sum(w in counts for w in tokens(t or "")), total,
                pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens(t or ""))),
                pytest.approx(tree.score((t or "").encode())))
            for i, t, learns in rows}


def scored(spark, rows, **more):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    out = ctw.language_model_scores(df, F.col("learns"), **more)
    return {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
            for r in out.collect()}


def corpus():
    rng = random.Random(2)
    words = ["the", "The", "of", "über", "日本", "and\n", "abracadabra", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    texts += [None, "", " ", "\n\n", "the", texts[0], texts[0], "unseen zebra 42", "w" * 300, "a b " * 200, "\x00\x00a"]
    return [(i, t, [True, True, False, None][i % 4]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("part, slice_bytes, band", [(1 << 20, 32 << 20, 64), (50, 400, 3)])
def test_scores_equal_the_recursion(spark, monkeypatch, part, slice_bytes, band):
    monkeypatch.setattr(ctw, "PART", part)
    monkeypatch.setattr(ctw, "BAND", band)
    rows = corpus()
    assert scored(spark, rows, slice_bytes=slice_bytes) == brute(rows)


def test_without_training_rows_every_bit_is_even(spark):
    rows = [(1, "abc", False), (2, None, None)]
    got = scored(spark, rows)
    assert got[1] == (True, 2, 0, 0, pytest.approx(0), pytest.approx(-32 * math.log10(2)))
    assert got[2][5] == pytest.approx(-8 * math.log10(2))
    assert scored(spark, []) == {}


def test_probabilities_behind_a_context_add_up_to_one(spark):
    context = int.from_bytes(b"\x00" * (ctw.DEPTH - 1) + b"a")
    keys = np.array([context * 256 + s for s in range(256)] + [(context + 1) * 256 + 5])
    times = np.array([3 * (s % 7 == 0) for s in range(256)] + [9])
    base = ctw.local_levels(keys, times)[0]
    nodes = zip(*(x.tolist() for x in (base.nodes, base.zeros, base.ones, base.mixed, base.weight)))
    paths = ctw.shared_contexts(spark.createDataFrame(nodes, ctw.NODES)).toArrow()
    row = pa.table({"bucket": [0], "keys": [ctw.packed(keys)], "times": [ctw.packed(times)]})
    logs = np.frombuffer(ctw.string_logs((0,), row, paths)["values"][0].as_py(), np.float32)
    assert np.exp(logs[:256].astype(float)).sum() == pytest.approx(1, abs=1e-6)


def test_lists_keep_their_numbers():
    for numbers in ([], [5], [-(2**62), -3, 0, 7, 2**55]):
        assert ctw.unpacked(ctw.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_repeated_rows_and_repeated_ids_are_rows_of_their_own(spark):
    rows = [(1, "one two", True)] * 3 + [(1, "three", False), (None, "one", True)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    out = ctw.language_model_scores(df, F.col("learns")).collect()
    assert len(out) == 5 and {r["train_tokens"] for r in out} == {11}
    assert len({round(r["score"], 9) for r in out if r["n_tokens"] == 3}) == 1
