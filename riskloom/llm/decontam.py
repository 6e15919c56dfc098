"""Benchmark decontamination with FM-indexes.

Each slice of training texts is a shard: its words become symbols, the suffixes are sorted, and the
last column of the sorted rotations is kept as a wavelet matrix whose ranks drive the backward search
of all benchmark windows at once. Occurrences are located by walking to sampled suffix positions.
Only stretches whose neighbouring words also neighbour each other in some window enter an index;
no occurrence can lie outside of them.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_names, slices, text_bytes

#: Every SAMPLE-th suffix position is kept.
SAMPLE = 16
#: Bytes of benchmark text of one block; blocks are searched one after the other.
BLOCK_BYTES = 16 << 20

# A word byte is 0-9, a-z (A-Z are lowered) or any byte of a character beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(int(_random.integers(1, 1 << 62)) * 4 + 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and 64-bit hash of every word in the bytes of a slice of texts."""
    data = LOWER[data]
    inside = np.concatenate([[False], IS_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2], data


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """sum of value(byte) * STEP ** (place from the word's end), modulo 2 ** 64."""
    out = np.zeros(len(begins), np.uint64)
    lengths = ends - begins
    step = powers(STEP, 32)
    for k in range(int(min(lengths.max(initial=0), 32))):
        at = np.flatnonzero(lengths > k)
        out[at] = out[at] * STEP + BYTE_VALUE[data[begins[at] + k]]
    for i in np.flatnonzero(lengths > 32):  # sums wrap around
        rest = BYTE_VALUE[data[begins[i] + 32:ends[i]]]
        scale = powers(STEP, len(rest))
        out[i:i + 1] = out[i:i + 1] * scale[-1] + (rest * scale[:len(rest)][::-1]).sum(dtype=np.uint64)
    return out + step[np.minimum(lengths, 32)] * lengths.astype(np.uint64)


def texts_to_words(texts: list[str]):
    """Word begins, ends, hashes and the text each word belongs to; a word never spans two texts."""
    column = pa.array(texts, pa.large_string())
    return words_of(*text_bytes(column))


def words_of(data: np.ndarray, offsets: np.ndarray):
    begins, ends, lowered = split_words(data)
    # Two texts that touch with word bytes are cut at their border.
    borders = offsets[1:-1]
    crossing = np.searchsorted(begins, borders, "left") - 1
    cut = (crossing >= 0) & (ends[np.maximum(crossing, 0)] > borders) if len(begins) else np.zeros(len(borders), bool)
    extra = np.unique(borders[cut])
    begins = np.sort(np.concatenate([begins, extra]))
    ends = np.sort(np.concatenate([ends, extra]))
    owner = np.searchsorted(offsets, begins, "right") - 1
    return begins, ends, word_hashes(lowered, begins, ends), owner


class Phrases:
    """The windows of a block of benchmark items over a vocabulary of their own."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        _, _, hashes, owner = texts_to_words([t for _, t in items])
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = ids + 1
        found = {}
        for k, (name, _) in enumerate(items):
            low, high = np.searchsorted(owner, [k, k + 1])
            size = min(window, high - low)
            for i in range(low, high - size + 1 if size else low):
                found.setdefault(tuple(ids[i:i + size].tolist()), set()).add(name)
        self.names = sorted({n for v in found.values() for n in v})
        number = {n: i for i, n in enumerate(self.names)}
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.items = [np.array(sorted(number[n] for n in v)) for v in found.values()]
        # Aligned at the last word, where the backward search begins.
        self.words = np.zeros((len(found), window), np.int64)
        for row, w in enumerate(found):
            self.words[row, window - len(w):] = w
        size = len(self.vocabulary) + 1
        left, right = self.words[:, :-1].ravel(), self.words[:, 1:].ravel()
        self.neighbours = np.unique((left * size + right)[(left > 0) & (right > 0)])
        self.alone = np.unique(self.words[self.lengths == 1, -1])
        self.bloom = np.zeros(1 << 16, bool)
        self.bloom[self.vocabulary >> np.uint64(48)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, 0 for words that no window has."""
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.bloom[hashes >> np.uint64(48)])
        place = np.searchsorted(self.vocabulary, hashes[at])
        place[place == len(self.vocabulary)] = 0
        same = self.vocabulary[place] == hashes[at]
        out[at[same]] = place[same] + 1
        return out


class WaveletMatrix:
    """Rank of any symbol in a sequence by one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels = []
        for shift in range(max(1, int(kinds - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bits)])
            self.levels.append((shift, ones, len(bits) - int(ones[-1])))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start = np.zeros_like(place)
        for shift, ones, zeros in self.levels:
            up = (symbol >> shift) & 1 == 1
            place = np.where(up, zeros + ones[place], place - ones[place])
            start = np.where(up, zeros + ones[start], start - ones[start])
        return place - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; the last symbol must be the only smallest one."""
    rank, step = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])
        key = rank * (len(rank) + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(len(rank), np.int64)
        rank[order] = fresh
        if fresh[-1] == len(rank) - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over one sequence of symbols; 0 separates stretches."""

    def __init__(self, symbols: np.ndarray):
        kinds, dense = np.unique(symbols, return_inverse=True)
        self.kinds = kinds
        # A terminator below all symbols makes the order of suffixes total.
        text = np.concatenate([dense + 1, [0]])
        order = suffix_array(text)
        self.last = text[order - 1]
        self.matrix = WaveletMatrix(self.last, len(kinds) + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(kinds) + 1))])
        separator = np.searchsorted(kinds, 0) + 1 if len(kinds) and kinds[0] == 0 else -1
        # Starts of stretches are sampled too, so that a walk never crosses a separator.
        kept = (order % SAMPLE == 0) | (text[order - 1] == separator) | (order == 0)
        self.sampled = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions = kept, order[kept]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase; words end at the right."""
        place = np.minimum(np.searchsorted(self.kinds, words), len(self.kinds) - 1)
        known = (self.kinds[place] == words) | (words == 0)
        low = np.zeros(len(words), np.int64)
        high = np.full(len(words), len(self.last))
        high[~known.all(axis=1)] = 0
        width = words.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (low < high))
            symbol = place[live, width - 1 - back] + 1
            low[live] = self.before[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        moving = np.flatnonzero(~self.kept[rows])
        while len(moving):
            symbol = self.last[rows[moving]]
            rows[moving] = self.before[symbol] + self.matrix.rank(symbol, rows[moving])
            steps[moving] += 1
            moving = moving[~self.kept[rows[moving]]]
        return self.positions[self.sampled[rows]] + steps


def occurrences(phrases: Phrases, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every place of a slice's words where a phrase occurs."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(phrases.words) or not len(hashes):
        return none
    ids = phrases.ids(hashes)
    linked = np.zeros(len(ids) + 1, bool)  # linked[i]: words i - 1 and i may stand in one window
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (owner[:-1] == owner[1:])) + 1
    linked[both] = np.isin(ids[both - 1] * (len(phrases.vocabulary) + 1) + ids[both], phrases.neighbours)
    use = linked[:-1] | linked[1:]
    if len(phrases.alone):
        use |= np.isin(ids, phrases.alone)
    at = np.flatnonzero(use)
    if not len(at):
        return none
    fresh = ~linked[at]
    place = np.arange(len(at)) + np.cumsum(fresh)
    symbols = np.zeros(place[-1] + 1, np.int64)
    symbols[place] = ids[at]
    index = FMIndex(symbols)
    low, high = index.search(phrases.words, phrases.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    source = np.zeros(len(symbols), np.int64)
    source[place] = at
    return phrase, source[index.locate(rows)]


HITS = "n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = 10, into: str = "hits") -> DataFrame:
    """Add a struct: number of words, of words in benchmark windows, items found, byte spans hit.

    A window is `window` consecutive words of an item, or all words of a shorter one. Items are
    distinct ids as text, in order; a NULL id counts as the item "null", items without words match
    nothing. Spans are merged runs of hit words, in bytes of the text. A NULL text has no words.
    The benchmark goes to the tasks in blocks of about BLOCK_BYTES; documents are read once and not
    shuffled. All columns stay; rows with equal texts get equal results.
    """
    context = docs.sparkSession.sparkContext
    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"),
                             F.col(item_text).alias("body")).where("body IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    held = [context.broadcast(Phrases(
        [(r["name"], r["body"]) for r in
         named.where(F.pmod(F.xxhash64("name", "body"), F.lit(blocks)) == b).collect()], window))
        for b in range(blocks)]

    @F.arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                          ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
        for column in batches:
            data, offsets = text_bytes(column)
            out = []
            for low, high in slices(offsets):
                base = offsets[low]
                own = offsets[low:high + 1] - base
                begins, ends, hashes, owner = words_of(data[base:offsets[high]], own)
                edge = np.zeros(len(begins) + 1, np.int64)
                items: dict[int, set] = {}
                for block in held:
                    phrases = block.value
                    which, first = occurrences(phrases, hashes, owner)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + phrases.lengths[which], -1)
                    for doc, phrase in set(zip(owner[first].tolist(), which.tolist())):
                        items.setdefault(doc, set()).update(phrases.names[i] for i in phrases.items[phrase])
                hit = np.cumsum(edge)[:-1] > 0
                n_words = np.bincount(owner, minlength=high - low)
                n_hit = np.bincount(owner[hit], minlength=high - low)
                # A run ends at a word that is not hit or belongs to another text.
                at = np.flatnonzero(hit)
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (np.diff(owner[at]) > 0)
                starts = np.flatnonzero(new)
                stops = np.append(starts[1:], len(at))
                spans: dict[int, list] = {}
                for i, j in zip(starts.tolist(), stops.tolist()):
                    doc = int(owner[at[i]])
                    spans.setdefault(doc, []).append(
                        {"begin": int(begins[at[i]] - own[doc]), "end": int(ends[at[j - 1]] - own[doc])})
                out += [{"n_words": int(n_words[d]), "n_hit": int(n_hit[d]),
                         "items": sorted(items.get(d, ())), "spans": spans.get(d, [])}
                        for d in range(high - low)]
            yield pa.array(out, kind)

    return docs.withColumn(into, find(F.col(text)))


def cut_spans(docs: DataFrame, text: str = "text", spans: str = "spans", into: str = "text") -> DataFrame:
    """The text without its byte spans; NULL and texts without spans stay as they are.

    All columns stay; one called `into` is replaced.
    """
    (new,) = free_names(docs, "_cut")

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for value, runs in zip(texts, found):
                raw, at, kept = (value.as_py() or "").encode(), 0, []
                for run in runs.as_py() or ():
                    kept.append(raw[at:run["begin"]])
                    at = run["end"]
                kept.append(raw[at:])
                out.append(b"".join(kept).decode())
            yield pa.array(out, pa.string())

    hit = F.coalesce(F.size(spans) > 0, F.lit(False))
    return (docs.withColumn(new, cut(F.when(hit, F.col(text)), F.when(hit, F.col(spans))))
            .withColumn(into, F.when(hit, F.col(new)).otherwise(F.col(text))).drop(new))
