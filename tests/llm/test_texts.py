"""Operators on texts against brute force, with NULLs, empty and long texts, copies and odd columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from riskloom.llm import decontam, jaccard, langid, lines, pieces, suffix

SCHEMA = "doc_id long, text string, lang string, source string, node long, spans string, line string"
WORDS = ["the", "of", "And", "est", "le", "über", "ß", "日本", "x1", "a-b", "Zed", "qui"]


def corpus(spark, seed=1, rows=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120)))
            for _ in range(rows // 2)]
    texts = [None, "", " ", "...", "one", base[0], base[0], base[1] + " tail", "  two  spaces ", "a\n\nb\n a \n",
             " ".join(base[:8]) * 3, "x" * 700, base[2][40:] + base[3]]
    texts += base + [" ".join(w if rng.random() > 0.04 else "edit" for w in t.split()) for t in base]
    data = [(i, t, ["en", "fr", None][i % 3], [f"s{i % 5}", None][i % 7 == 0], 1, "x", "y")
            for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[5], (None, "one more", "en", "s1", 2, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- language

def ppm_bits(model_sample, labels, order, text):
    """Code lengths by a dictionary of contexts, one byte after the other."""
    out = []
    seen = {}
    for k, t in model_sample:
        raw = t.encode()
        for i in range(len(raw)):
            for n in range(min(order, i) + 1):
                seen.setdefault((k, raw[i - n:i]), Counter())[raw[i]] += 1
    for k in labels:
        total, raw = 0.0, text.encode()
        for i in range(len(raw)):
            for n in range(min(order, i), -1, -1):
                found = seen.get((k, raw[i - n:i]))
                if not found:
                    continue
                size = sum(found.values()) + len(found)
                if found[raw[i]]:
                    total -= np.log2(found[raw[i]] / size)
                    break
                total -= np.log2(len(found) / size)
            else:
                total += 8
        out.append(total)
    return out


def test_code_lengths_are_those_of_context_dictionaries():
    sample = [("a", "abracadabra"), ("b", "banana band"), ("a", "cab"), ("b", "ana")]
    texts = ["abracab", "banana", "", "zzé", "a"]
    scorer = langid.Scorer(langid.grow(sample, order=3, min_context=1))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = scorer.bits(data, offsets)
    for row, t in zip(got, texts):
        assert row == pytest.approx(ppm_bits(sample, ["a", "b"], 3, t))


def test_slices_do_not_change_code_lengths(monkeypatch):
    model = langid.grow([("a", "abracadabra " * 5), ("b", "banana band " * 4)], order=4)
    data = np.frombuffer(b"abracadabra banana " * 20, np.uint8)
    offsets = np.array([0, 7, 7, 200, len(data)])
    whole = langid.Scorer(model).bits(data, offsets)
    monkeypatch.setattr(langid, "CHUNK", 13)
    assert langid.Scorer(model).bits(data, offsets) == pytest.approx(whole)


def test_language_of_odd_rows(docs, empty):
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.language.score <= 1
        assert (r.language.lang == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
    assert langid.identify(empty, langid.fit(docs)).count() == 0
    assert {r.language.lang for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}


def test_copies_do_not_thin_the_sample_out(spark):
    texts = [("a", f"own text {i}") for i in range(3)] + [("b", f"autre texte {i}") for i in range(30)]
    copies = spark.createDataFrame(texts, "lang string, text string").crossJoin(spark.range(2000)).drop("id")
    got = langid.training_sample(copies, "text", "lang", 5, 10_000)
    assert {t for k, t in got if k == "a"} == {t for k, t in texts if k == "a"}
    assert len(got) == len(set(got)) == 8 and sum(k == "b" for k, _ in got) == 5


def test_a_long_text_does_not_end_the_sample(spark):
    texts = [("a", f"{i} " + "é" * (400 if i % 2 else 3)) for i in range(12)]
    for bound in (100, 500, 1001):
        got = langid.training_sample(spark.createDataFrame(texts, "lang string, text string"), "text", "lang", 50, bound)
        assert bound - 1 <= sum(len(t.encode()) for _, t in got) <= bound
        assert all(any(whole.startswith(t) for _, whole in texts) for _, t in got)


# ---------------------------------------------------------------- pieces

def test_ids_spans_and_decoding(docs, empty):
    model = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = pieces.round_trip(pieces.encode(docs, model), model).collect()
    for r in got:
        text = r.text or ""
        ids = library.encode(text)
        assert [p.id for p in r.pieces] == ids and r.tokens.n_tokens == len(ids)
        assert r.tokens.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.tokens.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        edges = [p.begin for p in r.pieces] + [len(text.encode())]
        assert not ids or edges[0] == 0
        assert [p.end for p in r.pieces] == edges[1:][:len(ids)] and r.tokens.covered == len(text.encode())
    assert pieces.round_trip(empty, model).count() == 0


def test_longest_prefix_normaliser():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = library.serialized_normalizer_spec
    chars = pieces.CharMap(spec() if callable(spec) else spec)
    for text in ["ﬁ Ａ  b", " ①②  Ⅷ ﾊﾟ x  ", "éa　b\tc\n", "", "plain"]:
        normal, source = chars.normalise(text)
        assert normal.decode() == library.normalize(text)
        assert len(source) == len(normal) + 1 and source == sorted(source)
        assert source[-1] <= len(text.encode())


# ---------------------------------------------------------------- lines

@pytest.mark.parametrize("only_copies", [False, True])
def test_lines_against_counts(spark, empty, only_copies):
    body = [(i, f"only {i}\nshared by all\n  few  \n\nlast {i % 3}", f"s{i}") for i in range(8)]
    body += [(8, "shared by all\nshared by all", "s1"), (9, None, "s2"), (10, "", None), (11, "x\nshared by all", None)]
    body += [(i, f"shared by all\n{'word ' * 30_000}", "s1") for i in (12, 13)] + [(14, "few\nfew", "s2"), (15, "few\nfew", "s3")]
    docs = spark.createDataFrame(body + [body[0]], "doc_id long, text string, source string")
    got = lines.remove_shared_lines(docs, threshold=3, only_copies=only_copies).collect()
    assert len(got) == 17
    copies = Counter(r.text for r in got)
    sites = {}
    for _, t, s in body:
        for x in (t or "").split("\n"):
            sites.setdefault(x.strip(" "), set()).update({s} - {None})
    bad = {x for x, s in sites.items() if x and len(s) >= 3}
    for r in got:
        kept = None if r.text is None else "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in bad)
        filled = [x for x in (r.text or "").split("\n") if x.strip(" ")]
        if all(x.strip(" ") in bad for x in filled) and (copies[r.text] > 1 or not only_copies):
            kept = r.text
        assert r.cleaned.text == kept and r.cleaned.n_lines == (0 if r.text is None else r.text.count("\n") + 1)
    assert lines.remove_shared_lines(empty, threshold=3).count() == 0


def test_pipeline_cleans_boilerplate_that_is_no_copy(spark):
    import corpus_pipeline

    rows = [(i, f"only {i}\nbanner\nfooter", "en", f"s{i}", 1) for i in range(10)]
    rows += [(20, "banner\nfooter", "en", "s1", 1), (21, "footer\n\nbanner", "en", "s2", 1),
             (22, "footer", "en", "s3", 1), (23, "footer", "en", "s4", 1), (24, None, "en", "s4", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.shared_lines(spark, docs, "").collect()}
    assert got == {**{i: (f"only {i}", 6) for i in range(10)}, 20: ("", 0), 21: ("", 0),
                   22: ("footer", 6), 23: ("footer", 6), 24: (None, None)}


def test_line_hash_is_sparks(spark):
    for text in ["", "é x", "long " * 30]:
        want = spark.range(1).selectExpr(f"xxhash64('{text}')").first()[0]
        assert xxhash.xxh64_intdigest(text.encode(), seed=lines.SEED) == want % (1 << 64)


# ---------------------------------------------------------------- repeated strings

def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i:i + length] = True
        out.append(hit)
    return out


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    for n in [*range(1, 20), 400]:
        for kinds in (1, 2, 5):
            text = rng.integers(1, kinds + 1, n).astype(np.int64)
            order = np.argsort(suffix.suffix_ranks(text)).tolist()
            assert order == sorted(range(n), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("crowd", [1000, 1])
def test_repeats_against_all_windows(docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "PART", 500)
    got = suffix.remove_repeats(docs, length=60, gram=12).collect()
    for r, hit in zip(got, removed([r.text for r in got], 60)):
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        assert r.kept.n_removed == hit.sum() and r.kept.n_bytes == len(raw)
        assert r.kept.n_spans == (np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()
        assert r.kept.kept_sha256 == hashlib.sha256(raw[~hit].tobytes()).hexdigest()
    assert suffix.remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- benchmark

def test_contamination_against_windows(spark, docs, empty):
    texts = [r.text for r in docs.collect() if r.text]
    items = [(1, " ".join(texts[-3].split()[2:30])), (2, "est le"), (None, texts[-5]), (3, ""), (4, None),
             (1, "three new words"), (5, "日本")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, window=4).collect()
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return find.findall("".join(c.lower() if c.isascii() else c for c in t or ""))

    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(len(w) - 3, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + 4]), set()).add("null" if name is None else str(name))
    for r in got:
        w = words(r.text)
        hit, names = set(), set()
        for win, owners in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    names |= owners
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == (len(w), len(hit), sorted(names))
        raw = (r.text or "").encode()
        assert sum(len(words(raw[s.begin:s.end].decode())) for s in r.hits.spans) == len(hit)
    assert decontam.contamination(empty, bench).count() == 0
    assert {r.hits.n_hit for r in decontam.contamination(docs, bench.limit(0)).collect()} == {0}


# ---------------------------------------------------------------- Jaccard

@pytest.mark.parametrize("percent,width", [(85, 4), (60, 2), (100, 3)])
def test_jaccard_against_all_pairs(docs, empty, monkeypatch, percent, width):
    monkeypatch.setattr(jaccard, "PARTNERS", 2)
    got = jaccard.near_duplicates(docs, width=width, percent=percent).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    want = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[top(i)] if x is not None]
        want[d, len(sets[i]), min(ids) if sets[i] and ids else d] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("percent,width,broadcast", [(85, 4, 0), (85, 4, 64 << 20), (80, 5, 0)])
def test_jaccard_of_families_around_the_threshold(spark, monkeypatch, percent, width, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(jaccard, "CROWD", 7)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rng = np.random.default_rng(percent + width)
    texts = []
    for length in (9, 30, 150, 700):
        base = [f"w{x}" for x in rng.integers(0, 10 ** 6, length)]
        for _ in range(18):
            words = list(base)
            for at in rng.integers(0, length, max(1, int(length * rng.uniform(0, 0.035)))):
                words[at] = f"v{rng.integers(0, 10 ** 6)}"
            texts.append(" ".join(words))
    got = {r.doc_id: r for r in jaccard.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        width=width, percent=percent).collect()}
    sets = [{tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} for w in (t.split() for t in texts)]
    links = [(i, j) for j in range(len(sets)) for i in range(j)
             if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    low = list(range(len(sets)))
    for _ in low:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    assert 4 < len(set(low)) < len(low)
    assert [(got[k].n_shingles, got[k].component_id) for k in range(len(sets))] == [
        (len(s), low[k]) for k, s in enumerate(sets)]


@pytest.mark.parametrize("percent", [60, 80, 85, 99, 100])
def test_sets_that_link_share_the_keys_they_need(percent):
    rng = np.random.default_rng(percent)
    cuts = jaccard.Cuts(percent)
    for n in (1, 2, 6, 7, 20, 108, 109, 400, 3000):
        one = jaccard.distinct(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        for _ in range(5):
            gone = rng.integers(0, n * (100 - percent) // 100 + 1)
            more = rng.integers(0, 1 << 64, rng.integers(0, n * (100 - percent) // 200 + 1), np.uint64)
            two = jaccard.distinct(np.concatenate([one[gone:], more]))
            both = len(np.intersect1d(one, two))
            if not len(two) or 100 * both < percent * (len(one) + len(two) - both):
                continue
            c = cuts.classes(max(len(one), len(two))).start
            common = np.intersect1d(cuts.keys(one), cuts.keys(two)) & jaccard.CLASS_BITS
            for s in (one, two):
                assert c in cuts.classes(len(s))
                assert (common == c).sum() >= max(1, cuts.needs(s)[c - cuts.classes(len(s)).start])


def test_sets_do_not_depend_on_the_place_of_a_text():
    def sets(texts):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        return list(jaccard.shingle_sets(data, np.cumsum([0] + [len(r) for r in raw]), 2))

    texts = ["a b c a b", "", "c d", "é" * 40 + " x", "  ", "x", "A B\tc\na B", "ab c a b"]
    together = sets(texts)
    for text, found in zip(texts, together):
        assert np.array_equal(found, sets([text])[0])
        words = text.lower().split()
        assert len(found) == (len(set(zip(words, words[1:]))) or bool(words))
    assert np.array_equal(together[0], together[6])
    assert not np.array_equal(together[0], together[7])
