"""Operators on pages, keys and vectors against brute force."""

import base64
import datetime
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import shards, urls, vectors, warc
from riskloom.llm.common import components, local_components


def test_components(spark):
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    links = [(int(a), int(b)) for a, b in zip(u, v)] + [(None, 3), (7, 7)] + [(1000, i) for i in range(1001, 1060)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    node, root = local_components(np.array([a for a, _ in real]), np.array([b for _, b in real]))
    assert got == dict(zip(node.tolist(), root.tolist()))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def pages(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/é\n", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 900),
            (2, "http://b/é\n", "same"), (None, "n", "only"), (None, "n", "twice"), (9, "n", "twice")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, length int")


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    rows = pages(spark).collect()
    got = warc.round_trip(pages(spark).repartition(2), least).collect()
    want = Counter()
    for r in rows:
        raw = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None]
        last = max(same, default=None)
        revisit = len(raw) >= least and len([x for x in rows if (x.html or "") == (r.html or "")]) > 1 \
            and last is not None and r.page_id != last
        want[r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
             "revisit" if revisit else "response", last if revisit else None] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_selected_records_and_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages(spark).coalesce(1), folder)
    got = warc.read(index.where("page_id IN (5, 9)"), folder).collect()
    assert {(r.page_id, r.payload.decode()) for r in got} == {(5, "é" * 900), (9, "twice")}
    assert warc.read(index.limit(0), folder).count() == 0
    with pytest.raises(Exception, match="does not|WARC|digest|invalid|Error"):
        warc.read(index.where("page_id = 5").withColumn("offset", F.col("offset") + 1), folder).collect()


def test_lists_against_days(spark):
    day = datetime.date
    entries = [("spam", "host", "A.com", day(2024, 1, 5), "add"), ("spam", "host", "a.com", day(2024, 2, 1), "remove"),
               ("spam", "host", "a.com", day(2024, 2, 1), "add"), ("spam", "host", "a.com", day(2024, 6, 1), "add"),
               ("ads", "domain", "b.org", day(2023, 1, 1), "add"), ("ads", "domain", "b.org", day(2024, 3, 1), "remove"),
               ("ads", "domain", None, day(2024, 3, 1), "add"), (None, "host", "a.com", day(2024, 3, 1), "add")]
    hosts = ["http://a.com/x", "https://u@A.com:80/", "http://sub.b.org./q", "http://xb.org/", "nourl", None, "http://b.org"]
    rows = [(i, u, day(2024, 1, 1) + datetime.timedelta(days=20 * k) if k < 11 else None, "h")
            for i, u in enumerate(hosts) for k in range(12)]
    captures = spark.createDataFrame(rows + rows[:1], "id int, url string, fetched date, host string")
    held = urls.validity(spark.createDataFrame(entries, "list string, kind string, value string, day date, action string"))
    for r in urls.judge(captures, held).collect():
        host = {0: "a.com", 1: "a.com", 2: "sub.b.org", 3: "xb.org", 6: "b.org"}.get(r.id)
        spam = r.fetched and host == "a.com" and (
            day(2024, 1, 5) <= r.fetched < day(2024, 2, 1) or r.fetched >= day(2024, 6, 1))
        ads = r.fetched and host in ("sub.b.org", "b.org") and r.fetched < day(2024, 3, 1)
        assert r.filter.host == host and r.filter.blocked == bool(spam or ads)
        assert r.filter.lists == ",".join(n for n, x in (("ads", ads), ("spam", spam)) if x)
    assert urls.judge(captures, held).count() == len(rows) + 1
    assert urls.judge(captures.limit(0), held).count() == 0
    assert not any(r.filter.blocked for r in urls.judge(captures, held.limit(0)).collect())


def test_shards_move_little_and_number_without_gaps(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("shard"))
    odd = spark.createDataFrame([(None, None, 1), (7, "t7", 1), (7, "t7", 1), (8, "", 1)], "doc_id long, text string, shard int")
    got = shards.placed(docs.union(odd), [1.0] * 4, [1.0] * 5).collect()
    assert len(got) == 3004
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {4} and 450 < len(moved) < 750
    assert {r["size"] for r in got if r.doc_id is None} == {1}
    assert shards.placed(docs.limit(0), [1.0], [1.0, 1.0]).count() == 0


def test_weights_are_shares(spark):
    docs = spark.range(6000).withColumnRenamed("id", "doc_id")
    counts = Counter(r.shard for r in shards.assign(docs, [1.0, 2.0, 3.0]).collect())
    assert [round(counts[s] / 1000) for s in range(3)] == [1, 2, 3]
    with pytest.raises(ValueError):
        shards.assign(docs, [1.0, 0.0])


@pytest.mark.parametrize("chunk", [4096, 5])
def test_vectors_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    x = [b + rng.normal(size=8) * 0.2 for b in base for _ in range(6)] + [base[0] * 3, base[0] * 3, base[1] * 1e-200]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(100, None), (101, [0.0] * 8), (102, [float("nan")] + [1.0] * 7), (103, [None] + [1.0] * 7), (104, []),
           (105, [1.0]), (None, rows[0][1]), (106, [float("inf")] + [1.0] * 7)]
    table = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, class int")
    got = {r.vec_id: r for r in vectors.near_duplicates(table, blocks=3).collect()}
    unit = np.array([np.array(v) / np.abs(v).max() for v in x])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    i, j = np.nonzero(np.triu(near, 1))
    component = dict(zip(*(a.tolist() for a in local_components(i, j))))
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id) == (near[k].sum() - 1, component.get(k, k))
        assert got[k].kept == (component.get(k, k) == k)
    for k, _ in bad:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, k is not None)
    assert vectors.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 5])
def test_vectors_of_every_length_are_linked(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    x = [b + rng.normal(size=d) * 0.2 for d, n in ((8, 6), (5, 4), (1, 2)) for b in rng.normal(size=(n, d)) for _ in range(5)]
    x += [rng.normal(size=3)] * 2 + [rng.normal(size=7)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in vectors.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), blocks=3).collect()}
    unit = [v / np.linalg.norm(v) for v in x]
    near = np.array([[len(u) == len(v) and u @ v >= 0.9 for v in unit] for u in unit])
    i, j = np.nonzero(np.triu(near, 1))
    component = dict(zip(*(a.tolist() for a in local_components(i, j))))
    assert got[len(x) - 2].n_links == 1 and got[len(x) - 2].component_id == len(x) - 3
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id) == (near[k].sum() - 1, component.get(k, k))
        assert got[k].kept == (component.get(k, k) == k)


def test_revisits_of_an_id_with_several_payloads(spark):
    rows = [(1, "u", "AAAAAAAAAA"), (2, "u", "AAAAAAAAAA"), (2, "u", "BB"), (3, "u", "BB")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    found = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert found == [(1, 10, "revisit", 2), (2, 2, "revisit", 3), (2, 10, "response", None), (3, 2, "response", None)]
