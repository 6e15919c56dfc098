"""Conversation repair against the enumeration of all short edit sequences."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest

from riskloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, slot string, segment string, digest string, id string"
PATTERN = re.compile(r"(s?(ua)+)?")
TEXTS = ["Fine.", "cut off", "", " \n", "Yes!", "Why?", None, "Fine.", "a much longer text " * 30 + "."]
ROLES = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]


def edited(rows, faults, letters, targets):
    """Cost and messages of one sequence of edits; None if it is not allowed."""
    cost, out, i, targets = 0, [], 0, list(targets)
    for letter in letters:
        if letter == "I":
            cost += 5
            out.append((targets.pop(0), ""))
            continue
        if letter == "D":
            cost += 2
        else:
            if faults[i] in ("blank", "duplicate"):
                return None
            cost += 5 if faults[i] == "truncated" else 0
            if letter == "R":
                cost += 1
                out.append((targets.pop(0), rows[i][1]))
            else:
                out.append(rows[i])
        i += 1
    return cost, out


def brute(rows):
    """The report of one conversation, from every edit sequence with at most two insertions."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    rows = [(role, text) for _, role, text in rows]
    faults, seen = [], set()
    for role, text in rows:
        left = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen
                      else "truncated" if left[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        for inserts in range(3):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
                letters = "".join("I" * places.count(i) + (edits[i] if i < len(rows) else "")
                                  for i in range(len(rows) + 1))
                free = letters.count("I") + letters.count("R")
                for targets in itertools.product(["user", "assistant"], repeat=free):
                    done = edited(rows, faults, letters, targets)
                    if done and PATTERN.fullmatch("".join(r[:1] or "-" for r, _ in done[1])):
                        best = min(best, (done[0], letters, done[1])) if best else (done[0], letters, done[1])
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    initials = [r[:1] for r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            best[0], best[1], hashlib.sha256(text.encode()).hexdigest(), best[2])


def conversations(seed=5, count=60, most=4):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(count)]:
        for turn in range(rng.randrange(1, most + 1)):
            rows.append((conv, rng.choice([turn, turn, turn, 3, None]), rng.choice(ROLES), rng.choice(TEXTS)))
        if rng.random() < 0.3:
            rows.append(rows[-1])
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    report, messages = repair.repair(df, **more)
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    left = defaultdict(list)
    for r in sorted(messages.collect(), key=lambda r: r["segment"]):
        left[r["conv_id"]] += [(m["role"], m["text"]) for m in r["messages"]]
    return got, left


@pytest.mark.parametrize("segment, together", [(1000, 64), (3, 64), (1, 2)])
def test_repairs_are_the_lightest_of_all(spark, segment, together):
    rows = conversations()
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    want = {conv: brute(group) for conv, group in groups.items()}
    got, left = run(spark, rows, segment=segment, together=together)
    assert got == {conv: w[:-1] for conv, w in want.items()}
    assert {conv: left[conv] for conv in want} == {conv: w[-1] for conv, w in want.items()}


def test_a_long_conversation_gives_the_same_in_one_and_in_many_segments(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(ROLES), f"{rng.choice(TEXTS)} {t % 40}{rng.choice(['.', '', '?'])}") for t in range(500)]
    rows += [(2, t, "user", "Same.") for t in range(300)] + [(3, 7, "assistant", "Same.")] * 200
    assert run(spark, rows, segment=5000) == run(spark, rows, segment=7, together=4)


def test_ids_without_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "", "", "", "")], SCHEMA)
    report, messages = repair.repair(rows.where("conv_id = 2"), ids=rows)
    assert [tuple(r) for r in report.collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert messages.count() == 0
    assert repair.repair(rows.limit(0))[0].count() == 0


def test_the_agenda_takes_the_least_audit_of_equal_costs():
    assert repair.derive([("a", False, False)], repair.START, True) == {repair.START: (2, "D")}
    assert repair.derive([("u", False, False), ("u", False, False)], repair.START, True) == {repair.ANSWERED: (1, "KR")}
    assert repair.derive([], repair.START, False)[repair.ANSWERED] == (10, "II")
