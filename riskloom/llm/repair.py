"""Repair of conversation structure as lightest derivations.

A conversation is right if its role initials read (s?(ua)+)?. Repairing one is a search for the
lightest derivation of a goal item: item (i, state) says that the first i rows have been edited and
that what is left of them, with what was inserted, leads to that state of the pattern. Its weight is
(cost, audit), the audit being the initials of the edits. Every edit is a deduction whose weight is a
monotone and superior function of its premise: costs never fall, and of two audits with one cost
neither begins the other, so appending keeps their order. Items are therefore popped from an agenda
in ascending weight, and the first time an item is popped its weight is final.

Rows are put in order over the whole table and cut into segments of a bounded number of rows. A
conversation inside one segment is solved there. One that crosses a border, however long, has the
lightest derivation between every two states of each of its segments found where the segment is; those
are the rules of a second agenda over segments, in rounds if there are many.
"""

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.sources.tables import stored

# Costs of the edits, and the pattern of role initials as a graph of states.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ANSWERED = range(4)
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ANSWERED}, {"u": USER}]
#: States in which a conversation may end.
DONE = (START, ANSWERED)
#: The only role that an inserted or changed row can have in a state.
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ANSWERED: "user"}
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a segment, and segments that one task puts together.
SEGMENT, TOGETHER = 1000, 64


# ---------------------------------------------------------------- agenda


def deductions(row: tuple | None, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows consumed, next state) of every edit before or of a row."""
    changed = NEXT[state][ROLE[state][0]]
    yield INSERT, "I", 0, changed
    if row is not None:
        initial, must_go, truncated = row
        yield DELETE, "D", 1, state
        if not must_go:
            extra = TRUNCATED if truncated else 0
            yield REROLE + extra, "R", 1, changed
            if initial in NEXT[state]:
                yield KEEP + extra, "K", 1, NEXT[state][initial]


def derive(rows: list[tuple], state: int, whole: bool) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from `state` before the rows to each state behind them.

    With `whole` only the goal counts: the first final item in a state of DONE ends the search.
    """
    agenda, final, ends = [(0, "", 0, state)], set(), {}
    while agenda:
        cost, audit, i, at = heapq.heappop(agenda)
        if (i, at) in final:
            continue
        final.add((i, at))
        if i == len(rows) and (at in DONE or not whole):
            ends[at] = (cost, audit)
            if whole or len(ends) == len(NEXT):
                break
        for more, letter, step, to in deductions(rows[i] if i < len(rows) else None, at):
            if (i + step, to) not in final:
                heapq.heappush(agenda, (cost + more, audit + letter, i + step, to))
    return ends


def chain(segments: list[list[tuple]], state: int, whole: bool) -> dict[int, tuple]:
    """Lightest (cost, audit, path) through segments whose rules are (from, to, cost, audit, path)."""
    agenda, final, ends, trace = [(0, "", 0, state, 0)], set(), {}, [()]
    while agenda:
        cost, audit, k, at, told = heapq.heappop(agenda)
        if (k, at) in final:
            continue
        final.add((k, at))
        if k == len(segments):
            if at in DONE or not whole:
                ends[at] = (cost, audit, told)
            if whole and ends:
                break
            continue
        for p, q, more, letters, path in segments[k]:
            if p == at and (k + 1, q) not in final:
                trace.append((told, path))
                heapq.heappush(agenda, (cost + more, audit + letters, k + 1, q, len(trace) - 1))

    def steps(told: int) -> list:
        parts = []
        while told:
            told, path = trace[told]
            parts.append(path)
        return [step for path in reversed(parts) for step in path]

    return {q: (cost, audit, steps(told)) for q, (cost, audit, told) in ends.items()}


def replay(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """The rows that the edits leave."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role, text = (ROLE[state], "") if letter == "I" else rows[i]
        if letter == "R":
            role = ROLE[state]
        state = NEXT[state][role[:1]]
        out.append((role, text))
        i += letter != "I"
    return out


def as_text(messages: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in messages)


# ---------------------------------------------------------------- segments


def records(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in fields.items()]))


TEXT, WHOLE, SMALL = T.StringType(), T.LongType(), T.IntegerType()
MESSAGES = records(role=TEXT, text=TEXT)
PATH = records(segment=WHOLE, source=SMALL, target=SMALL)
RULES = records(source=SMALL, target=SMALL, cost=WHOLE, audit=TEXT, path=PATH)
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def segment_schema(conversation: T.DataType) -> T.StructType:
    return (T.StructType([T.StructField("conv_id", conversation)])
            .add("segment", "long").add("open", "boolean").add("first", "string").add("last", "string")
            .add("blank", "long").add("duplicate", "long").add("truncated", "long").add("illegal", "long")
            .add("rules", RULES).add("messages", MESSAGES).add("sha256", "string"))


def arrow_of(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def solve_run(conversation, segment: int, rows: list[dict], first_slots: set, open_: bool) -> dict:
    """One conversation's rows of one segment: faults, rules, and the rows themselves."""
    out = dict.fromkeys(COUNTS, 0)
    judged = []
    for r in rows:
        left = r["text"].rstrip(SPACES)
        fault = ("blank" if not left else "duplicate" if r["slot"] not in first_slots
                 else "truncated" if left[-1] not in ".!?" else None)
        if fault:
            out[fault] += 1
        judged.append((r["role"][:1], fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [initial for initial, _, _ in judged]
    messages = [(r["role"], r["text"]) for r in rows]
    sources = range(len(NEXT)) if open_ else (START,)
    rules = [(p, q, cost, audit) for p in sources for q, (cost, audit) in derive(judged, p, not open_).items()]
    if not open_:
        messages = replay(messages, rules[0][3], START)
    return out | {
        "conv_id": conversation, "segment": segment, "open": open_, "first": initials[0], "last": initials[-1],
        "illegal": illegal_pairs(initials),
        "rules": [dict(zip(("source", "target", "cost", "audit", "path"),
                           (*rule, [{"segment": segment, "source": rule[0], "target": rule[1]}] if open_ else [])))
                  for rule in rules],
        "messages": [{"role": a, "text": b} for a, b in messages],
        "sha256": None if open_ else hashlib.sha256(as_text(messages).encode()).hexdigest()}


def solver(schema: T.StructType):
    def solve(key: tuple, rows: pa.Table, firsts: pa.Table) -> pa.Table:
        known = set(firsts["slot"].to_pylist())
        rows, runs, last = rows.sort_by("slot").to_pylist(), [], object()
        for r in rows:
            if runs and r["conv_id"] == last:
                runs[-1].append(r)
            else:
                runs.append([r])
                last = r["conv_id"]
        segment = key[0].as_py()
        # The first and the last run may go on in a neighbouring segment.
        solved = [solve_run(run[0]["conv_id"], segment, run, known, i in (0, len(runs) - 1))
                  for i, run in enumerate(runs)]
        return pa.Table.from_pylist(solved, schema=arrow_of(schema))

    return solve


def joiner(schema: T.StructType, whole: bool):
    """Neighbouring segments of one conversation as one."""

    def put_together(key: tuple, table: pa.Table) -> pa.Table:
        parts = table.sort_by("segment").to_pylist()
        segments = [[tuple(r[c] for c in ("source", "target", "cost", "audit", "path")) for r in p["rules"]]
                    for p in parts]
        rules = [{"source": p, "target": q, "cost": cost, "audit": audit, "path": path}
                 for p in ((START,) if whole else range(len(NEXT)))
                 for q, (cost, audit, path) in chain(segments, p, whole).items()]
        across = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
        row = {c: sum(p[c] for p in parts) for c in COUNTS}
        row |= {"conv_id": parts[0]["conv_id"], "segment": parts[0]["segment"], "first": parts[0]["first"],
                "last": parts[-1]["last"], "illegal": row["illegal"] + across, "rules": rules}
        return pa.Table.from_pylist([row], schema=arrow_of(schema))

    return put_together


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of open segments after the edits that the chosen path has for them."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            audit = next(x["audit"] for x in r["rules"] if (x["source"], x["target"]) == (r["source"], r["target"]))
            left = replay([(m["role"], m["text"]) for m in r["messages"]], audit, r["source"])
            out.append([{"role": a, "text": b} for a, b in left])
        kind = batch.schema.field("messages").type
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["segment"], pa.array(out, kind)], ["conv_id", "segment", "messages"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's text, fed segment by segment; a task has whole conversations in order."""
    kind, seen, now, state, begun = None, False, None, None, False

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conversation, messages in zip(batch["conv_id"].to_pylist(), batch["messages"].to_pylist()):
            if not seen or conversation != now:
                if seen:
                    yield row()
                seen, now, state, begun = True, conversation, hashlib.sha256(), False
            if messages:
                state.update((("\n" if begun else "") + as_text([(m["role"], m["text"]) for m in messages])).encode())
                begun = True
    if seen:
        yield row()


# ---------------------------------------------------------------- operator


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with a `slot` that numbers them by conversation, turn (NULL first), role and MD5 of the text.

    The order is a range partitioning over all conversations with a last key that no two rows share,
    so that neither a long conversation nor a repeated row fills one task.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "tie")]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    return stored(ranged.sortWithinPartitions(*order).drop("tie")
                  .withColumn("slot", F.monotonically_increasing_id()), "turns")


def segment_of(slot: str, rows: int) -> Column:
    """Number of the segment of a slot: its partition, then so many places of the partition each."""
    place = F.col(slot).bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(F.shiftright(slot, 33), 33) + F.floor(place / F.lit(rows))


def repair(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    ids: DataFrame | None = None, segment: int = SEGMENT, together: int = TOGETHER,
) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation, and the repaired messages.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, one
    row per id of `ids` (default: those of the rows). A row's faults: blank (only white space),
    duplicate (role and text stand earlier in the conversation), truncated (the last other character
    is none of .!?); the first that holds counts. Blank and duplicate rows must go, truncated ones
    cost 5 if they stay; keeping is free, another role costs 1, deleting 2, inserting an empty message
    5. Of repairs of equal cost the one with the least audit in ASCII order is taken.

    Messages: conv_id, segment and an array of (role, text) in order; a conversation that crosses
    segments has several rows, in ascending order of `segment`.

    A NULL role or text counts as one space, a NULL turn comes first, NULL ids are one conversation.
    Rows of one turn stand in the order of role and MD5 of the text, so repeated rows are adjacent.
    An id without rows has zeros, an empty audit and the digest of nothing; an empty table gives no
    rows. Long texts are held by the task of their segment alone. Other columns are not read. The
    audit of a conversation is one string, whatever its length; its digest is fed segment by segment.
    """
    plain = rows.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    placed = in_order(plain.withColumn("digest", F.md5("text"))).withColumn("segment", segment_of("slot", segment))
    kind = placed.schema["conv_id"].dataType
    schema = segment_schema(kind)
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("slot").alias("slot"))
    firsts = firsts.select("slot", segment_of("slot", segment).alias("segment"))
    solved = stored(
        placed.select("segment", "slot", "conv_id", "role", "text").groupBy("segment")
        .cogroup(firsts.groupBy("segment")).applyInArrow(solver(schema), schema), "segments")

    # Conversations at a border of segments: at most two in a segment, apart from the long ones.
    facts = ["conv_id", "segment", "first", "last", *COUNTS, "rules"]
    edge, small = solved.where("open").select(*facts), T.StructType([schema[c] for c in facts])
    level = edge
    for shift in range(6, 64, 6):
        most = level.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        if most <= together:
            break
        level = stored(level.groupBy("conv_id", F.shiftright("segment", shift).alias("block")).applyInArrow(
            joiner(small, False), small), "joined")
    joined = stored(level.groupBy("conv_id").applyInArrow(joiner(small, True), small), "joined")

    steps = joined.select("conv_id", F.explode(F.col("rules")[0]["path"]).alias("step")).select(
        F.col("conv_id").alias("of"), "step.*").withColumnRenamed("segment", "at")
    open_ = solved.where("open").select("conv_id", "segment", "rules", "messages")
    chosen = open_.join(steps, open_["conv_id"].eqNullSafe(steps["of"]) & (open_["segment"] == steps["at"]))
    message_schema = T.StructType([schema[c] for c in ("conv_id", "segment", "messages")])
    finished = stored(chosen.select("conv_id", "segment", "rules", "messages", "source", "target")
                      .mapInArrow(finish, message_schema), "messages")
    messages = solved.where("NOT open").select("conv_id", "segment", "messages").unionByName(finished)

    digest_schema = T.StructType([schema["conv_id"], schema["sha256"]])
    hashed = (finished.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "segment")
              .mapInArrow(digests, digest_schema).withColumnRenamed("conv_id", "of"))
    best = F.col("rules")[0]
    counted = [*COUNTS, best["cost"].alias("cost"), best["audit"].alias("audit"), "sha256"]
    report = solved.where("NOT open").select("conv_id", *counted).unionByName(
        joined.join(hashed, joined["conv_id"].eqNullSafe(hashed["of"])).select("conv_id", *counted))

    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
    gaps = placed.groupBy("conv_id").agg(F.coalesce(span.try_cast("long"), F.lit(0)).alias("gaps"))
    ids = (rows if ids is None else ids).select(F.col(conversation).alias("id")).distinct()
    left = ids.join(gaps, ids["id"].eqNullSafe(gaps["conv_id"]), "left").drop("conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return left.join(report, left["id"].eqNullSafe(report["conv_id"]), "left").select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256")), messages
