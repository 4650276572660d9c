"""Conversation structure repair by Knuth's lightest derivations.

A conversation is a row sequence that should read: nothing, or an optional
system turn and then whole user-assistant exchanges.  Repairing it is a
deduction.  An item ``(p, j, q)`` says that the first j lines, entered in
state p, have been edited so that what is kept ends in state q.  Hyperedges
join an item with a weighted line edit (keep, rerole, delete) or an insertion
to the item they prove; their values are (cost, audit), joined by adding
costs and writing the audits one after the other.  The agenda pops the least
value, which is then final, until the goal items are.

The value functions are superior: an audit is a prefix of every audit proved
from it, so none proved later is less.  They are monotone on items: two
audits of one item and one cost are never prefixes of each other, since the
longer would hold an insertion more, and an insertion costs.

States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.

Conversations of any length are worked in blocks of ``BLOCK`` consecutive
lines.  Rows are dealt by range of (conversation, turn, role, text digest,
row number), so one conversation may lie in many tasks; each task solves its
blocks for all entry states.  Blocks of one conversation are then joined
``FAN`` at a time by the same agenda, level by level, and the chosen states
are handed down again.  Only numbers, roles and digests are shuffled; texts
meet their edits by row number at the end.

Order: by turn (nulls first), then role, then md5 of the text; equal rows are
interchangeable.  Nulls: a null role or text is one space, so the row has an
unknown role or is blank; a null conv_id is a conversation of its own.  An
empty role names no speaker and cannot be kept.  Repeated rows are
duplicates.  Without rows the result is empty.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.llm.shared import cut, small_batches, written

BLOCK, FAN = 128, 32
#: Edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STATES = range(4)
#: Where each role initial leads from each state.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPT = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
TURN_TEXT = r"[^\x20\x09-\x0D]"


# ------------------------------------------------------------------- deduction

def lightest(axioms: dict, edges: dict, goals: set, every: bool = True) -> dict:
    """Knuth's agenda: the least (cost, audit, states) of items, until all provable ``goals`` (or, not ``every``, one) are final.

    ``axioms``: item -> value.  ``edges``: item -> [(cost, letters, consequent, step)], the hyperedges that join it
    with a weighted edit or a solved block; ``step`` is written to the states of the derivation.
    """
    final: dict = {}
    agenda = [(cost, audit, item, states) for item, (cost, audit, states) in axioms.items()]
    heapq.heapify(agenda)
    waiting = set(goals)
    while agenda and waiting:
        cost, audit, item, states = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit, states)
        if item in waiting:
            waiting = waiting - {item} if every else set()
        for more, letters, to, step in edges.get(item, ()):
            if to not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, to, states + step))
    return final


def line_edits(code: str) -> list[tuple[int, str, str | None]]:
    """(cost, letter, initial given or None) of a line: its initial, then b(lank), d(uplicate), t(runcated) or -."""
    initial, fault = code[:-1], code[-1]
    out: list[tuple[int, str, str | None]] = [(DELETE, "D", None)]
    if fault in "bd":
        return out
    extra = TRUNCATED if fault == "t" else 0
    if initial in STEPS:
        out.append((extra, "K", initial))
    return out + [(REROLE + extra, "R", x) for x in NAMES]


def exits(p: int, codes: tuple[str, ...]) -> list[int]:
    """The states that can follow the entry state p: an insertion reaches 2 and 3, a kept system line 1, deletions p itself."""
    system = p == 0 and any(c[0] == "s" and c[-1] not in "bd" for c in codes)
    return [q for q in STATES if q == p or q in (2, 3) or (q == 1 and system)]


def solved(codes: tuple[str, ...], whole: bool) -> tuple:
    """(p, q, cost, audit) of a block of lines for every entry state p and exit state q; of a ``whole`` conversation the goal's."""
    edges: dict = {}
    n = len(codes)
    for j in range(n + 1):
        for q in STATES:
            out = [(INSERT, "I", (j, STEPS[x][q]), "") for x in NAMES if q in STEPS[x]]
            for cost, letter, initial in line_edits(codes[j]) if j < n else ():
                if initial is None:
                    out.append((cost, letter, (j + 1, q), ""))
                elif q in STEPS[initial]:
                    out.append((cost, letter, (j + 1, STEPS[initial][q]), ""))
            edges[j, q] = out
    table = []
    for p in STATES[:1] if whole else STATES:
        goals = ACCEPT if whole else exits(p, codes)
        final = lightest({(0, p): (0, "", "")}, edges, {(n, q) for q in goals}, not whole)
        table += [(p, q, *final[n, q][:2]) for q in goals if (n, q) in final]
    return tuple(table)


def joined(tables: list[list[tuple]]) -> list[tuple]:
    """(p, q, cost, audit, states) of consecutive blocks: hyperedges join a prefix item with a block's item.

    ``states`` writes the state before each block and after the last as digits.
    """
    edges: dict = {}
    for k, table in enumerate(tables):
        for p, q, cost, audit in table:
            edges.setdefault((k, p), []).append((cost, audit, (k + 1, q), str(q)))
    out = []
    for p in STATES:
        final = lightest({(0, p): (0, "", str(p))}, edges, {(len(tables), q) for q in STATES})
        out += [(p, q, *final[len(tables), q]) for q in STATES if (len(tables), q) in final]
    return out


# ------------------------------------------------------------------- rows

def lines(rows: DataFrame) -> DataFrame:
    """(uid, conv_id, turn, role, text, initial, blank, truncated, digest), written to the shared folder."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    got = rows.select("conv_id", "turn", role, text).withColumn("uid", F.monotonically_increasing_id())
    last = F.regexp_extract("text", rf"({TURN_TEXT})[\x20\x09-\x0D]*\z", 1)
    return written(got.withColumns({"initial": F.substring("role", 1, 1), "blank": last == "", "truncated": ~last.isin(".", "!", "?"),
                                    "digest": F.md5("text")}), "turns")


def coded(turns: DataFrame) -> DataFrame:
    """``turns`` without texts, with ``fault``: b(lank), d(uplicate), t(runcated) or -, and the columns of the order."""
    narrow = turns.select("uid", "conv_id", "turn", "role", "initial", "blank", "truncated", "digest")
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("uid").alias("c"))
    # only contents that occur more than once go to the join; a first occurrence is a map-side-combined minimum
    again = (narrow.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"),
                                     F.col("first.c").alias("__u")))
    rows = narrow.join(again, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d")), "left")
    fault = (F.when(F.col("blank"), "b").when(F.col("__u") != F.col("uid"), "d").when(F.col("truncated"), "t").otherwise("-"))
    return rows.select("uid", "conv_id", "turn", "role", "digest", "initial", fault.alias("fault"))


PAIR = "array<struct<p:int,q:int,cost:bigint,audit:string>>"


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, part, nth, first, last, illegal, blank, duplicate, truncated, uids, codes, pairs) of every block of at most
    BLOCK lines, written to the shared folder; ``part`` and ``nth`` give their order within a conversation."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("uid")]
    ranged = coded(turns).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "uid", "initial", "fault")
    names = ["conv_id", "part", "nth", "first", "last", "illegal", "blank", "duplicate", "truncated", "uids", "codes", "pairs"]
    kinds = ("part int, nth int, first string, last string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, "
             f"uids array<bigint>, codes array<string>, pairs {PAIR}")
    conv = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pair = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        now, nth, first, kind = None, 0, True, None
        solve = lru_cache(maxsize=1 << 14)(solved)  # most conversations read like others
        uids, codes, rows = [], [], []

        def close(ended: bool):
            # inside a range a conversation is whole; the first and the last of a range may go on in the next
            initials = [c[:-1] for c in codes]
            pairs = solve(tuple(codes), ended and not first and nth == 0)
            rows.append((now[0], part, nth, initials[0], initials[-1], sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                         *(sum(c[-1] == x for c in codes) for x in "bdt"), list(uids), list(codes),
                         [dict(zip(("p", "q", "cost", "audit"), x)) for x in pairs]))

        def batch_of():
            types = [kind, pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.string()),
                     pa.list_(pair)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            kind = batch.column(0).type
            for c, uid, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != (c,):
                    if codes:
                        close(True)
                        first = False
                    now, nth, uids, codes = (c,), 0, [], []
                elif len(codes) == BLOCK:
                    close(False)
                    nth, uids, codes = nth + 1, [], []
                uids.append(uid)
                codes.append(initial + fault)
            if rows:
                yield batch_of()
                rows = []
        if codes:
            close(False)
            yield batch_of()

    return written(ranged.mapInArrow(run, f"conv_id {conv}, {kinds}"), "blocks")


def numbered(found: DataFrame) -> DataFrame:
    """``found`` with ``at``, the number of a block within its conversation, and ``alone``, true of a conversation's only block."""
    parts = found.groupBy("conv_id", "part").agg((F.max("nth") + 1).cast("bigint").alias("n"))
    # a conversation has at most a row for each range of rows here
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(whole)}).filter("total > 1")
    parts = cut(parts.select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), "base"))
    rows = found.join(parts, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")), "left")
    return written(rows.withColumns({"at": (F.coalesce("base", F.lit(0)) + F.col("nth")).cast("bigint"), "alone": F.col("base").isNull()})
                   .drop("__c", "__p", "base", "part", "nth"), "leaves")


def joined_level(level: DataFrame) -> DataFrame:
    """(conv_id, at, pairs with states): FAN consecutive nodes of ``level`` (conv_id, at, pairs) joined to one."""
    conv = level.schema["conv_id"].dataType.simpleString()
    groups = (level.select("conv_id", F.expr(f"at div {FAN}").alias("up"), F.struct("at", "pairs").alias("node"))
              .groupBy("conv_id", "up").agg(F.sort_array(F.collect_list("node")).alias("nodes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("states", pa.string())]))
        for batch in batches:
            out = []
            for nodes in batch.column(2).to_pylist():
                tables = [[(x["p"], x["q"], x["cost"], x["audit"]) for x in node["pairs"]] for node in nodes]
                out.append([dict(zip(("p", "q", "cost", "audit", "states"), x)) for x in joined(tables)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["conv_id", "at", "pairs"])

    kinds = "at bigint, pairs array<struct<p:int,q:int,cost:bigint,audit:string,states:string>>"
    return written(groups.mapInArrow(run, f"conv_id {conv}, {kinds}"), "levels")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def best_pair() -> Column:
    """The lightest goal: entered with nothing, left where a conversation may end."""
    goals = F.filter("pairs", lambda x: (x["p"] == 0) & x["q"].isin(*ACCEPT))
    return F.array_min(F.transform(goals, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"), x["p"].alias("p"), x["q"].alias("q"))))


def chosen_pair() -> Column:
    return F.filter("pairs", lambda x: (x["p"] == F.col("p")) & (x["q"] == F.col("q")))[0]


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired turns and a summary of each conversation of ``rows`` (conv_id, turn, role, text).

    Turns: (conv_id, block, nth, edit, role, text), in the order of block and
    nth; edit is K, R or I (deleted rows have none).  Summary: (conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit).
    """
    small_batches(rows.sparkSession)
    turns = lines(rows)
    leaves = numbered(blocks(turns)).withColumn("best", best_pair())
    alone, parted = leaves.filter("alone"), leaves.filter("not alone")
    # up: join nodes until every conversation is one
    levels = []
    level = parted.select("conv_id", "at", "pairs")
    while level.filter("at > 0").limit(1).count():
        level = joined_level(level)
        levels.append(level)
    roots = level.withColumn("best", best_pair())
    # down: a node's states give its children's entry and exit
    chosen = roots.select("conv_id", "at", "best.p", "best.q")
    for above in reversed(levels):
        states = (above.withColumnsRenamed({"conv_id": "__c", "at": "__a"}).join(chosen, same("__c", "conv_id") & (F.col("__a") == F.col("at")))
                  .select("conv_id", "at", chosen_pair()["states"].alias("states")))
        step = states.select("conv_id", "at", "states", F.explode(F.expr("sequence(0, length(states) - 2)")).alias("i"))
        state = lambda n: F.substr("states", F.col("i") + F.lit(n), F.lit(1)).cast("int")
        chosen = cut(step.select("conv_id", (F.col("at") * FAN + F.col("i")).alias("at"), state(1).alias("p"), state(2).alias("q")))
    inside = parted.join(chosen.withColumnsRenamed({"conv_id": "__c", "at": "__a"}), same("conv_id", "__c") & (F.col("at") == F.col("__a")))
    lone = alone.withColumns({"p": F.col("best.p"), "q": F.col("best.q")})
    cols = ["conv_id", "at", "uids", "codes", "p", "audit"]
    picked = inside.withColumn("audit", chosen_pair()["audit"]).select(cols).unionByName(lone.withColumn("audit", F.col("best.audit")).select(cols))
    return edited(picked, turns), summary(turns, leaves, roots)


def summary(turns: DataFrame, leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """Counts of the blocks, pairs of lines that meet at blocks' edges, and the value of each conversation's goal."""
    value = F.struct("best.cost", "best.audit")
    facts = leaves.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.max(F.when(F.col("alone"), value)).alias("own"))
    ends = leaves.filter("not alone").select("conv_id", "at", "first", "last")
    edges = (ends.join(ends.select(F.col("conv_id").alias("__c"), (F.col("at") + 1).alias("__a"), F.col("last").alias("before")),
                       same("conv_id", "__c") & (F.col("at") == F.col("__a")))
             .filter(~F.concat("before", "first").isin(*LEGAL)).groupBy(F.col("conv_id").alias("__e")).agg(F.count("*").alias("between")))
    span = F.expr("try_cast(cast(max(turn) as decimal(20, 0)) - min(turn) + 1 - count(distinct turn) as bigint)").alias("gaps")
    gaps = turns.groupBy(F.col("conv_id").alias("__g")).agg(span)
    root = roots.filter("at = 0").select(F.col("conv_id").alias("__r"), value.alias("root"))
    rows = (facts.join(gaps, same("conv_id", "__g")).join(root, same("conv_id", "__r"), "left").join(edges, same("conv_id", "__e"), "left")
            .withColumn("goal", F.coalesce("own", "root")))
    return rows.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated",
                       (F.col("illegal") + F.coalesce("between", F.lit(0))).alias("illegal"), "goal.cost", "goal.audit")


def edited(picked: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns that stay: an audit gives every line its edit, and the states give inserted and reroled lines their role."""
    conv = picked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, nth, uid_, edit, role = [], [], [], [], []
            for b, (uids, codes, state, audit) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 6)))):
                line, n = 0, 0
                for letter in audit:
                    if letter != "D":
                        x = codes[line][:-1] if letter == "K" else next(x for x in NAMES if state in STEPS[x])
                        state = STEPS[x][state]
                        take.append(b)
                        nth.append(n)
                        uid_.append(None if letter == "I" else uids[line])
                        edit.append(letter)
                        role.append(None if letter == "K" else NAMES[x])
                        n += 1
                    line += letter != "I"
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(nth, pa.int64()), pa.array(uid_, pa.int64()),
                                              pa.array(edit, pa.string()), pa.array(role, pa.string())],
                                             ["conv_id", "block", "nth", "uid", "edit", "new_role"])

    made = picked.select("conv_id", F.col("at").alias("block"), "uids", "codes", "p", "audit").mapInArrow(
        run, f"conv_id {conv}, block bigint, nth bigint, uid bigint, edit string, new_role string")
    texts = turns.select(F.col("uid").alias("__u"), F.col("role").alias("old_role"), "text")
    # inserted lines have no row number: each gets one of its own below zero, so they are not dealt to one task
    made = made.withColumn("__k", F.expr("coalesce(uid, xxhash64(conv_id, block, nth) | shiftleft(1L, 63))"))
    return (made.join(texts, F.col("__k") == F.col("__u"), "left")
            .select("conv_id", "block", "nth", "edit", F.coalesce("new_role", "old_role").alias("role"),
                    F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")))


# ------------------------------------------------------------------- the registered query's damage and digest

def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with a fifth of them damaged by crc32(``conv_id:turn``) % 20; nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")))
    return (rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.expr("array_repeat(0, if(kind = 3, 2, 1))"))).drop("col"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines, read as a stream in order: a conversation is never held whole."""
    conv = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind, ids, out = None, None, None, [], []
        for batch in batches:
            kind = batch.column(0).type
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != (c,):
                    if now:
                        ids.append(now[0])
                        out.append(state.hexdigest())
                    now, state = (c,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
            ids, out = [], []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "block", "nth").select("conv_id", "role", "text")
            .mapInArrow(run, f"conv_id {conv}, repaired_sha256 string"))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The digest columns for every conversation of the undamaged ``rows``; zeros and empty text where no row is left."""
    turns, facts = repair(damaged(rows))
    every = rows.select("conv_id").distinct()
    hashes = digests(turns)
    out = (every.join(facts.withColumnRenamed("conv_id", "__f"), same("conv_id", "__f"), "left")
           .join(hashes.withColumnRenamed("conv_id", "__h"), same("conv_id", "__h"), "left"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
