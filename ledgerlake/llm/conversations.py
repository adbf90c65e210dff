"""Conversation repair by weighted CYK over spans of messages.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. A repair keeps, re-roles or deletes each message
and may insert empty ones anywhere; the cheapest repair wins, and among equally cheap ones the ASCII-least audit (the
edits' initials in order).

The grammar is in Chomsky normal form. Its nonterminals are the pairs (p, q) of places in the pattern (nothing yet, after
s, after u, after a): (p, q) derives the spans whose edits lead from p to q, by (p, q) -> (p, r) (r, q) or by one message.
A cell of a span holds the least (cost, audit) of every nonterminal. Insertions are a closure: the cell of one message is
insertions, one edit, insertions. Cells combine bottom-up by span length. Because *every* derivation of a span passes some
place at *every* inner border, one split per span yields the same minimum as all splits, so lengths can double and a
span of n messages takes n combinations, not n^3. Equal costs never have audits of which one begins the other (equal
messages, so the longer one has more insertions and costs more), so the order of audits survives concatenation.

On Spark the messages are sorted by conversation and turn over *ranges*, so a conversation with a third of all messages is
cut into spans of many tasks. Every task reduces its stretches of a conversation to spans of at most ``SPAN`` messages;
spans of one conversation then combine level by level, ``FAN_IN`` at a time. Duplicates come from a minimum per
(conversation, role, text), not from a window. The repaired text is hashed while messages stream by, sorted, so no
conversation is held in memory; only its audit is (a byte per edit). A single conversation's hash is sequential by
definition of SHA-256.

Nulls count as one space: in the key of the damage, as role (no known role, so it must be re-roled or deleted) and as
text (blank). A null conversation number is a conversation. Messages of the same turn are ordered by role, then by the
sha256 of the text; repeated rows are duplicates. Empty roles have no initial. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ledgerlake.llm.common import SPACE_CLASS, scratch, written

# Costs and initials of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Places in the pattern: nothing yet, after s, after u, after a (the places 0 and 3 may end it).
STARTS, ENDS = 0, (0, 3)
ROLES = {"u": "user", "a": "assistant"}
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPAN = 4096
FAN_IN = 16

Cell = dict[tuple[int, int], tuple[int, str]]  # nonterminal: least (cost, audit)


# --- the grammar


def _offer(cell: Cell, nonterminal: tuple[int, int], cost: int, audit: str) -> None:
    if nonterminal not in cell or (cost, audit) < cell[nonterminal]:
        cell[nonterminal] = cost, audit


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two parts: (p, q) -> (p, r) (r, q)."""
    out: Cell = {}
    for (p, r), (c1, a1) in left.items():
        for (r2, q), (c2, a2) in right.items():
            if r == r2:
                _offer(out, (p, q), c1 + c2, a1 + a2)
    return out


@lru_cache(maxsize=1)
def _insertions() -> Cell:
    """Closure: cheapest runs of inserted user and assistant messages between places, the empty run included."""
    one: Cell = {(p, p): (0, "") for p in range(4)}
    for (p, role), q in STEPS.items():
        if role != "s":
            _offer(one, (p, q), INSERT, "I")
    while (more := combine(one, one)) != one:
        one = more
    return one


@lru_cache(maxsize=None)
def message_cell(role: str, fault: str) -> Cell:
    """One message: role is its initial if s, u or a, else ``-``; fault is b (blank), d (duplicate), t (truncated) or ``-``."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        for (p, to), q in STEPS.items():
            if to == role:
                _offer(edits, (p, q), KEEP + extra, "K")
            if to != "s":
                _offer(edits, (p, q), REROLE + extra, "R")
    return combine(combine(_insertions(), edits), _insertions())


def _levels(cells: list[Cell]) -> Cell:
    """Neighbouring spans combine until one is left; span lengths double."""
    while len(cells) > 1:
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


@lru_cache(maxsize=1 << 14)
def _short(kinds: str) -> Cell:
    return _levels([message_cell(kinds[i], kinds[i + 1]) for i in range(0, len(kinds), 2)])


def parse(kinds: str) -> Cell:
    """The cell of a span, two characters per message; stretches of eight, which recur, are remembered."""
    return _levels([_short(kinds[i:i + 16]) for i in range(0, len(kinds), 16)])


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[STARTS, q] for q in ENDS if (STARTS, q) in cell)


def edits(audit: str, initials: str) -> Iterator[tuple[str, str | None]]:
    """Edits in order, each with the role that it gives (None: the message's own); ``initials`` has one per message."""
    place, at = STARTS, 0
    for e in audit:
        own = "-" if e == "I" else initials[at]
        at += e != "I"
        if e != "D":
            to = own if e == "K" else "a" if place == 2 else "u"
            place = STEPS[place, to]
        yield e, (ROLES[to] if e in "IR" else None)


# --- messages


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the contract's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    blank("role").alias("role"), blank("text").alias("text"),
                    (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("how"))
    text = (F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    d = d.where("how <> 0").select(
        "conv_id", "turn", F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return d.drop("copy")


def messages(rows: DataFrame) -> DataFrame:
    """A written table of messages: conv_id, turn, role, text, id (unique), h (sha256 of the text), fault without duplicates."""
    text = F.col("text")
    fault = (F.when(~text.rlike(f"[^{SPACE_CLASS}]"), F.lit("b"))
             .when(text.rlike(rf"[.!?][{SPACE_CLASS}]*\z"), F.lit("-")).otherwise(F.lit("t")))
    return written(rows.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("id"), F.sha2("text", 256).alias("h"),
        F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")), "messages", keep=True)


def _order(c: str = "") -> list[Column]:
    return [F.col(c + x).asc_nulls_first() for x in ("turn", "role", "h", "id")]


def with_duplicates(slim: DataFrame) -> DataFrame:
    """Marks messages whose role and text were seen earlier in the conversation (unless blank) with fault d."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id")
    again = slim.groupBy("conv_id", "role", "h").agg(F.min(place)["id"].alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), "first")
    on = slim["conv_id"].eqNullSafe(again["_c"]) & (slim["role"] == again["_r"]) & (slim["h"] == again["_h"])
    later = (F.col("fault") != "b") & (F.col("id") != F.col("first"))
    return (slim.join(again, on, "left").withColumn("fault", F.when(later, F.lit("d")).otherwise(F.col("fault")))
            .select(*slim.columns))


# --- spans

_SPAN = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("initials", pa.string()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first_role", pa.string()), ("last_role", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("turns", pa.int64()),
    ("cells", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
_LEGAL = {"su", "ua", "au"}


def _known(initial: str) -> str:
    return initial if initial and initial in "sua" else "-"


class _Stretch:
    """Messages of one conversation in order, up to ``SPAN`` of them, on their way to a span row."""

    def __init__(self, conv_id):
        self.conv_id, self.kinds, self.faults, self.initials, self.turns, self.n = conv_id, [], [], [], [], 0

    def row(self, part: int, k: int) -> dict:
        kinds = "".join(_known(i) + f for i, f in zip(self.initials, self.faults))
        known = [t for t in self.turns if t is not None]
        return {"conv_id": self.conv_id, "part": part, "k": k, "n": len(self.faults),
                "initials": kinds[::2], "blank": self.faults.count("b"),
                "duplicate": self.faults.count("d"), "truncated": self.faults.count("t"),
                "illegal": sum(a + b not in _LEGAL for a, b in zip(self.initials, self.initials[1:])),
                "first_role": self.initials[0], "last_role": self.initials[-1],
                "lo": known[0] if known else None, "hi": known[-1] if known else None, "turns": len(set(known)),
                "cells": _as_rows(parse(kinds))}


def _as_rows(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]


def _as_cell(rows) -> Cell:
    return {(r["p"], r["q"]): (r["cost"], r["audit"]) for r in rows}


def spans(slim: DataFrame, span: int = SPAN) -> DataFrame:
    """Span rows of each task's stretches; (part, k) orders the spans of a conversation."""
    def cut(batches):
        from pyspark import TaskContext

        part, k, open_, out = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for conv, turn, initial, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))):
                if open_ is None or open_.conv_id != conv or len(open_.faults) == span:
                    if open_:
                        out.append(open_.row(part, k))
                        k += 1
                    open_ = _Stretch(conv)
                open_.turns.append(turn)
                open_.initials.append(initial)
                open_.faults.append(fault)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, _SPAN)
                out = []
        if open_:
            out.append(open_.row(part, k))
        if out:
            yield pa.RecordBatch.from_pylist(out, _SPAN)

    # Conversations that a range border cuts become several spans, so no conversation is one task.
    ranged = slim.select("conv_id", "turn", "role", "h", "id", "initial", "fault").repartitionByRange(
        F.col("conv_id").asc_nulls_first(), *_order())
    return ranged.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order()).mapInArrow(cut, from_arrow_schema(_SPAN))


def _joined(rows: list[dict]) -> dict:
    """Neighbouring spans of one conversation as one; a turn on both sides of a border counts once."""
    out = dict(rows[0])
    for r in rows[1:]:
        out["illegal"] += r["illegal"] + (out["last_role"] + r["first_role"] not in _LEGAL)
        out["turns"] += r["turns"] - (out["hi"] is not None and out["hi"] == r["lo"])
        out["lo"] = r["lo"] if out["lo"] is None else out["lo"]
        out["hi"] = r["hi"] if r["hi"] is not None else out["hi"]
        out["last_role"] = r["last_role"]
        for c in ("n", "blank", "duplicate", "truncated", "initials"):
            out[c] += r[c]
    out["cells"] = _as_rows(_levels([_as_cell(r["cells"]) for r in rows]))
    return out


def combined(found: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One span per conversation: rounds of ``fan_in`` neighbours, until none has two."""
    def join(batches):
        for b in batches:
            rows = [_joined(sorted(g, key=lambda r: (r["part"], r["k"]))) for g in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _SPAN)

    done = []
    found = written(found, "spans")
    while True:
        several = found.groupBy("conv_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("conv_id").alias("_c"))
        several = written(several, "several")
        split = several.isEmpty()
        done.append(found if split else found.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti"))
        if split:
            break
        # Their number within the conversation, by a rank over spans (thousands of messages each), then blocks of neighbours.
        rest = found.join(several, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "k")) - 1
        keys = rest.select("conv_id", "part", "k").withColumn("at", place)
        keys = keys.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("k").alias("_k"), "at")
        rest = rest.join(keys, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("k") == F.col("_k")))
        blocks = rest.groupBy("conv_id", F.floor(F.col("at") / fan_in).alias("block")).agg(
            F.collect_list(F.struct(*_SPAN.names)).alias("spans"))
        found = written(blocks.select("spans").mapInArrow(join, from_arrow_schema(_SPAN)), "spans")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# --- repair


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired messages, deleted ones left out, sorted within each partition.

    rows: messages; plans: conv_id, audit, initials. A plan sorts before the messages of its conversation, which take
    their edits from it as they stream by.
    """
    head = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                        F.lit("").alias("h"), F.lit(0).cast("long").alias("id"), F.col("audit").alias("text"), "initials")
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h", "id", "text", F.lit("").alias("initials"))
    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())

    def follow(batches):
        conv, todo, place, out = None, iter(()), 0, []

        def put(edit, role, text):
            nonlocal place
            out.append((conv, place, edit, role, text))
            place += 1

        def insert_rest():
            for edit, to in todo:  # insertions after the last message
                put(edit, to, "")

        for b in batches:
            columns = [b.column(c) for c in ("conv_id", "kind", "role", "text", "initials")]
            for i in range(b.num_rows):
                c, kind, role, text, initials = (x[i].as_py() for x in columns)
                if kind == 0:
                    insert_rest()
                    conv, todo, place = c, edits(text, initials), 0
                    continue
                for edit, to in todo:
                    if edit != "I":
                        if edit != "D":
                            put(edit, to or role, text)
                        break
                    put(edit, to, "")
            if out:
                yield _batch(out, _REPAIRED)
                out.clear()
        insert_rest()
        if out:
            yield _batch(out, _REPAIRED)

    return stream.select("conv_id", "kind", "role", "text", "initials").mapInArrow(follow, from_arrow_schema(_REPAIRED))


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def digests(stream: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``repaired``, whose partitions hold whole conversations in order; nothing is gathered."""
    def run(batches):
        conv, digest = None, None
        for b in batches:
            out, columns = [], [b.column(c) for c in ("conv_id", "place", "role", "text")]
            for i in range(b.num_rows):
                c, place, role, text = (x[i].as_py() for x in columns)
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if place == 0:
                    if digest:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if out:
                yield _batch(out, _DIGEST)
        if digest:
            yield _batch([(conv, digest.hexdigest())], _DIGEST)

    return stream.mapInArrow(run, from_arrow_schema(_DIGEST))


def plan_repairs(rows: DataFrame, span: int = SPAN, fan_in: int = FAN_IN) -> DataFrame:
    """rows: ``messages``. Per conversation: gaps, counts of faults and illegal neighbours, cost, audit, initials."""
    slim = with_duplicates(rows.drop("text"))
    one = combined(spans(slim, span), fan_in)
    ended = F.filter("cells", lambda c: (c["p"] == STARTS) & c["q"].isin(*ENDS))
    least = F.array_min(F.transform(ended, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = (wide("hi") - wide("lo") + 1 - F.col("turns")).try_cast("long")
    return one.select("conv_id", F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated",
                      "illegal", least["cost"].alias("cost"), least["audit"].alias("audit"), "initials")


def repair(rows: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """rows: conv_id, turn, role, text (no nulls but in conv_id and turn). Returns the plans and the repaired messages."""
    with scratch(rows.sparkSession):
        kept = messages(rows)
        plans = written(plan_repairs(kept, **how), "plans", keep=True)
    return plans, repaired(kept, plans)


def repair_digests(conversations: DataFrame, **how) -> DataFrame:
    """One row per conversation of the table, also those that the damage leaves without messages."""
    plans, stream = repair(damage(conversations), **how)
    hashes = digests(stream)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids
    for found in (plans.drop("initials"), hashes):
        found = found.withColumnRenamed("conv_id", "_c")
        out = out.join(found, out["conv_id"].eqNullSafe(found["_c"]), "left").drop("_c")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in
                                   ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
