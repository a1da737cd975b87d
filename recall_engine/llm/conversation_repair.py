"""Repair of a conversation's turn structure by the cheapest edits.

A repaired conversation alternates user and assistant, begins with the user, or with one system turn before it, and ends
with the assistant; it may also be empty. Each turn is kept, given another role or deleted, and empty turns may be
inserted; blank and repeated turns must go, truncated ones cost more if they stay.

The method is a dynamic programme backward over turns and grammar states: for each turn and state the least cost to the end,
and of the edits that are tight, those whose cost and cost to go add up to it, the one whose letter comes first in
ASCII. A greedy walk forward takes these letters, which gives the least of all cheapest edit strings, and rebuilds the
turns as it goes.

A conversation's digest is one hash over all of its turns in order, so one task reads them one after the other. It never holds
them: first come the conversation's turns without texts, of which the programme keeps four bytes each (the edit string that
is asked for takes one), then the turns with texts, in the same order, which are edited and hashed as they pass. Which
turns repeat an earlier one is settled before, by an aggregation over digests.

Defined results: null roles and texts count as one space. Turns are taken by turn, nulls first, those of one turn by role and
by the digest of their text. A role's initial is its first character; an empty role has none and is never kept. A null
conversation id is a conversation of its own. Conversations that are named but have no turns have zeros, no edits and the
digest of the empty text. Repeated rows are repeated turns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.common import BLANKS, hold

#: Costs of edits, and of leaving a truncated turn in; fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after a system, a user and an assistant turn; and what a new turn leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = {"s": 0, "u": 1, "a": 2}
#: Where an initial leads from each state; -1 where it may not stand.
_KEPT = ((SYSTEM, USER, -1), (-1, USER, -1), (-1, -1, ASSISTANT), (-1, USER, -1))
#: The most steps that are remembered; they repeat, since costs to go differ by little.
_STEPS = 1 << 16
_END = (0, 2 * INSERT, INSERT, 0)


def blank_at_ends(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def damaged(said: DataFrame) -> DataFrame:
    """Conversations with faults by rule, from a checksum of conversation and turn: a twentieth each of turns is left out, emptied,
    loses its sentence ends, comes twice, or is said by the user. Nulls are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = said.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), fault.alias("_f")).filter("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_f") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_i")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("_i")


def _step(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """The costs to go from each state before a turn, and the first letter of each state's least edits. code: the initial (3 for
    none that fits), plus 4 if the turn must go, plus 8 if it is truncated."""
    initial, must_go, extra = code & 3, code & 4, TRUNCATED if code & 8 else 0
    best = []
    for q in range(4):
        found = [(DELETE + after[q], "D")]
        if not must_go:
            if initial < 3 and _KEPT[q][initial] >= 0:
                found.append((extra + after[_KEPT[q][initial]], "K"))
            found.append((REROLE + extra + after[NEXT[q]], "R"))
        best.append(min(found))
    # An insertion stays before this turn. Two in a row return to the state, so each state needs its next one's own best alone,
    # but for the first two, which may insert twice.
    own = list(best)
    for q in (USER, ASSISTANT, START, SYSTEM):
        best[q] = min(best[q], (INSERT + (best if q < USER else own)[NEXT[q]][0], "I"))
    return tuple(c for c, _ in best), "".join(x for _, x in best)


def least_edits(codes: bytes) -> tuple[int, str]:
    """(cost, edits) of a conversation whose turns have these codes."""
    letters = bytearray(4 * len(codes))
    seen: dict[tuple, tuple] = {}
    base, after = 0, _END
    for i in range(len(codes) - 1, -1, -1):
        key = (codes[i], after)
        if key not in seen:
            if len(seen) >= _STEPS:
                seen.clear()
            cost, first = _step(*key)
            low = min(cost)
            seen[key] = (low, tuple(c - low for c in cost), first.encode())
        low, after, first = seen[key]
        base += low
        letters[4 * i : 4 * i + 4] = first
    cost, q, i, out = base + after[START], START, 0, []
    while i < len(codes) or q in (SYSTEM, USER):
        edit = chr(letters[4 * i + q]) if i < len(codes) else "I"
        out.append(edit)
        if edit == "K":
            q = _KEPT[q][codes[i] & 3]
        elif edit != "D":
            q = NEXT[q]
        i += edit != "I"
    return cost, "".join(out)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Walk:
    """One conversation, as its turns pass: first without texts, then with them."""

    def __init__(self, conv) -> None:
        self.conv, self.codes, self.n = conv, bytearray(), dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.previous = self.initial = self.edits = None
        self.distinct = 0
        self.digest, self.done, self.at, self.state, self.i = hashlib.sha256(), 0, 0, START, 0

    def see(self, turn, row: tuple, initial: str, blank: bool, again: bool, truncated: bool) -> None:
        again, self.previous = again or row == self.previous, row
        kind = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
        if kind:
            self.n[kind] += 1
        self.codes.append(_INITIALS.get(initial, 3) | (4 if blank or again else 8 if truncated else 0))
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1

    def solve(self) -> None:
        if self.edits is None:
            self.n["cost"], self.edits = least_edits(bytes(self.codes))
            self.n["gaps"] = self.last - self.first + 1 - self.distinct if self.distinct else 0

    def _put(self, edit: str, role: str | None, text: str | None) -> tuple:
        place = None
        if edit != "D":
            place, self.done = self.done, self.done + 1
            self.digest.update((("\n" if place else "") + role + ":").encode())
            self.digest.update(text.encode())
        return edit, place, role, text

    def _inserted(self) -> Iterator[tuple]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield self._put("I", ROLES[self.state], "")

    def edit(self, role: str, text: str) -> Iterator[tuple]:
        """The edits up to and with this turn's own: (edit, place, role, text); place is null for a deleted turn."""
        yield from self._inserted()
        edit, self.at, code = self.edits[self.at], self.at + 1, self.codes[self.i]
        self.i += 1
        if edit == "K":
            self.state = _KEPT[self.state][code & 3]
        elif edit == "R":
            self.state = NEXT[self.state]
            role = ROLES[self.state]
        yield self._put(edit, role, text)

    def end(self) -> Iterator[tuple]:
        self.solve()
        yield from self._inserted()


def _ordered(messages: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Rows of each conversation one after the other: of kind 0 its name, of kind 1 its turns without, of kind 2 with texts."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))
    rows = rows.withColumn("_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    # Of texts said more than once by a role, the first turn. Where one is said very often, the joined side is light, and Spark's
    # adaptive joins may split it.
    when = F.struct(F.col("turn").isNotNull().alias("_has"), "turn")
    firsts = rows.groupBy("conv_id", "role", "_key").agg(F.min(when).alias("_first"), F.max(when).alias("_last")).filter("NOT (_first <=> _last)")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_key").alias("_k"), "_first")
    solid = blank_at_ends(F.col("text"))
    light = rows.select("conv_id", "turn", "role", "_key", (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_key") == F.col("_k"))
    later = F.coalesce(~when.eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    light = light.join(firsts, same, "left").select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "_key", "blank", later.alias("again"), "truncated", F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast("boolean")
    full = rows.select("conv_id", F.lit(2).alias("_kind"), "turn", "role", "_key", none.alias("blank"), none.alias("again"), none.alias("truncated"), "text")
    every = light.unionByName(full)
    if conversations is not None:
        every = every.unionByName(conversations.select("conv_id").distinct().withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "_kind", F.col("turn").asc_nulls_first(), "role", "_key").select(every.columns)


def _walked(messages: DataFrame, conversations: DataFrame | None, out: list[tuple[str, str]], turn_row: Callable | None, end_row: Callable | None) -> DataFrame:
    """Runs all conversations; turn_row and end_row make output rows of edited turns and of finished conversations."""
    rows = _ordered(messages, conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = ", ".join(f"{n} {t}" for n, t in [("conv_id", kind), *out])
    types = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("conversation_repair")
        walk, id_type = None, pa.null()
        made: list[tuple] = []

        def finish() -> None:
            for e in walk.end():
                if turn_row:
                    made.append(turn_row(walk, e))
            if end_row:
                made.append(end_row(walk))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*made, strict=True)) if made else [()] * (len(out) + 1)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, *(types[t] for _, t in out)], strict=True)], names=["conv_id", *(n for n, _ in out)])

        for b in batches:
            id_type = b.column(0).type
            for conv, k, turn, role, key, blank, again, truncated, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if walk is None or walk.conv != conv:
                    if walk is not None:
                        finish()
                    walk = _Walk(conv)
                if k == 1:
                    walk.see(turn, (turn, role, key), role[:1], blank, again, truncated)
                elif k == 2:
                    walk.solve()
                    for e in walk.edit(role, text):
                        if turn_row:
                            made.append(turn_row(walk, e))
            if made:
                yield flush()
        if walk is not None:
            finish()
            yield flush()

    return rows.mapInArrow(run, schema)


def repaired_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, step, edit, place, role, text): every edit of every conversation in order, and what stands in the repaired one, with
    its place from 0; deleted turns have no place. messages: conv_id, turn, role, text."""
    out = [("step", "long"), ("edit", "string"), ("place", "long"), ("role", "string"), ("text", "string")]

    def row(w: _Walk, e: tuple) -> tuple:
        w.steps = getattr(w, "steps", -1) + 1
        return (w.conv, w.steps, *e)

    return _walked(messages, None, out, row, None)


def repair_report(messages: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. conversations
    names those that may have no turns left."""
    out = [*((n, "long") for n in _COUNTS), ("audit", "string"), ("repaired_sha256", "string")]
    return _walked(messages, conversations, out, None, lambda w: (w.conv, *(w.n[c] for c in _COUNTS), w.edits, w.digest.hexdigest()))
