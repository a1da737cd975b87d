"""The life of each origin's chain in a stream: what may be appended, what waits, what is a fork, and what a decision makes of it.

The state of an origin lies in the state store, in parts that are read and written by key: where its chain stands, the ids of its
accepted events by sequence, the events that wait, and those in quarantine. So a batch costs what its own events cost.

An event that follows its origin's head is accepted, and with it those that waited for it. One beyond a gap waits; a timer
reports it as overdue if it still waits after the grace. A second event at one place, or one that names another event before
it than the head, is a fork: the origin is frozen at that place, what comes for it from there on goes into quarantine, and
what waits joins it. A decision ends the freeze. If the local branch is canonical, the other one stays in quarantine; if the
remote one is, the local events from the fork on are taken back, and the branch in quarantine is followed as far as it goes.
Nothing that was put in quarantine is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recall_engine.params import PARAMS

#: What a stream of this module needs: the state store that keeps state by key on disk. Where it is to end once its input is used up, batches
#: without data must be off too, since with timers there is always another one; timers then end with the next data.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
OUT = "origin string, sequence long, event_id string, change string"
EVENT, RESOLVE = "event", "resolve"
ACCEPTED, WAITS, OVERDUE, FROZEN, QUARANTINED, TAKEN_BACK, RESOLVED = "accepted", "waiting", "overdue", "frozen", "quarantined", "taken back", "resolved"


class OriginChain(StatefulProcessor):
    """The state machine of one origin. Rows: kind (event or resolve), sequence, event_id, previous_event_id; of a resolve, event_id
    is local or remote."""

    def __init__(self, grace_hours: float) -> None:
        self.grace = int(grace_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "last long, head string, fork long")
        self.ids = handle.getMapState("ids", "sequence long", "event_id string, previous string")
        self.waiting = handle.getMapState("waiting", "sequence long, event_id string", "previous string, since long")
        self.held = handle.getMapState("held", "sequence long, event_id string", "previous string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, head, fork = self.at.get() if self.at.exists() else (0, "", 0)
        out: list[tuple] = []
        now = timerValues.getCurrentProcessingTimeInMs()
        batch = [r for df in rows for r in zip(df["kind"], df["sequence"], df["event_id"], df["previous_event_id"], strict=True)]
        # within a batch in order, decisions last, so that how a batch is cut out of the stream matters as little as can be
        for kind, sequence, event, previous in sorted(batch, key=lambda r: (r[0] == RESOLVE, r[1], r[2])):
            previous = previous or ""
            if kind == RESOLVE:
                if fork:
                    last, head = self._resolve(event, fork, last, head, out)
                    fork = 0
                    last, head, fork = self._drain(last, head, fork, out)
            elif self.held.containsKey((sequence, event)) or self.waiting.containsKey((sequence, event)):
                continue
            elif sequence <= last and self.ids.getValue((sequence,))[0] == event:
                continue
            elif fork and sequence >= fork:
                self._hold(sequence, event, previous, out)
            elif sequence <= last or sequence == last + 1 and previous != head:
                fork = self._freeze(sequence, event, previous, out)
            elif sequence > last + 1:
                self.waiting.updateValue((sequence, event), (previous, now))
                self.handle.registerTimer(now + self.grace)
                out.append((sequence, event, WAITS))
            else:
                last, head = self._accept(sequence, event, previous, out)
                last, head, fork = self._drain(last, head, fork, out)
        self.at.update((last, head, fork))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() - self.grace
        late = [(s, e, OVERDUE) for (s, e), (_, since) in list(self.waiting.iterator()) if since <= until]
        yield self._frame(key, late)

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"origin": text([key[0]] * len(out)), "sequence": pd.Series([x[0] for x in out], dtype="int64"), "event_id": text([x[1] for x in out]), "change": text([x[2] for x in out])})

    def _accept(self, sequence: int, event: str, previous: str, out: list[tuple]) -> tuple[int, str]:
        self.ids.updateValue((sequence,), (event, previous))
        out.append((sequence, event, ACCEPTED))
        return sequence, event

    def _hold(self, sequence: int, event: str, previous: str, out: list[tuple]) -> None:
        self.held.updateValue((sequence, event), (previous,))
        out.append((sequence, event, QUARANTINED))

    def _freeze(self, sequence: int, event: str, previous: str, out: list[tuple]) -> int:
        out.append((sequence, event, FROZEN))
        self._hold(sequence, event, previous, out)
        for (s, e), (p, _) in sorted(self.waiting.iterator()):
            if s >= sequence:
                self.waiting.removeKey((s, e))
                self._hold(s, e, p, out)
        return sequence

    def _drain(self, last: int, head: str, fork: int, out: list[tuple]) -> tuple[int, str, int]:
        """Takes up what waited, as far as it follows."""
        ready = sorted(self.waiting.iterator())
        for (s, e), (p, _) in ready:
            if fork or s > last + 1:
                break
            self.waiting.removeKey((s, e))
            if s == last + 1 and p == head:
                last, head = self._accept(s, e, p, out)
            else:
                fork = self._freeze(s, e, p, out)
        return last, head, fork

    def _resolve(self, canonical: str, fork: int, last: int, head: str, out: list[tuple]) -> tuple[int, str]:
        out.append((fork, canonical, RESOLVED))
        branch = sorted(self.held.iterator())
        if canonical == "remote":
            for s in range(fork, last + 1):
                own, previous = self.ids.getValue((s,))
                self.ids.removeKey((s,))
                self.held.updateValue((s, own), (previous,))
                out.append((s, own, TAKEN_BACK))
            last = fork - 1
            head = self.ids.getValue((last,))[0] if last else ""
        # what was held and follows the canonical branch is taken up; the rest stays
        for (s, e), (p,) in branch:
            if s == last + 1 and p == head:
                self.held.removeKey((s, e))
                last, head = self._accept(s, e, p, out)
        return last, head


def origin_changes(stream: DataFrame, grace_hours: float = PARAMS.park_grace) -> DataFrame:
    """(origin, sequence, event_id, change) as a stream, in append mode. stream: origin, kind, sequence, event_id, previous_event_id."""
    rows = stream.select(F.col("origin").cast("string").alias("origin"), "kind", F.col("sequence").cast("long").alias("sequence"), F.col("event_id").cast("string").alias("event_id"), F.coalesce(F.col("previous_event_id").cast("string"), F.lit("")).alias("previous_event_id"))
    return rows.groupBy("origin").transformWithStateInPandas(OriginChain(grace_hours), OUT, "Append", "ProcessingTime")


def standing(changes: DataFrame) -> DataFrame:
    """(origin, frontier, frozen): where each origin's chain stands after all its changes; rows of ``origin_changes`` with n, the batch that
    they came with. An event counts if it was last accepted, not taken back."""
    last = changes.filter(F.col("change").isin(ACCEPTED, TAKEN_BACK)).groupBy("origin", "sequence", "event_id").agg(F.max_by("change", "n").alias("_c"))
    frontier = last.filter(F.col("_c") == ACCEPTED).groupBy("origin").agg(F.max("sequence").alias("frontier"))
    forks = changes.filter(F.col("change").isin(FROZEN, RESOLVED)).groupBy("origin").agg(F.count_if(F.col("change") == FROZEN).alias("_f"), F.count_if(F.col("change") == RESOLVED).alias("_r"))
    every = changes.select("origin").distinct().join(frontier, "origin", "left").join(forks, "origin", "left")
    return every.select("origin", F.coalesce("frontier", F.lit(0)).cast("long").alias("frontier"), (F.coalesce("_f", F.lit(0)) > F.coalesce("_r", F.lit(0))).alias("frozen"))
