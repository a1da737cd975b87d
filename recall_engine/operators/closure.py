"""Events that depend on what other events make, brought to a fixpoint.

An event is ready when all that it needs has been made by events that are ready. The closure goes round by round: what the last
round made is joined to the needs that are still open, and those events that have no open need left are the next round.
A round touches what is open alone, so all rounds together cost about what the needs cost once, times the
lengths that needs wait; the rounds are as many as the longest chain. They end when a round makes nothing ready.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.sources.files import checkpointed


class NotSettled(RuntimeError):
    """The bound on rounds was reached while there was still change."""


def settle(events: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(ready, parked): ready has event_id and round, from 0; parked has event_id and missing, the needs that stay open,
    sorted. events: event_id, makes and needs, arrays of names, null for none. Events that need each other in a
    ring stay parked, as does all that needs them. An event that comes twice counts once, with the needs of all its rows."""
    flat = lambda c: F.explode(F.filter(c, lambda x: x.isNotNull()))
    every = checkpointed(events.filter("event_id IS NOT NULL").select("event_id", "makes", "needs"))
    makes = checkpointed(every.select("event_id", flat("makes").alias("name")).distinct())
    open_ = checkpointed(every.select("event_id", flat("needs").alias("name")).distinct())
    ready = checkpointed(every.select("event_id").distinct().join(open_, "event_id", "left_anti").withColumn("round", F.lit(0)))
    done, last, n = ready, ready, 0
    while not last.isEmpty():
        n += 1
        if n > most_rounds:
            raise NotSettled(f"not settled after {most_rounds} rounds")
        made = makes.join(last.select("event_id"), "event_id").select("name").distinct()
        # a need that is met goes; an event of which none is left is ready
        left = checkpointed(open_.join(made, "name", "left_anti"))
        last = checkpointed(open_.select("event_id").distinct().join(left, "event_id", "left_anti").withColumn("round", F.lit(n)))
        done, open_ = done.unionByName(last), left
        if n % 16 == 0:
            done = checkpointed(done)
    return done, open_.groupBy("event_id").agg(F.array_sort(F.collect_set("name")).alias("missing"))
