"""Structured Streaming over the event log: idempotent append, day and trailing windows, frontiers, a buffer for events
whose dependency isn't there yet, and late bodies.

There is no event-time watermark for correctness: completeness is each origin's contiguous frontier, and the state
that a stream keeps is one row an origin, or one row an event that still waits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recall_engine.operators.corpora import lateness


def read_log(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """The log's files as a stream, so many at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def outbox(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Bundles dropped into a folder as JSON lines, with ok: whether a line is valid and has its id."""
    raw = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.withColumn("_p", F.from_json("value", schema)).select("path", "_p.*", F.col("_p.event_id").isNotNull().alias("ok"))


def append_once(stream: DataFrame, out: str, checkpoint: str):
    """Appends events to a log, each id once, also where a batch is run again: a batch has its own folder, which a rerun
    replaces, and events that other batches hold are left out."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["event_id"])
        try:
            known = spark.read.parquet(out).filter(F.col("batch") != n).select("event_id")
            new = new.join(known, "event_id", "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        new.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def day_counts(stream: DataFrame, at: str = "created_at", *by: str) -> DataFrame:
    """Events of each UTC day (a tumbling window), by further columns."""
    return stream.groupBy(F.window(F.col(at), "1 day").alias("_w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("_w.start", "yyyy-MM-dd").alias("day"), *by, "n")


def trailing_counts(stream: DataFrame, at: str, hours: int, step: int, *by: str) -> DataFrame:
    """Events in windows of so many hours, one beginning every step hours."""
    w = F.window(F.col(at), f"{hours} hours", f"{step} hours").alias("_w")
    return stream.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.end").alias("until"), *by, "n")


def frontiers(stream: DataFrame, origin: Column, sequence: str) -> DataFrame:
    """(origin, frontier, waiting): after each batch, the last sequence of an origin that is reached without a gap, and how
    many events beyond the gap have come."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ahead = state.get if state.exists else (0, "[]")
        held = set(json.loads(ahead))
        for b in batches:
            held.update(int(x) for x in b["sequence"] if x > last)
        while last + 1 in held:
            last += 1
            held.discard(last)
        state.update((last, json.dumps(sorted(held))))
        yield pd.DataFrame({"origin": [key[0]], "frontier": [last], "waiting": [len(held)]})

    rows = stream.select(origin.cast("string").alias("origin"), F.col(sequence).cast("long").alias("sequence"))
    return rows.groupBy("origin").applyInPandasWithState(advance, "origin string, frontier long, waiting long", "last long, ahead string", "update", GroupStateTimeout.NoTimeout)


def release_ready(stream: DataFrame) -> DataFrame:
    """(ref, event_id) of events as soon as what they refer to is there. stream: ref, event_id, makes (true for the event
    that makes ref). Events that come first wait in the state of their ref, and go out in order of their ids."""

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        there, waiting = state.get if state.exists else (False, "[]")
        held = json.loads(waiting)
        for b in batches:
            there = there or bool(b["makes"].any())
            held += [x for x, m in zip(b["event_id"], b["makes"], strict=True) if not m]
        out = sorted(set(held)) if there else []
        state.update((there, json.dumps([] if there else sorted(set(held)))))
        yield pd.DataFrame({"ref": [key[0]] * len(out), "event_id": out})

    return stream.select("ref", "event_id", "makes").groupBy("ref").applyInPandasWithState(settle, "ref string, event_id string", "there boolean, waiting string", "append", GroupStateTimeout.NoTimeout)


def keep_timely_bodies(stream: DataFrame) -> DataFrame:
    """Events with their bodies, but for ephemeral ones that come too late; the events stay."""
    return lateness(stream).withColumn("body", F.when(F.col("body_kept"), F.col("body"))).drop("body_kept")


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now, into a table in memory. For results whose size is bounded."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)
