"""The write side: events built from tables of requests, the chain of each origin, and stored tables with their version."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.operators.chain import identified, with_own_id
from recall_engine.schemas import PAYLOADS

#: The version of the folded tables; stored tables of another version must be folded anew.
TABLES_VERSION = 1
ORIGIN = ("device_id", "generation")


class SchemaVersionError(ValueError):
    """Stored tables have another version than this code."""


def payload(kind: str, df: DataFrame) -> Column:
    """The JSON payload of one kind of event, from those columns that its schema has; absent and null ones are left out."""
    names = [f.name for f in T.StructType.fromDDL(PAYLOADS[kind]).fields if f.name in df.columns]
    return F.to_json(F.struct(*names)) if names else F.lit("{}")


def build(requests: dict[str, DataFrame], heads: DataFrame, device: str, generation: int, wall: Column, writers: int = 1) -> DataFrame:
    """Events of one origin, to be appended: publish, revise, retract, link, unlink, pin, unpin, signal and all other kinds.

    requests: for each kind a table with the columns of its payload, actor, task_id (may be absent) and at, the order of
    the requests. They follow the origin's head (device_id, generation, sequence, event_id; none starts the log). Ids
    commit to the whole event and to the one before it, see ``chain``. Requests without an order come first; ties go by payload.
    An id follows from the one before, so one task makes those of an origin, one after the other. Many requests are therefore dealt to
    as many writers as asked, device-0, device-1 and so on, by what they say: each is an origin with its own chain and order.
    """
    every = None
    for kind, df in requests.items():
        task = F.col("task_id") if "task_id" in df.columns else F.lit(None).cast("string")
        one = df.select(F.lit(kind).alias("event_type"), F.col("actor"), task.alias("task_id"), F.col("at").cast("long").alias("_order"), payload(kind, df).alias("payload"))
        every = one if every is None else every.unionByName(one)
    if every is None:
        raise ValueError("no requests")
    origin = F.lit(device) if writers == 1 else F.concat(F.lit(f"{device}-"), F.pmod(F.xxhash64("event_type", "payload"), F.lit(writers)).cast("string"))
    head = heads.filter(F.col("generation") == generation).groupBy("device_id").agg(F.max("sequence").alias("_last"), F.max_by("event_id", "sequence").alias("_last_id"))
    head = head.join(F.broadcast(every.sparkSession.createDataFrame([(device if writers == 1 else f"{device}-{i}",) for i in range(writers)], "device_id string")), "device_id", "left_semi")
    # A writer's batch of requests has one order: this window holds its batch, not the log.
    w = Window.partitionBy("device_id", "generation").orderBy("_order", "event_type", "payload")
    placed = every.withColumns({"device_id": origin, "generation": F.lit(generation), "schema_version": F.lit(1), "wall_time": wall}).join(F.broadcast(head), "device_id", "left")
    placed = placed.withColumn("sequence", (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).cast("long"))
    last = head.select("device_id", F.lit(generation).alias("generation"), F.col("_last_id").alias("event_id"))
    made = identified(placed.select("schema_version", "event_type", "device_id", "generation", "sequence", "actor", "task_id", "wall_time", "payload"), last)
    return made.select("schema_version", "event_id", "event_type", "device_id", "generation", "sequence", "previous_event_id", "actor", "task_id", "wall_time", "payload")


def origins(events: DataFrame, origin: tuple[str, ...] = ORIGIN) -> DataFrame:
    """(origin, events, first, last, head): each origin that has written, with its last event's id."""
    return events.groupBy(*origin).agg(F.count(F.lit(1)).alias("events"), F.min("sequence").cast("long").alias("first"), F.max("sequence").cast("long").alias("last"), F.max_by("event_id", F.struct("sequence", "event_id")).alias("head"))


def _with_previous(events: DataFrame, known: DataFrame, origin: tuple[str, ...]) -> DataFrame:
    """Events with _p, the ids that stand one place before them in known; the chain is walked by a join, not in one task."""
    before = known.groupBy(*origin, (F.col("sequence") + 1).alias("sequence")).agg(F.collect_set("event_id").alias("_p"))
    return events.join(before, [*origin, "sequence"], "left")


def _with_sound(events: DataFrame, ids: bool) -> DataFrame:
    """Events with _sound: the id is the one that follows from what the event says. Without ids, that isn't asked."""
    if not ids:
        return events.withColumn("_sound", F.lit(True))
    return with_own_id(events, "_own").withColumn("_sound", F.col("_own").eqNullSafe(F.col("event_id"))).drop("_own")


def walk(events: DataFrame, origin: tuple[str, ...] = ORIGIN, ids: bool = True) -> DataFrame:
    """(origin, sequence, event_id, defect) where a chain is broken: gap (what comes before isn't there), previous (another event
    comes before than the one that is named), start (the first event names one) or id (the event doesn't say what its id
    commits to). Nothing for a sound log. Without ids, names alone are compared, for logs whose ids are just names."""
    named = F.coalesce("previous_event_id", F.lit(""))
    found = _with_previous(_with_sound(events, ids), events, origin)
    link = F.when(F.col("sequence") <= 1, F.when(named != "", "start")).when(F.col("_p").isNull(), "gap").when(~F.array_contains("_p", named), "previous")
    defect = F.coalesce(link, F.when(~F.col("_sound"), "id"))
    return found.withColumn("defect", defect).filter("defect IS NOT NULL").select(*origin, "sequence", "event_id", "defect")


def verified(events: DataFrame, origin: tuple[str, ...] = ORIGIN, ids: bool = True) -> DataFrame:
    """The events of each origin up to its first defect: what follows it can't be trusted."""
    first = walk(events, origin, ids).groupBy(*origin).agg(F.min("sequence").alias("_bad"))
    return events.join(first, list(origin), "left").filter(F.col("_bad").isNull() | (F.col("sequence") < F.col("_bad"))).drop("_bad")


def appendable(batch: DataFrame, heads: DataFrame, origin: tuple[str, ...] = ORIGIN, ids: bool = True) -> DataFrame:
    """The batch with ok: whether an event may be appended. It must have the next sequence of its origin, name the event
    before it, in the log's heads or in the batch, and have the id of what it says; nothing after one that may not be
    appended is ok."""
    known = batch.select(*origin, "sequence", "event_id").unionByName(heads.select(*origin, "sequence", "event_id"))
    last = heads.groupBy(*origin).agg(F.max("sequence").alias("_last"))
    named = F.coalesce("previous_event_id", F.lit(""))
    held = _with_previous(_with_sound(batch, ids), known, origin).join(last, list(origin), "left")
    starts = (F.col("sequence") == 1) & F.col("_last").isNull() & (named == "")
    follows = (F.col("sequence") > F.coalesce("_last", F.lit(0))) & F.coalesce(F.array_contains("_p", named), F.lit(False))
    held = held.withColumn("_good", (starts | follows) & F.col("_sound"))
    bad = held.groupBy(*origin).agg(F.min(F.when(~F.col("_good"), F.col("sequence"))).alias("_bad"))
    out = held.join(bad, list(origin), "left").withColumn("ok", F.col("_bad").isNull() | (F.col("sequence") < F.col("_bad")))
    return out.select(*batch.columns, "ok")


def write_tables(tables: dict[str, DataFrame], folder: str, version: int = TABLES_VERSION) -> None:
    """Folded tables as Parquet, each in its own folder, and last of all their version: a write that breaks off has none."""
    for name, df in tables.items():
        if not re.fullmatch(r"\w+", name) or name == "meta":
            raise ValueError(f"not a table name: {name!r}")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    meta = spark.createDataFrame([(version, sorted(tables))], "schema_version int, tables array<string>")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def read_tables(spark: SparkSession, folder: str, version: int = TABLES_VERSION) -> dict[str, DataFrame]:
    """Stored tables; those of another version are refused."""
    meta = spark.read.schema("schema_version int, tables array<string>").json(f"{folder}/meta").first()
    if meta is None or meta.schema_version != version:
        raise SchemaVersionError(f"found {meta and meta.schema_version}, want {version}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in meta.tables}
