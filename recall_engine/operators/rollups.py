"""Structural roll-ups: topics, navigation, compaction, objects, integrity of origins, durability, quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.params import PARAMS

#: Holders that the class normal, and any class that isn't known, asks for.
NORMAL_HOLDERS = 2
#: Sequences of an origin that one task looks at together.
BLOCK = 4096


def topic_list(topics: DataFrame, links: DataFrame) -> DataFrame:
    """(topic_id, name, messages): distinct messages with a live link, retracted ones included; topics without any too."""
    live = links.filter(~F.col("removed")).select("topic_id", "message_id")
    return topics.join(live, "topic_id", "left").groupBy("topic_id", "name").agg(F.count_distinct("message_id").alias("messages")).orderBy("name")


def nav_map(topics: DataFrame, links: DataFrame, messages: DataFrame, top: int = PARAMS.map_top) -> DataFrame:
    """(section, key, n, place): topics by number of messages, and the parents with most direct replies."""
    counted = topic_list(topics, links).select(F.lit("topic").alias("section"), F.col("name").alias("key"), F.col("messages").alias("n"))
    parents = messages.filter(F.col("reply_to").isNotNull()).groupBy("reply_to").agg(F.count(F.lit(1)).alias("n"))
    busiest = parents.orderBy(F.desc("n"), "reply_to").limit(top).select(F.lit("thread").alias("section"), F.col("reply_to").cast("string").alias("key"), "n")
    order = Window.partitionBy("section").orderBy(F.desc("n"), "key")
    return counted.unionByName(busiest).withColumn("place", F.row_number().over(order))


def compaction(**tables: DataFrame) -> DataFrame:
    """(events, live, ratio): events for each live entity, 0 where there is none. events: all events; the other
    tables' rows are live unless removed or retracted."""
    live = None
    for name, t in tables.items():
        if name == "events":
            continue
        gone = next((c for c in ("removed", "retracted", "invalidated") if c in t.columns), None)
        one = (t.filter(~F.col(gone)) if gone else t).agg(F.count(F.lit(1)).alias("live"))
        live = one if live is None else live.unionByName(one)
    total = live.agg(F.sum("live").cast("long").alias("live"))
    return tables["events"].agg(F.count(F.lit(1)).alias("events")).crossJoin(total).withColumn("ratio", F.when(F.col("live") == 0, F.lit(0.0)).otherwise(F.round(F.col("events") / F.col("live"), 2)))


def snapshot_counts(**tables: DataFrame) -> DataFrame:
    """(metric, n) of several tables at once, in one job."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def ttl_expired(refs: DataFrame, now: Column, hours: float = PARAMS.ttl_ephemeral) -> DataFrame:
    """object_hashes all of whose references are ephemeral and older than the time to live."""
    old = (F.unix_micros(now) - F.unix_micros("created_at")) / F.lit(3.6e9) > hours
    return refs.groupBy("object_hash").agg(F.bool_and((F.col("text_class") == "ephemeral") & old).alias("_gone")).filter("_gone").select("object_hash")


def chain_gaps(events: DataFrame, origin: list[str], sequence: str, first: int = 1) -> DataFrame:
    """Places where an origin's chain isn't contiguous: the last sequence before (first - 1 for none) and the next one after.

    An origin is looked at in blocks of sequences, which go to different tasks; what ends a block is carried to the next one that
    has any, and of an origin only its blocks come together.
    """
    seen = events.select(*origin, F.col(sequence).cast("long").alias("next")).distinct().withColumn("_b", F.floor(F.col("next") / BLOCK))
    own = F.lag("next").over(Window.partitionBy(*origin, "_b").orderBy("next"))
    ends = seen.groupBy(*origin, "_b").agg(F.max("next").alias("_end"))
    ends = ends.withColumn("_last", F.coalesce(F.lag("_end").over(Window.partitionBy(*origin).orderBy("_b")), F.lit(first - 1))).select(*[F.col(c).alias(f"_{c}") for c in origin], F.col("_b").alias("_of"), "_last")
    on = F.col("_b").eqNullSafe(F.col("_of"))
    for c in origin:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = seen.withColumn("_own", own)
    inside = placed.filter(F.col("_own").isNotNull() & (F.col("next") != F.col("_own") + 1)).select(*origin, F.col("_own").alias("last"), "next")
    between = placed.filter(F.col("_own").isNull()).join(ends, on).filter(F.col("next") != F.col("_last") + 1).select(*origin, F.col("_last").alias("last"), "next")
    return inside.unionByName(between).select(*origin, F.col("last").cast("long").alias("last"), "next")


def frontier(events: DataFrame, origin: list[str], sequence: str, first: int = 1) -> DataFrame:
    """(origin, frontier): the last sequence that is reached without a gap; first - 1 where the first is missing."""
    ends = events.groupBy(*origin).agg(F.max(F.col(sequence).cast("long")).alias("_end"))
    gaps = chain_gaps(events, origin, sequence, first).groupBy(*[F.col(c).alias(f"_{c}") for c in origin]).agg(F.min("last").alias("_last"))
    on = F.lit(True)
    for c in origin:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ends.join(gaps, on, "left").select(*origin, F.coalesce("_last", "_end", F.lit(first - 1)).cast("long").alias("frontier"))


def frontier_diff(ours: DataFrame, theirs: DataFrame, origin: list[str]) -> DataFrame:
    """(origin, from, to): half-open ranges that the other side has and we lack."""
    both = theirs.select(*origin, F.col("frontier").alias("_t")).join(ours.select(*origin, F.col("frontier").alias("_o")), origin, "left")
    have = F.coalesce("_o", F.lit(0))
    return both.filter(F.col("_t") > have).select(*origin, (have + 1).cast("long").alias("from"), (F.col("_t") + 1).cast("long").alias("to"))


def forks(events: DataFrame, coordinate: list[str], identity: Column) -> DataFrame:
    """Coordinates that more than one event claims, with how many."""
    return events.select(*coordinate, identity.alias("_id")).groupBy(*coordinate).agg(F.count_distinct("_id").alias("claims")).filter("claims > 1")


def fork_points(ours: DataFrame, theirs: DataFrame, origin: list[str], sequence: str) -> DataFrame:
    """(origin, sequence): the first place at which two logs of one origin differ. Both have event_id."""
    joined = ours.select(*origin, sequence, F.col("event_id").alias("_a")).join(theirs.select(*origin, sequence, F.col("event_id").alias("_b")), [*origin, sequence])
    return joined.filter(F.col("_a") != F.col("_b")).groupBy(*origin).agg(F.min(sequence).cast("long").alias(sequence))


def drift(checkpoints: DataFrame, heads: DataFrame, origin: list[str]) -> DataFrame:
    """(origin, checkpoint, head, behind) where the folded tables and the log differ."""
    both = checkpoints.join(heads, origin, "full_outer")
    c, h = F.coalesce("checkpoint", F.lit(0)), F.coalesce("head", F.lit(0))
    return both.select(*origin, c.cast("long").alias("checkpoint"), h.cast("long").alias("head"), (h - c).cast("long").alias("behind")).filter("behind <> 0")


def segment_seals(events: DataFrame, per_segment: int, origin: list[str], sequence: str, identity: Column) -> DataFrame:
    """(origin, segment, first, last, n, root): the header of each sealed segment; root hashes its ids in order."""
    placed = events.withColumn("segment", F.floor((F.col(sequence) - 1) / per_segment).cast("long"))
    ids = F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("s"), identity.cast("string").alias("e"))))
    sealed = placed.groupBy(*origin, "segment").agg(F.min(sequence).cast("long").alias("first"), F.max(sequence).cast("long").alias("last"), F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(ids, lambda x: x["e"]), ","), 256).alias("root"))
    return sealed


def durability_status(attachments: DataFrame, holders: DataFrame, members: int) -> DataFrame:
    """(object_hash, durability, target, holders, ok): the strongest class asked for and who holds a copy. One holder is
    enough for ephemeral objects, all members hold important and pinned ones, two hold all others."""
    target = F.when(F.col("durability") == "ephemeral", 1).when(F.col("durability").isin("important", "pinned"), max(1, members)).otherwise(NORMAL_HOLDERS)
    asked = attachments.withColumn("_t", target).groupBy("object_hash").agg(F.max_by("durability", F.struct("_t", "durability")).alias("durability"), F.max("_t").alias("target"))
    have = holders.groupBy("object_hash").agg(F.count_distinct("holder").alias("holders"))
    out = asked.join(have, "object_hash", "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
    return out.withColumn("ok", F.col("holders") >= F.col("target"))


def pending_objects(status: DataFrame, attachments: DataFrame) -> DataFrame:
    """message_ids that attach an object held by too few."""
    return attachments.join(status.filter("NOT ok").select("object_hash"), "object_hash", "left_semi").select("message_id").distinct()


def member_count(devices: DataFrame) -> DataFrame:
    """(members): devices that count for durability, one at least."""
    return devices.agg(F.greatest(F.lit(1), F.count_if(~F.col("revoked") & ~F.col("thin"))).cast("long").alias("members"))


def missing_objects(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Objects that are referred to and not held."""
    return wanted.select("object_hash").distinct().join(held.select("object_hash"), "object_hash", "left_anti")


def daily_quota(bodies: DataFrame, limit: int, key: list[str], order: list[str], size: str = "body_len") -> DataFrame:
    """The bodies with admitted: in order, a body goes in if it still fits the day's quota; one that doesn't takes nothing
    of it, and one of no known size is neither. key: the group and day. The bodies of a day pass one by one, and what is kept
    of them is how much is used up."""
    rows = bodies.select(*key, *order, F.col(size).cast("long").alias(size)).repartition(*key).sortWithinPartitions(*key, *order, size)
    n_key, schema = len(key), T.StructType([*rows.schema.fields, T.StructField("admitted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, used = None, 0
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(n_key)), strict=True) if n_key else iter([()] * b.num_rows)
            admitted = []
            for own, n in zip(keys, b.column(b.num_columns - 1).to_pylist(), strict=True):
                if own != day:
                    day, used = own, 0
                fits = None if n is None else used + n <= limit
                used += n if fits else 0
                admitted.append(fits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(admitted, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)
