"""The fold of an event log into tables, as pure transformations of the whole log.

Order is the order of origins: device, generation, sequence; wall time never decides. An event that refers to what
the log doesn't hold is parked as retryable; one that can never fold is parked for good. Removals take effect
wherever they stand in the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions.text import topic_name_ok
from recall_engine.schemas import PAYLOADS

ORDER = ("device_id", "generation", "sequence")


def ordered(c: str = "") -> Column:
    return F.struct(*[F.col(f"{c}{x}") for x in ORDER])


class Decoded:
    """A log whose events are known to be accepted and whose payloads are stored decoded, one table a kind."""

    def __init__(self, events: DataFrame, kinds: dict[str, DataFrame]) -> None:
        self.events, self.kinds = events, kinds

    def groupBy(self, *by):
        return self.events.groupBy(*by)


class Raw:
    """A log as it came, of which the accepted events count. Which they are is told from ids and coordinates alone, and a kind's events are
    decoded where they lie, so what travels of an event is what a table asks of it, not its payload."""

    def __init__(self, events: DataFrame) -> None:
        self.raw = events
        self.events = accepted(events)
        once = events.select(F.struct("event_id").alias("_k"), F.struct(*ORDER, "event_type").alias("_c")).groupBy("_k").agg(F.min("_c").alias("_c"))
        first = once.groupBy(*[F.col(f"_c.{x}").alias(x) for x in ORDER]).agg(F.min(F.struct("_k", "_c")).alias("_m"))
        self.counted = first.select(F.col("_m._k").alias("_k"), F.col("_m._c").alias("_c"))

    def groupBy(self, *by):
        return self.events.groupBy(*by)

    def kind(self, kind: str, more: dict[str, Column]) -> DataFrame:
        """Ids are held as structs, which are equal where both ids are null."""
        own = _fields(self.raw.filter(F.col("event_type") == kind), kind, F.struct("event_id").alias("_k"), F.struct(*ORDER, "event_type").alias("_own")).withColumns(more)
        return own.join(self.counted, "_k").filter(F.col("_own") == F.col("_c")).dropDuplicates(["_k"]).drop("_k", "_own", "_c")


Log = DataFrame | Decoded | Raw


def accepted(events: Log) -> Log:
    """Each event once, and of each coordinate the first event id."""
    if not isinstance(events, DataFrame):
        return events
    once = events.dropDuplicates(["event_id"])
    w = Window.partitionBy(*ORDER).orderBy("event_id")
    return once.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _fields(own: DataFrame, kind: str, *more: Column) -> DataFrame:
    return own.withColumn("_p", F.from_json("payload", PAYLOADS[kind])).withColumn("_at", ordered()).select("event_id", "actor", "task_id", F.col("wall_time").cast("timestamp").alias("created_at"), "_at", *more, "_p.*")


def decoded(events: Log, kind: str, **more: Column) -> DataFrame:
    """Events of one kind with their payload's fields; what can't be read has nulls. more: columns made of these fields where the event
    lies, so that what is asked of a list can travel without the list."""
    if isinstance(events, Raw):
        return events.kind(kind, more)
    own = events.kinds[kind] if isinstance(events, Decoded) else _fields(events.filter(F.col("event_type") == kind), kind)
    return own.withColumns(more)


def first_by(df: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("_at")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_by(df: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("_at"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def published(events: Log) -> DataFrame:
    """The first publication of each message. Those that have a message id are the rows of messages, without heads, which need all revisions."""
    return first_by(decoded(events, "message.publish"), "message_id")


def messages_and_revisions(events: Log) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, revisions, revision_parents). The head is the last revision of the last revise event. Heads and parents are told from
    names alone; bodies travel for revisions only."""
    first = published(events)
    names = F.transform("revisions", lambda r: F.struct(r["revision_id"].alias("revision_id"), r["parents"].alias("parents")))
    revised = decoded(events, "message.revise_body", _names=names).join(first.select("message_id"), "message_id", "left_semi")
    own = first.select("message_id", "created_at", "_at", F.lit(-1).alias("_i"), "revision_id", F.array().cast("array<string>").alias("parents"), "body_hash", "body", "body_len")

    def every(listed: str, *cols: str) -> DataFrame:
        each = revised.select("message_id", "created_at", "_at", F.posexplode(listed).alias("_i", "_r")).select("message_id", "created_at", "_at", "_i", "_r.*")
        return own.select(*cols).unionByName(each.select(*cols))

    gone = decoded(events, "message.retract").groupBy("message_id").agg(F.min_by("event_id", "_at").alias("retract_event_id"))
    named = every("_names", "message_id", "_at", "_i", "revision_id", "parents")
    heads = named.groupBy("message_id").agg(F.max_by("revision_id", F.struct("_at", "_i")).alias("head_revision_id"))
    messages = (
        first.join(heads, "message_id")
        .join(gone, "message_id", "left")
        .select("message_id", "event_id", F.col("actor").alias("sender"), "task_id", "created_at", "declared_priority", "text_class", "thread_id", "reply_to", "head_revision_id", F.col("retract_event_id").isNotNull().alias("retracted"), "retract_event_id")
    )
    parents = named.select("revision_id", F.posexplode("parents").alias("ord", "parent_revision_id"))
    return messages, every("revisions", "revision_id", "message_id", "created_at", "body_hash", "body", "body_len"), parents


def recipients(events: Log) -> DataFrame:
    return published(events).select("message_id", F.explode("recipients").alias("view")).distinct()


def attachments(events: Log) -> DataFrame:
    """One row for each message and object; no durability counts as normal."""
    each = published(events).select("message_id", F.posexplode("attachments").alias("_i", "_a")).select("message_id", "_i", "_a.*")
    w = Window.partitionBy("message_id", "object_hash").orderBy("_i")
    return each.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("message_id", "object_hash", "byte_len", "mime", "filename", F.coalesce("durability", F.lit("normal")).alias("durability"))


def source_refs(events: Log) -> DataFrame:
    """(path, message_id): the last event of a path wins."""
    return last_by(decoded(events, "message.publish").filter(F.col("source_path").isNotNull()), "source_path").select(F.col("source_path").alias("path"), "message_id", "body_hash")


def topics(events: Log) -> tuple[DataFrame, DataFrame]:
    """(topics, parked creations): names must be valid; the first creation of a name or id wins."""
    made = decoded(events, "topic.create").withColumn("_ok", topic_name_ok(F.col("name")))
    by_name, by_id = Window.partitionBy("name").orderBy("_at"), Window.partitionBy("topic_id").orderBy("_at")
    placed = made.withColumn("_n", F.row_number().over(by_name)).withColumn("_i", F.row_number().over(by_id)).withColumn("_in", F.col("_ok") & (F.col("_n") == 1) & (F.col("_i") == 1))
    return placed.filter("_in").select("topic_id", "name", "event_id"), placed.filter("NOT _in").select("event_id", F.lit(False).alias("retryable"), F.lit("topic name").alias("reason"))


def topic_links(events: Log, messages: DataFrame, topics_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with removed, parked additions). Only listed links go; a protected one goes only by the operator."""
    added = first_by(decoded(events, "topic.link.add"), "link_id")
    held = added.join(messages.select("message_id"), "message_id", "left_semi").join(topics_.select("topic_id"), "topic_id", "left_semi")
    parked = added.join(held.select("link_id"), "link_id", "left_anti").select("event_id", F.lit(True).alias("retryable"), F.lit("missing message or topic").alias("reason"))
    removals = decoded(events, "topic.link.remove").select("actor", F.explode("removed_link_ids").alias("link_id")).groupBy("link_id").agg(F.bool_or(F.col("actor") == "operator").alias("_by_operator"))
    out = held.join(removals, "link_id", "left").withColumn("removed", F.col("_by_operator").isNotNull() & (F.col("_by_operator") | ~F.coalesce("protected", F.lit(False))))
    return out.select("link_id", "message_id", "topic_id", F.coalesce("protected", F.lit(False)).alias("protected"), "removed"), parked


def or_set(adds: DataFrame, removes: DataFrame, key: str) -> DataFrame:
    """Assertions with removed: true for those that a removal lists."""
    gone = removes.select(key).distinct().withColumn("_gone", F.lit(True))
    return adds.join(gone, key, "left").withColumn("removed", F.coalesce("_gone", F.lit(False))).drop("_gone")


def pins(events: Log) -> DataFrame:
    added = first_by(decoded(events, "blob.pin"), "pin_id").select("pin_id", "principal", "object_hash")
    return or_set(added, decoded(events, "blob.unpin").select(F.explode("pin_ids").alias("pin_id")), "pin_id")


def signals(events: Log) -> DataFrame:
    """Signals never park; they may name messages that aren't there."""
    return decoded(events, "signal.emit").select("event_id", "message_id", F.col("actor").alias("principal"), "kind", "weight", "created_at")


def derivatives(events: Log) -> DataFrame:
    """(derivative_id, object_hash, derivative_type, status, text, invalidated): the last publication or failure counts."""
    ok = decoded(events, "derivative.publish").select("derivative_id", "blob_hash", "derivative_type", "_at", F.lit("ok").alias("status"), "text")
    bad = decoded(events, "derivative.fail").select("derivative_id", "blob_hash", "derivative_type", "_at", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("text"))
    out = last_by(ok.unionByName(bad), "derivative_id").withColumnRenamed("blob_hash", "object_hash").drop("_at")
    gone = decoded(events, "derivative.invalidate").select("derivative_id").distinct().withColumn("_gone", F.lit(True))
    return out.join(gone, "derivative_id", "left").withColumn("invalidated", F.coalesce("_gone", F.lit(False))).drop("_gone")


FIELDS = ("query", "topics", "mode", "top_n", "window_hours", "percentile", "cap_per_day")


def subscriptions(events: Log) -> tuple[DataFrame, DataFrame]:
    """(subscriptions, parked updates): a fold in order over each subscription's own events.

    create gives revision 1; update must name the current revision and changes the fields it has; disable counts as a
    revision; delete ends it. An update of another revision, or of none, is parked for good.
    """
    common = lambda df, op: df.select("subscription_id", "event_id", "_at", F.lit(op).alias("op"), *[(F.col(c) if c in df.columns else F.lit(None).cast(_type(c))).alias(c) for c in ("owner", "base_revision", *FIELDS)])
    every = common(decoded(events, "subscription.create"), "create")
    for op in ("update", "disable", "delete"):
        every = every.unionByName(common(decoded(events, f"subscription.{op}"), op))
    steps = F.array_sort(F.collect_list(F.struct("_at", "event_id", "op", "owner", "base_revision", *FIELDS)))
    empty = F.struct(F.lit(0).alias("revision"), F.lit(False).alias("exists"), F.lit(False).alias("disabled"), F.lit(None).cast("string").alias("owner"), *[F.lit(None).cast(_type(c)).alias(c) for c in FIELDS], F.array().cast("array<string>").alias("parked"))

    def step(a: Column, x: Column) -> Column:
        creates = (x["op"] == "create") & ~a["exists"]
        updates = (x["op"] == "update") & a["exists"] & x["base_revision"].eqNullSafe(a["revision"])
        disables = (x["op"] == "disable") & a["exists"]
        deletes = (x["op"] == "delete") & a["exists"]
        parks = ~(creates | updates | disables | deletes) & x["op"].isin("create", "update")
        return F.struct(
            F.when(creates, 1).when(updates | disables, a["revision"] + 1).otherwise(a["revision"]).alias("revision"),
            F.when(creates, True).when(deletes, False).otherwise(a["exists"]).alias("exists"),
            F.when(creates, False).when(disables, True).otherwise(a["disabled"]).alias("disabled"),
            F.when(creates, x["owner"]).otherwise(a["owner"]).alias("owner"),
            *[F.when(creates, x[c]).when(updates, F.coalesce(x[c], a[c])).otherwise(a[c]).alias(c) for c in FIELDS],
            F.when(parks, F.concat(a["parked"], F.array(x["event_id"]))).otherwise(a["parked"]).alias("parked"),
        )

    folded = every.groupBy("subscription_id").agg(F.aggregate(steps, empty, step).alias("_s")).select("subscription_id", "_s.*")
    parked = folded.select(F.explode("parked").alias("event_id"), F.lit(False).alias("retryable"), F.lit("subscription revision").alias("reason"))
    return folded.filter("exists").drop("exists", "parked"), parked


def _type(c: str) -> str:
    return {"topics": "array<string>", "query": "string", "mode": "string", "owner": "string"}.get(c, "int")


def parked(events: Log, messages: DataFrame, *others: DataFrame) -> DataFrame:
    """(event_id, retryable, reason): revisions of messages that aren't there, and what the other folds parked."""
    lost = decoded(events, "message.revise_body").join(messages.select("message_id"), "message_id", "left_anti").select("event_id", F.lit(True).alias("retryable"), F.lit("missing message").alias("reason"))
    double = decoded(events, "message.publish").join(messages.select("message_id", F.col("event_id").alias("_first")), "message_id").filter(F.col("event_id") != F.col("_first")).select("event_id", F.lit(False).alias("retryable"), F.lit("message exists").alias("reason"))
    out = lost.unionByName(double)
    for o in others:
        out = out.unionByName(o)
    return out


def checkpoints(events: Log) -> DataFrame:
    """(origin, checkpoint): the last sequence folded."""
    return events.groupBy("device_id", "generation").agg(F.max("sequence").alias("checkpoint"))


def index_texts(revisions: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """(revision_id, text, lexical_indexed): the inline body, or that of the object store; missing ones are marked."""
    if objects is None:
        return revisions.select("revision_id", F.col("body").alias("text"), F.col("body").isNotNull().alias("lexical_indexed"))
    found = revisions.join(objects.select(F.col("object_hash").alias("body_hash"), F.col("data").cast("string").alias("_d")), "body_hash", "left")
    text = F.coalesce("body", "_d")
    return found.select("revision_id", text.alias("text"), text.isNotNull().alias("lexical_indexed"))


def project(events: Log, objects: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a log."""
    log = Raw(events) if isinstance(events, DataFrame) else events
    messages, revisions, parents = messages_and_revisions(log)
    made, bad_topics = topics(log)
    there = published(log).select("message_id", "event_id")
    links, bad_links = topic_links(log, there, made)
    subs, bad_subs = subscriptions(log)
    return {
        "events": log.events,
        "messages": messages,
        "revisions": revisions,
        "revision_parents": parents,
        "recipients": recipients(log),
        "attachments": attachments(log),
        "source_refs": source_refs(log),
        "topics": made,
        "topic_links": links,
        "pins": pins(log),
        "signals": signals(log),
        "derivatives": derivatives(log),
        "subscriptions": subs,
        "parked_events": parked(log, there, bad_topics, bad_links, bad_subs),
        "checkpoint": checkpoints(log),
        "index": index_texts(revisions, objects),
    }
