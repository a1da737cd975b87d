"""Point and set lookups over the folded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def message_info(messages: DataFrame, revisions: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Messages with their head revision; ids: a table of the message_ids wanted."""
    wanted = messages if ids is None else messages.join(ids.select("message_id"), "message_id", "left_semi")
    return wanted.join(revisions.select(F.col("revision_id").alias("head_revision_id"), "body_hash", "body_len"), "head_revision_id")


def live_links(links: DataFrame) -> DataFrame:
    return links.filter(~F.col("removed"))


def visible_topics(links: DataFrame) -> DataFrame:
    """(message_id, topics): live links' topics in order."""
    return live_links(links).groupBy("message_id").agg(F.array_sort(F.collect_list("topic_id")).alias("topics"))


def active_pins(pins: DataFrame, principal: str | None = None) -> DataFrame:
    live = pins.filter(~F.col("removed"))
    return (live if principal is None else live.filter(F.col("principal") == principal)).groupBy("object_hash").agg(F.count(F.lit(1)).alias("pins"))


def events_by_correlation(events: DataFrame, correlation: Column) -> DataFrame:
    return events.filter(F.col("correlation_id") == correlation).orderBy("device_id", "generation", "sequence")


def event_at(events: DataFrame, device: str, generation: int, sequence: int) -> DataFrame:
    return events.filter((F.col("device_id") == device) & (F.col("generation") == generation) & (F.col("sequence") == sequence)).select("event_id")


def events_in_range(events: DataFrame, origin: Column, low: int, high: int) -> DataFrame:
    """Events of an origin with low <= sequence < high, in order."""
    return events.filter(origin & (F.col("sequence") >= low) & (F.col("sequence") < high)).orderBy("sequence")


def scope_messages(messages: DataFrame, links: DataFrame, topics: list | None = None, sender=None, thread=None) -> DataFrame:
    """message_ids in scope: live links to any of the topics, the sender, the thread (its root is not in it)."""
    found = messages
    if topics:
        wanted = live_links(links).filter(F.col("topic_id").isin(topics))
        found = found.join(wanted.select("message_id"), "message_id", "left_semi")
    if sender is not None:
        found = found.filter(F.col("sender") == sender)
    if thread is not None:
        found = found.filter(F.col("thread_id") == thread)
    return found.select("message_id")


def messages_in_topics(messages: DataFrame, links: DataFrame, topics: list) -> DataFrame:
    """Messages, not retracted, with a live link to any of the topics; all of them for no topics."""
    shown = messages.filter(~F.col("retracted"))
    return shown if not topics else shown.join(live_links(links).filter(F.col("topic_id").isin(topics)).select("message_id"), "message_id", "left_semi")


def object_refs(attachments: DataFrame, messages: DataFrame, pins: DataFrame) -> DataFrame:
    """(object_hash, message_id, text_class) of attachments that no active pin holds."""
    held = pins.filter(~F.col("removed")).select("object_hash")
    return attachments.join(held, "object_hash", "left_anti").join(messages.select("message_id", "text_class"), "message_id").select("object_hash", "message_id", "text_class")


def ephemeral_only(refs: DataFrame, pins: DataFrame) -> DataFrame:
    """object_hashes that are known, and by ephemeral references alone. refs: object_hash, text_class."""
    pinned = pins.filter(~F.col("removed")).select("object_hash", F.lit("pinned").alias("text_class"))
    every = refs.select("object_hash", "text_class").unionByName(pinned)
    return every.groupBy("object_hash").agg(F.bool_and(F.col("text_class") == "ephemeral").alias("_only")).filter("_only").select("object_hash")


def needs_derivative(attachments: DataFrame, derivatives: DataFrame, kind: str) -> DataFrame:
    """Attached objects without a derivative of this kind that still counts."""
    done = derivatives.filter(~F.col("invalidated") & (F.col("derivative_type") == kind)).select("object_hash")
    return attachments.select("object_hash").distinct().join(done, "object_hash", "left_anti").orderBy("object_hash")


def derivatives_for(derivatives: DataFrame, attachments: DataFrame, ids: DataFrame) -> DataFrame:
    """Derivatives of what these messages attach."""
    wanted = attachments.join(ids.select("message_id"), "message_id", "left_semi").select("object_hash")
    return derivatives.join(wanted, "object_hash", "left_semi")


def latest_in_topic(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(topic_id, sender, message_id): the newest message of each sender in each topic, ties to the larger id."""
    linked = live_links(links).select("message_id", "topic_id").distinct().join(messages.filter(~F.col("retracted")), "message_id")
    return linked.groupBy("topic_id", "sender").agg(F.max_by("message_id", F.struct("created_at", "message_id")).alias("message_id"))


def result_meta(messages: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """(message_id, sender, thread_id, topics): names of the live topics in order, none as an empty array."""
    named = live_links(links).join(topics.select("topic_id", "name"), "topic_id").groupBy("message_id").agg(F.array_sort(F.collect_set("name")).alias("topics"))
    return messages.select("message_id", "sender", "thread_id").join(named, "message_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def rank_rows(messages: DataFrame, revisions: DataFrame, pins: DataFrame, signals: DataFrame, attachments: DataFrame) -> DataFrame:
    """What ranking needs of each message: head revision's time, priority, pinned, confirmed, has_attachment."""
    heads = messages.join(revisions.select(F.col("revision_id").alias("head_revision_id"), F.col("created_at").alias("head_at"), "body_hash"), "head_revision_id")
    flag = lambda df, name: df.select("message_id").distinct().withColumn(name, F.lit(True))
    live = pins.filter(~F.col("removed")).select("object_hash").distinct()
    pinned = heads.join(live, heads["body_hash"] == live["object_hash"], "left_semi")
    out = heads.join(flag(pinned, "pinned"), "message_id", "left").join(flag(signals.filter(F.col("kind") == "priority_confirm"), "confirmed"), "message_id", "left").join(flag(attachments, "has_attachment"), "message_id", "left")
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("message_id", "event_id", "head_revision_id", F.col("head_at").alias("created_at"), "priority", false("pinned"), false("confirmed"), false("has_attachment"))


def interactions_list(interactions: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """The newest interactions, after the first ``offset`` ones."""
    return interactions.orderBy(F.desc("created_at"), F.desc("interaction_id")).offset(offset).limit(limit)


def record_outcomes(interactions: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interactions with their outcomes, outcomes of interactions that aren't there). given: interaction_id, outcome (found,
    not_found or workaround), outcome_message_id, outcome_at; of several for one interaction the last counts."""
    last = given.groupBy("interaction_id").agg(F.max_by(F.struct("outcome", "outcome_message_id", "outcome_at"), F.struct("outcome_at", "outcome", "outcome_message_id")).alias("_o"))
    known = F.col("_o.outcome").isin("found", "not_found", "workaround")
    own = [c for c in interactions.columns if c not in ("outcome", "outcome_message_id", "outcome_at")]
    held = interactions.join(last.filter(known), "interaction_id", "left")
    at = lambda c: F.coalesce(F.col(f"_o.{c}"), F.col(c)) if c in interactions.columns else F.col(f"_o.{c}")
    # an outcome takes all of its three fields along, nulls included
    new = [F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(c) if c in interactions.columns else F.lit(None)).alias(c) if c != "outcome" else at(c).alias(c) for c in ("outcome", "outcome_message_id", "outcome_at")]
    lost = given.join(interactions.select("interaction_id"), "interaction_id", "left_anti")
    return held.select(*own, *new), lost


def topic_ids(topics: DataFrame, names: DataFrame) -> DataFrame:
    """(name, topic_id) of the names asked for; null where there is no such topic."""
    return names.select("name").join(topics.select("name", "topic_id"), "name", "left")


def topic_names(topics: DataFrame, ids: DataFrame) -> DataFrame:
    """(topic_id, name) of the ids asked for; null where there is no such topic."""
    return ids.select("topic_id").join(topics.select("topic_id", "name"), "topic_id", "left")


def source_messages(source_refs: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, message_id): the message that a file was last published as; null for a file that never was."""
    return paths.select("path").join(source_refs.select("path", "message_id"), "path", "left")


def derivative_by_id(derivatives: DataFrame, ids: DataFrame) -> DataFrame:
    """The derivatives asked for, invalidated ones included."""
    return derivatives.join(ids.select("derivative_id"), "derivative_id", "left_semi")


def attachment_objects(attachments: DataFrame) -> DataFrame:
    """(object_hash, message_id, durability): each pair of an object and a message, in order; the stronger class of an
    object that several messages share is left to the caller."""
    return attachments.select("object_hash", "message_id", "durability").orderBy("object_hash", "message_id", "durability")


def subscriptions_list(subscriptions: DataFrame, owner: str | None = None, active_only: bool = False) -> DataFrame:
    """Subscriptions in order of their ids, of one owner or of all; active_only leaves disabled ones out."""
    found = subscriptions if owner is None else subscriptions.filter(F.col("owner") == owner)
    return (found.filter(~F.col("disabled")) if active_only else found).orderBy("subscription_id")


def outcomes(interactions: DataFrame, kind: str = "found") -> DataFrame:
    return interactions.filter(F.col("outcome") == kind)


def parked_events(parked: DataFrame) -> DataFrame:
    return parked.withColumn("origin", F.concat_ws("/", "device_id", F.col("generation").cast("string"))).orderBy("origin", "sequence", "event_id")


def summaries_to_check(summaries: DataFrame) -> DataFrame:
    return summaries.filter(~F.col("checked"))


def disputed_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.filter(F.col("checked") & ~F.col("agrees"))


def thread(messages: DataFrame, root) -> DataFrame:
    """A thread in the order of time, its root first among equals."""
    member = (F.col("message_id") == root) | (F.col("thread_id") == root)
    order = Window.orderBy("created_at", "message_id")
    return messages.filter(member).withColumn("final_rank", F.row_number().over(order))
