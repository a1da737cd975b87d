"""Schemas of the event envelope, the payloads and local tables, as DDL, which readers and from_json take."""

from __future__ import annotations

ENVELOPE = (
    "schema_version int, event_id string, event_type string, device_id string, generation int, sequence bigint, previous_event_id string, "
    "actor string, task_id string, object_type string, object_id string, causation_id string, correlation_id string, parent_ids array<string>, "
    "wall_time string, payload string"
)

PAYLOADS = {
    "message.publish": (
        "message_id string, revision_id string, body_hash string, body string, body_len bigint, text_class string, declared_priority int, "
        "thread_id string, reply_to string, recipients array<string>, summary string, "
        "attachments array<struct<object_hash:string,byte_len:bigint,mime:string,filename:string,durability:string>>, source_path string"
    ),
    "message.revise_body": ("message_id string, revisions array<struct<revision_id:string,parents:array<string>,body_hash:string,body:string,body_len:bigint>>"),
    "message.retract": ("message_id string"),
    "topic.create": ("topic_id string, name string"),
    "topic.link.add": ("link_id string, message_id string, topic_id string, protected boolean"),
    "topic.link.remove": ("removed_link_ids array<string>"),
    "blob.pin": ("pin_id string, principal string, object_hash string"),
    "blob.unpin": ("pin_ids array<string>"),
    "signal.emit": ("message_id string, kind string, weight int"),
    "derivative.publish": ("derivative_id string, blob_hash string, derivative_type string, text string, extractor string"),
    "derivative.fail": ("derivative_id string, blob_hash string, derivative_type string, error string"),
    "derivative.invalidate": ("derivative_id string"),
    "subscription.create": (
        "subscription_id string, owner string, query string, topics array<string>, mode string, top_n int, window_hours int, percentile int, cap_per_day int"
    ),
    "subscription.update": (
        "subscription_id string, base_revision int, query string, topics array<string>, mode string, top_n int, window_hours int, percentile int, cap_per_day int"
    ),
    "subscription.disable": ("subscription_id string"),
    "subscription.delete": ("subscription_id string"),
}

INTERACTIONS = (
    "interaction_id string, kind string, task_id string, surface string, inferred boolean, query string, budget bigint, payload_chars bigint, "
    "result_count bigint, mode string, principal string, created_at timestamp, outcome string, outcome_message_id string, outcome_at timestamp"
)
IMPRESSIONS = ("interaction_id string, message_id string, position int")
LATENCIES = ("kind string, micros bigint, created_at timestamp")
CORPUS_ITEMS = ("id string, title string, body string, topics array<string>, created_at string, url string")
CORPUS_QUERIES = ("id string, query string, relevant array<string>, label_kind string, split string")
