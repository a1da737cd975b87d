"""Queries of the write side: edited exports, imports and extractions that become events, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.functions.text import normalise_newlines
from recall_engine.operators import events, extraction, fold, ingest
from recall_engine.sources.files import checkpointed
from recall_engine.sources.model import Model

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Origins that the events of a query are dealt to.
WRITERS = 64
_NO_HEADS = "device_id string, generation int, sequence bigint, event_id string"


def _built(spark: SparkSession, requests: dict[str, DataFrame]) -> DataFrame:
    return checkpointed(events.build(requests, spark.createDataFrame([], _NO_HEADS), "writer", 1, F.lit("2024-01-01 00:00:00"), WRITERS))


@query(
    """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 5 >= 3 THEN 'rejected' WHEN doc_id % 5 = 0 THEN 'unchanged' WHEN doc_id % 3 <> 0 THEN 'revised'
  WHEN doc_id % 5 = 1 AND coalesce(text, '') <> '' THEN 'merged' ELSE 'conflict' END AS outcome FROM documents)
SELECT doc_id AS message_id, outcome, CASE outcome WHEN 'revised' THEN 1 WHEN 'merged' THEN 2 ELSE 0 END AS revisions FROM o"""
)
def edit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Edited exports of all documents: a third of the heads moved on meanwhile, some edits say what the head says, some add a line before
    or after the text, some state another hash, some are of retracted messages."""
    k, doc = F.col("doc_id") % 5, F.col("doc_id")
    docs = Model(spark, d).raw("documents").select("doc_id", normalise_newlines(F.coalesce("text", F.lit(""))).alias("text"))
    moved = F.concat("text", F.lit("\nadded at the end"))
    base, head = F.concat(F.lit("r"), "doc_id", F.lit("-0")), F.when(doc % 3 == 0, F.concat(F.lit("r"), "doc_id", F.lit("-1"))).otherwise(F.concat(F.lit("r"), "doc_id", F.lit("-0")))
    messages = docs.select(doc.alias("message_id"), head.alias("head_revision_id"), (k == 4).alias("retracted"))
    revisions = docs.select(base.alias("revision_id"), doc.alias("message_id"), F.col("text").alias("body")).unionByName(docs.filter("doc_id % 3 = 0").select(head.alias("revision_id"), doc.alias("message_id"), moved.alias("body")))
    body = F.when(k == 0, F.when(doc % 3 == 0, moved).otherwise(F.col("text"))).when(k == 1, F.concat(F.lit("edited\n"), "text")).otherwise(F.concat("text", F.lit("\nanother end")))
    edited = docs.select(doc.alias("message_id"), base.alias("base_revision_id"), F.when(k == 3, "x").otherwise(F.sha2("text", 256)).alias("body_hash"), body.alias("body"))
    taken = ingest.take_edits(edited, messages, revisions)
    return taken.select("message_id", "outcome", F.coalesce(F.array_size("revisions"), F.lit(0)).alias("revisions"))


@query(
    """WITH p AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'publish' WHEN doc_id % 6 = 1 THEN 'revise' END AS action FROM documents)
SELECT 'message.publish' AS event_type, count(*) AS n FROM p WHERE action = 'publish' HAVING n > 0 UNION ALL SELECT 'message.revise_body', count(*) FROM p WHERE action = 'revise' HAVING count(*) > 0
UNION ALL SELECT 'topic.create', count(DISTINCT source) FROM p WHERE action = 'publish' HAVING count(*) > 0 UNION ALL SELECT 'topic.link.add', 2 * count(*) FROM p WHERE action = 'publish' HAVING count(*) > 0"""
)
def ingest_applied(spark: SparkSession, d: str) -> DataFrame:
    """The events that carry out an import: files of all documents in folders by source, of which a quarter is new, and some have changed."""
    docs = Model(spark, d).raw("documents")
    path = F.concat(F.col("source"), F.lit("/"), "doc_id", F.lit(".md")).alias("path")
    planned = checkpointed(ingest.plan(docs.select(path, normalise_newlines(F.coalesce("text", F.lit(""))).alias("text"))))
    refs = docs.filter("doc_id % 4 <> 0").select(path, F.concat(F.lit("m"), "doc_id").alias("message_id"), "doc_id").join(planned.select("path", F.col("body_hash").alias("_h")), "path")
    refs = refs.select("path", "message_id", F.when(F.col("doc_id") % 6 == 1, "old").otherwise(F.col("_h")).alias("body_hash"))
    topics = spark.createDataFrame([("t0", "notes")], "topic_id string, name string")
    log = _built(spark, ingest.ingest_requests(planned, ingest.classify(planned, refs), topics))
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM pages) GROUP BY 1")
def extraction_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """All pages as attached objects, every seventh of a kind that has no extractor: what the folded events of an extraction run say; a
    second run finds nothing to do, so it adds nothing."""
    pages = Model(spark, d).raw("pages")
    objects = pages.select(F.concat(F.lit("o"), "page_id").alias("object_hash"), F.when(F.col("page_id") % 7 == 0, "%PDF-1.4").otherwise(F.col("html")).cast("binary").alias("data"))
    attached = objects.select("object_hash")
    none = spark.createDataFrame([], "object_hash string, status string, invalidated boolean")
    log = _built(spark, extraction.extraction_requests(extraction.work_queue(attached, none, objects)))
    first = fold.derivatives(log)
    again = extraction.extract_all(extraction.work_queue(attached, first, objects)).select(F.lit("again").alias("status"))
    return first.select("status").unionByName(again).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
