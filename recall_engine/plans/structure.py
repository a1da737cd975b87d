"""Queries over the folded tables: lookups, joins, roll-ups, integrity, durability, import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.functions import text as tx
from recall_engine.functions import values as vx
from recall_engine.operators import checks, events, fold, ingest, lookups, rollups, vectors
from recall_engine.sources.model import MODEL, Model, now, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(with_tables("topics links", "SELECT topic_id, name, count(DISTINCT message_id) AS messages FROM topics LEFT JOIN (SELECT * FROM links WHERE NOT removed) USING (topic_id) GROUP BY 1, 2"))
def topic_list(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return rollups.topic_list(m.topics(), m.links())


@query(
    with_tables(
        "topics links turns",
        """SELECT section, key, n, row_number() OVER (PARTITION BY section ORDER BY n DESC, key) AS place FROM (
SELECT 'topic' AS section, name AS key, count(DISTINCT message_id) AS n FROM topics LEFT JOIN (SELECT * FROM links WHERE NOT removed) USING (topic_id) GROUP BY 1, 2
UNION ALL SELECT 'thread', reply_to::VARCHAR, n FROM (SELECT reply_to, count(*) AS n FROM turns WHERE reply_to IS NOT NULL GROUP BY 1 ORDER BY n DESC, reply_to LIMIT 20))""",
    )
)
def nav_map(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return rollups.nav_map(m.topics(), m.links(), m.turns()).withColumn("place", F.col("place").cast("long"))


@query(with_tables("messages links pins", "SELECT e AS events, l AS live, round(e / l, 2) AS ratio FROM (SELECT (SELECT count(*) FROM events) AS e, (SELECT count(*) FROM messages WHERE NOT retracted) + (SELECT count(*) FROM links WHERE NOT removed) + (SELECT count(*) FROM pins WHERE NOT removed) AS l)"))
def compaction_stats(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return rollups.compaction(events=m.raw("events"), messages=m.messages(), links=m.links(), pins=m.pins())


@query(with_tables("messages revisions links pins", "SELECT 'messages' AS metric, count(*) AS n FROM messages UNION ALL SELECT 'revisions', count(*) FROM revisions UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'pins', count(*) FROM pins"))
def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return rollups.snapshot_counts(messages=m.messages(), revisions=m.revisions(), links=m.links(), pins=m.pins())


@query(with_tables("messages revisions", "SELECT m.message_id, m.head_revision_id, sha256(coalesce(r.text, '')) AS body_hash, length(r.text) AS body_len FROM messages m JOIN revisions r ON r.revision_id = head_revision_id"))
def message_info(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    revs = m.revisions().select("revision_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("body_hash"), F.char_length("text").cast("long").alias("body_len"))
    return lookups.message_info(m.messages().select("message_id", "head_revision_id"), revs)


@query(with_tables("revisions", "SELECT message_id, max(revision_id) AS head_revision_id, count(*) AS revisions FROM revisions GROUP BY 1"))
def head_revision(spark: SparkSession, d: str) -> DataFrame:
    r = Model(spark, d).revisions()
    return r.groupBy("message_id").agg(F.max_by("revision_id", F.struct("created_at", "revision_id")).alias("head_revision_id"), F.count(F.lit(1)).alias("revisions"))


@query(
    """WITH adds AS (SELECT event_id AS link_id, user_id AS message_id FROM events WHERE event_type = 'click'), removes AS (SELECT event_id + 1 AS link_id FROM events WHERE event_type = 'error')
SELECT link_id, message_id, link_id IN (SELECT link_id FROM removes) AS removed FROM adds"""
)
def orset_links(spark: SparkSession, d: str) -> DataFrame:
    e = Model(spark, d).raw("events")
    adds = e.filter("event_type = 'click'").selectExpr("event_id AS link_id", "user_id AS message_id")
    return fold.or_set(adds, e.filter("event_type = 'error'").selectExpr("event_id + 1 AS link_id"), "link_id")


@query(with_tables("messages links", "SELECT message_id, list_sort(list(topic_id)) AS topics FROM links WHERE NOT removed GROUP BY 1"))
def visible_links(spark: SparkSession, d: str) -> DataFrame:
    return lookups.visible_topics(Model(spark, d).links())


@query(with_tables("pins", "SELECT object_hash, count(*) AS pins FROM pins WHERE NOT removed GROUP BY 1"))
def active_pins(spark: SparkSession, d: str) -> DataFrame:
    return lookups.active_pins(Model(spark, d).pins())


@query(with_tables("messages topics links", "SELECT m.message_id, sender, thread_id, coalesce(t, []) AS topics FROM messages m LEFT JOIN (SELECT message_id, list_sort(list(DISTINCT name)) AS t FROM links JOIN topics USING (topic_id) WHERE NOT removed GROUP BY 1) USING (message_id)"))
def result_meta(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lookups.result_meta(m.messages(), m.links(), m.topics())


@query(
    with_tables(
        "messages revisions signals attachments pins",
        """SELECT m.message_id, m.event_id, m.head_revision_id, r.created_at, m.priority, EXISTS (SELECT 1 FROM pins p WHERE NOT p.removed AND p.object_hash = m.message_id) AS pinned,
EXISTS (SELECT 1 FROM signals s WHERE s.message_id = m.message_id AND kind = 'purchase') AS confirmed, EXISTS (SELECT 1 FROM attachments a WHERE a.message_id = m.message_id) AS has_attachment
FROM messages m JOIN revisions r ON r.revision_id = m.head_revision_id""",
    )
)
def rank_rows(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    revs = m.revisions().withColumn("body_hash", F.col("message_id"))
    signals = m.signals().withColumn("kind", F.when(F.col("kind") == "purchase", "priority_confirm").otherwise(F.col("kind")))
    return lookups.rank_rows(m.messages().drop("pinned", "confirmed", "created_at"), revs, m.pins(), signals, m.attachments())


@query(with_tables("attachments messages pins", "SELECT a.object_hash, a.message_id, text_class FROM attachments a JOIN messages m USING (message_id) WHERE NOT EXISTS (SELECT 1 FROM pins p WHERE p.object_hash = a.object_hash AND NOT removed)"))
def object_refs(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lookups.object_refs(m.attachments(), m.messages(), m.pins())


@query(with_tables("attachments messages pins", "SELECT object_hash FROM (SELECT object_hash, text_class FROM attachments JOIN messages USING (message_id) UNION ALL SELECT object_hash, 'pinned' FROM pins WHERE NOT removed) GROUP BY 1 HAVING bool_and(text_class = 'ephemeral')"))
def ephemeral_only(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lookups.ephemeral_only(m.attachments().join(m.messages(), "message_id"), m.pins())


@query(with_tables("attachments messages", "SELECT object_hash FROM attachments JOIN messages USING (message_id) GROUP BY 1 HAVING bool_and(text_class = 'ephemeral' AND created_at < TIMESTAMP '2024-01-25')"))
def ttl_expired(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return rollups.ttl_expired(m.attachments().join(m.messages(), "message_id"), now())


@query(with_tables("attachments derivatives", "SELECT DISTINCT object_hash FROM attachments a WHERE NOT EXISTS (SELECT 1 FROM derivatives v WHERE v.object_hash = a.object_hash AND NOT invalidated AND derivative_type = 'text')"))
def needs_derivative(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lookups.needs_derivative(m.attachments(), m.derivatives(), "text")


@query(with_tables("messages attachments derivatives", "SELECT derivative_id, object_hash, status FROM derivatives WHERE object_hash IN (SELECT object_hash FROM attachments WHERE message_id IN (SELECT message_id FROM messages))"))
def derivatives_for_messages(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lookups.derivatives_for(m.derivatives(), m.attachments(), m.messages()).select("derivative_id", "object_hash", "status")


@query(with_tables("revisions vectors", "SELECT revision_id, message_id, created_at FROM revisions WHERE revision_id NOT IN (SELECT revision_id FROM vectors)"))
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return vectors.pending_embeddings(m.revisions(), m.vectors(), MODEL)


@query(with_tables("messages vectors", "SELECT m.message_id, round(list_sum(v.vector::DOUBLE[]), 6) AS total FROM messages m JOIN vectors v ON v.revision_id = m.head_revision_id WHERE NOT retracted"))
def head_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return vectors.head_vectors(m.vectors(), m.messages(), MODEL).select("message_id", F.round(total, 6).alias("total"))


_CHAIN = "SELECT DISTINCT l_orderkey AS device_id, l_linenumber::BIGINT AS sequence, l_partkey::VARCHAR AS event_id, CASE WHEN l_linenumber > 1 THEN coalesce((SELECT min(p.l_partkey)::VARCHAR FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber - 1 AND l.l_returnflag <> 'R'), 'x') ELSE '' END AS previous_event_id FROM lineitem l"


def _chain(m: Model) -> DataFrame:
    """Lines of an order as a chain of events; returned ones name a wrong event before them."""
    lines = m.raw("lineitem")
    before = lines.groupBy("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber")).agg(F.min("l_partkey").cast("string").alias("_p"))
    named = F.when(F.col("l_linenumber") > 1, F.coalesce(F.when(F.col("l_returnflag") != "R", F.col("_p")), F.lit("x"))).otherwise("")
    return lines.join(before, ["l_orderkey", "l_linenumber"], "left").select(F.col("l_orderkey").alias("device_id"), F.col("l_linenumber").cast("long").alias("sequence"), F.col("l_partkey").cast("string").alias("event_id"), named.alias("previous_event_id")).distinct()


@query(f"""WITH e AS ({_CHAIN}), j AS (SELECT e.*, EXISTS (SELECT 1 FROM e p WHERE p.device_id = e.device_id AND p.sequence = e.sequence - 1) AS has, EXISTS (SELECT 1 FROM e p WHERE p.device_id = e.device_id AND p.sequence = e.sequence - 1 AND p.event_id = e.previous_event_id) AS good FROM e)
SELECT device_id, sequence, event_id, CASE WHEN has THEN 'previous' ELSE 'gap' END AS defect FROM j WHERE sequence > 1 AND NOT good""")
def chain_walk(spark: SparkSession, d: str) -> DataFrame:
    return events.walk(_chain(Model(spark, d)), ("device_id",), ids=False)


@query(f"""WITH e AS ({_CHAIN}), b AS (SELECT device_id, min(sequence) AS bad FROM e WHERE sequence > 1 AND NOT EXISTS (SELECT 1 FROM e p WHERE p.device_id = e.device_id AND p.sequence = e.sequence - 1 AND p.event_id = e.previous_event_id) GROUP BY 1)
SELECT device_id, sequence, event_id FROM e LEFT JOIN b USING (device_id) WHERE bad IS NULL OR sequence < bad""")
def verified_walk(spark: SparkSession, d: str) -> DataFrame:
    return events.verified(_chain(Model(spark, d)), ("device_id",), ids=False).select("device_id", "sequence", "event_id")


@query("SELECT l_orderkey AS device_id, count(*) AS events, min(l_linenumber)::BIGINT AS first, max(l_linenumber)::BIGINT AS last, arg_max(l_partkey, (l_linenumber, l_partkey)) AS head FROM lineitem GROUP BY 1")
def origin_list(spark: SparkSession, d: str) -> DataFrame:
    e = Model(spark, d).raw("lineitem").selectExpr("l_orderkey AS device_id", "l_linenumber AS sequence", "l_partkey AS event_id")
    return events.origins(e, ("device_id",))


@query(with_tables("attachments", "SELECT object_hash, message_id, durability FROM attachments"))
def attachment_objects(spark: SparkSession, d: str) -> DataFrame:
    return lookups.attachment_objects(Model(spark, d).attachments())


@query(with_tables("messages links", "SELECT message_id FROM messages m WHERE NOT retracted AND EXISTS (SELECT 1 FROM links l WHERE l.message_id = m.message_id AND NOT l.removed AND l.topic_id IN ('de', 'fr'))"))
def messages_in_topics(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lookups.messages_in_topics(m.messages(), m.links(), ["de", "fr"]).select("message_id")


@query(with_tables("topics", "SELECT a.name, topic_id FROM (SELECT name FROM topics UNION ALL SELECT 'lang/none') a LEFT JOIN topics USING (name)"))
def topic_ids(spark: SparkSession, d: str) -> DataFrame:
    t = Model(spark, d).topics()
    return lookups.topic_ids(t, t.select("name").union(spark.sql("SELECT 'lang/none'")))


@query("SELECT event_id AS interaction_id, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'found' ELSE 'workaround' END END AS outcome FROM events")
def record_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of all clicks, told after them."""
    e = Model(spark, d).raw("events").select(F.col("event_id").alias("interaction_id"), "event_type", F.lit(None).cast("string").alias("outcome"))
    given = e.filter("event_type = 'click'").selectExpr("interaction_id", "CASE WHEN interaction_id % 2 = 0 THEN 'found' ELSE 'workaround' END AS outcome", "interaction_id AS outcome_message_id", "timestamp'2024-02-01' AS outcome_at")
    return lookups.record_outcomes(e, given)[0].select("interaction_id", "outcome")


@query(with_tables("messages links", "SELECT l.topic_id AS topic_id, sender, arg_max(m.message_id, (created_at, m.message_id)) AS message_id FROM links l JOIN messages m USING (message_id) WHERE NOT removed AND NOT retracted GROUP BY ALL"))
def latest_topic_message(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lookups.latest_in_topic(m.messages().drop("topic_id"), m.links())


@query(with_tables("interactions", "SELECT interaction_id, task_id, kind, created_at FROM interactions ORDER BY created_at DESC, interaction_id DESC LIMIT 50"))
def interactions_list(spark: SparkSession, d: str) -> DataFrame:
    return lookups.interactions_list(Model(spark, d).interactions()).select("interaction_id", "task_id", "kind", F.col("created_at"))


@query("WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT * FROM (SELECT l_orderkey, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0)::BIGINT AS last, l_linenumber::BIGINT AS next FROM s) WHERE next <> last + 1")
def chain_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rollups.chain_gaps(Model(spark, d).raw("lineitem"), ["l_orderkey"], "l_linenumber")


_FRONTIER = "SELECT l_orderkey, coalesce(max(l_linenumber) FILTER (l_linenumber = rn), 0)::BIGINT AS frontier FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem{})) GROUP BY 1"


@query(_FRONTIER.format(""))
def frontier(spark: SparkSession, d: str) -> DataFrame:
    return rollups.frontier(Model(spark, d).raw("lineitem"), ["l_orderkey"], "l_linenumber")


@query(f"WITH t AS ({_FRONTIER.format('')}), o AS ({_FRONTIER.format(' WHERE l_returnflag <> $$N$$')}) SELECT l_orderkey, coalesce(o.frontier, 0) + 1 AS \"from\", t.frontier + 1 AS \"to\" FROM t LEFT JOIN o USING (l_orderkey) WHERE t.frontier > coalesce(o.frontier, 0)")
def frontier_diff(spark: SparkSession, d: str) -> DataFrame:
    lines = Model(spark, d).raw("lineitem")
    at = lambda t: rollups.frontier(t, ["l_orderkey"], "l_linenumber")
    return rollups.frontier_diff(at(lines.filter("l_returnflag <> 'N'")), at(lines), ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS claims FROM lineitem GROUP BY 1, 2 HAVING claims > 1")
def fork_detect(spark: SparkSession, d: str) -> DataFrame:
    return rollups.forks(Model(spark, d).raw("lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS e FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS e FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, min(l_linenumber)::BIGINT AS l_linenumber FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.e <> b.e GROUP BY 1")
def fork_points(spark: SparkSession, d: str) -> DataFrame:
    lines = Model(spark, d).raw("lineitem").groupBy("l_orderkey", "l_linenumber")
    return rollups.fork_points(lines.agg(F.min("l_partkey").alias("event_id")), lines.agg(F.max("l_partkey").alias("event_id")), ["l_orderkey"], "l_linenumber")


@query("SELECT l_orderkey, coalesce(c, 0)::BIGINT AS checkpoint, coalesce(h, 0)::BIGINT AS head, (coalesce(h, 0) - coalesce(c, 0))::BIGINT AS behind FROM (SELECT l_orderkey, max(l_linenumber) AS c FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) FULL JOIN (SELECT l_orderkey, max(l_linenumber) AS h FROM lineitem GROUP BY 1) USING (l_orderkey) WHERE behind <> 0")
def drift(spark: SparkSession, d: str) -> DataFrame:
    lines = Model(spark, d).raw("lineitem")
    a = lines.filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("checkpoint"))
    return rollups.drift(a, lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("head")), ["l_orderkey"])


@query("SELECT user_id, (event_id // 100)::BIGINT AS segment, min(event_id + 1)::BIGINT AS first, max(event_id + 1)::BIGINT AS last, count(*) AS n, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS root FROM events GROUP BY 1, 2")
def segment_seals(spark: SparkSession, d: str) -> DataFrame:
    e = Model(spark, d).raw("events").withColumn("seq", F.col("event_id") + 1)
    return rollups.segment_seals(e, 100, ["user_id"], "seq", F.col("event_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderkey >= 0")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    """All that one origin (orders of one status) has, from its first sequence to its last."""
    o = Model(spark, d).raw("orders").withColumn("sequence", F.col("o_orderkey"))
    return lookups.events_in_range(o, F.col("o_orderstatus") == "O", 0, 1 << 62).select("o_orderkey", "o_totalprice")


_DUR = """SELECT object_hash, durability, t AS target, coalesce(h, 0) AS holders, coalesce(h, 0) >= t AS ok
FROM (SELECT object_hash, arg_max(durability, (t, durability)) AS durability, max(t) AS t FROM (SELECT *, CASE WHEN durability = 'ephemeral' THEN 1 WHEN durability IN ('important', 'pinned') THEN 4 ELSE 2 END AS t FROM attachments) GROUP BY 1) LEFT JOIN (SELECT object_hash, count(DISTINCT holder) AS h FROM holders GROUP BY 1) USING (object_hash)"""


@query(with_tables("attachments holders", _DUR))
def durability_status(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return rollups.durability_status(m.attachments(), m.holders(), 4)


@query(with_tables("attachments holders", "SELECT DISTINCT message_id FROM attachments WHERE object_hash IN (SELECT object_hash FROM dur WHERE NOT ok)", dur=_DUR))
def pending_objects(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return rollups.pending_objects(rollups.durability_status(m.attachments(), m.holders(), 4), m.attachments())


@query("SELECT greatest(1, count(*) FILTER (s_acctbal > 0 AND s_suppkey % 5 <> 0))::BIGINT AS members FROM supplier")
def member_count(spark: SparkSession, d: str) -> DataFrame:
    s = Model(spark, d).raw("supplier").selectExpr("s_acctbal <= 0 AS revoked", "s_suppkey % 5 = 0 AS thin")
    return rollups.member_count(s)


@query("WITH w AS (SELECT DISTINCT page_id % 300 AS object_hash FROM pages) SELECT object_hash FROM w WHERE object_hash NOT IN (SELECT page_id FROM pages WHERE page_id % 4 <> 0)")
def blob_reconcile(spark: SparkSession, d: str) -> DataFrame:
    p = Model(spark, d).raw("pages")
    return rollups.missing_objects(p.selectExpr("page_id % 300 AS object_hash"), p.filter("page_id % 4 <> 0").selectExpr("page_id AS object_hash"))


@query(
    """WITH RECURSIVE b AS (SELECT source, created, doc_id, n_chars, row_number() OVER (PARTITION BY source, created ORDER BY doc_id) AS rn FROM (SELECT *, doc_id % 5 AS created FROM documents)),
f AS (SELECT source, created, rn, doc_id, n_chars, n_chars <= 8000 AS admitted, CASE WHEN n_chars <= 8000 THEN n_chars ELSE 0 END AS used FROM b WHERE rn = 1
UNION ALL SELECT b.source, b.created, b.rn, b.doc_id, b.n_chars, used + b.n_chars <= 8000, CASE WHEN used + b.n_chars <= 8000 THEN used + b.n_chars ELSE used END FROM f JOIN b ON b.source = f.source AND b.created = f.created AND b.rn = f.rn + 1)
SELECT source, created, doc_id, n_chars, admitted FROM f"""
)
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    t = Model(spark, d).raw("documents").withColumn("created", F.col("doc_id") % 5)
    return rollups.daily_quota(t, 8000, ["source", "created"], ["doc_id"], "n_chars")


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'publish' WHEN doc_id % 6 = 1 THEN 'revise' ELSE 'skip' END AS action FROM documents) GROUP BY 1")
def ingest_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = Model(spark, d).raw("documents")
    files = docs.select(F.concat(F.lit("notes/"), "doc_id", F.lit(".md")).alias("path"), "text")
    refs = docs.filter("doc_id % 4 <> 0").select(F.concat(F.lit("notes/"), "doc_id", F.lit(".md")).alias("path"), F.col("doc_id").alias("message_id"), F.when(F.col("doc_id") % 6 == 1, "old").otherwise(F.sha2(F.col("text"), 256)).alias("body_hash"))
    return ingest.report(ingest.classify(ingest.plan(files), refs))


_LINKED = "SELECT doc_id, coalesce(text, '') || ' see [[Note ' || (doc_id % 7) || ']] and [[ note ' || (doc_id % 7) || '|this]] or [[Other#part]] [[]] [[a[b]]' AS text FROM documents"


@query(
    f"""SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS links FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\\[\\[([^\\[\\]|]+)(\\|[^\\[\\]]*)?\\]\\]', 1),
  lambda x: lower(replace(trim(x), ' ', '-'))) AS l FROM ({_LINKED}))"""
)
def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    """Links in whole texts; the test texts have none of their own, so each gets some by rule."""
    t = Model(spark, d).raw("documents").selectExpr("doc_id", "concat(coalesce(text, ''), ' see [[Note ', doc_id % 7, ']] and [[ note ', doc_id % 7, '|this]] or [[Other#part]] [[]] [[a[b]]') AS text")
    return t.select("doc_id", tx.wiki_links(F.col("text")).alias("links"))


@query("SELECT page_id, ['my-repo', 'my-repo/a', 'my-repo/a/b' || (page_id % 3)] AS topics, regexp_replace('A B' || page_id, '[^a-z0-9/_-]', '_', 'g') AS clean FROM pages")
def path_topics(spark: SparkSession, d: str) -> DataFrame:
    p = Model(spark, d).raw("pages")
    path = F.concat(F.lit("a/b"), (F.col("page_id") % 3).cast("string"), F.lit("/c.md"))
    return p.select("page_id", tx.proposed_topics(F.lit("My Repo"), path).alias("topics"), tx.sanitize(F.concat(F.lit("A B"), F.col("page_id").cast("string"))).alias("clean"))


@query("SELECT doc_id, rtrim(left(text, 200), chr(10)) AS snippet, length(text) AS chars, array_to_string((string_split(text, chr(10)))[1:3], chr(10)) AS lines, CASE WHEN text = '' THEN '' ELSE '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) END AS quoted FROM documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return Model(spark, d).raw("documents").select("doc_id", tx.snippet(t).alias("snippet"), tx.budget_chars(t).cast("long").alias("chars"), tx.first_lines(t).alias("lines"), tx.quote_lines(t).alias("quoted"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, round(greatest(0.0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9), 6) AS age, round(1 - pow(2, -value / 3.0), 6) AS saturated, CASE WHEN event_id % 50 = 0 THEN 7 WHEN event_id % 50 = 1 THEN 6 WHEN event_id % 50 = 2 THEN 5 WHEN value * 100 >= 20000 THEN 4 WHEN value * 100 >= 5000 THEN 3 WHEN value * 100 >= 1000 THEN 2 WHEN value * 100 >= 200 THEN 1 ELSE 0 END AS level FROM events")
def time_and_decay(spark: SparkSession, d: str) -> DataFrame:
    e = Model(spark, d).raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", vx.utc_day(F.col("ts")).alias("day"), F.round(vx.age_hours(F.col("ts"), now()), 6).alias("age"), F.round(vx.saturate(F.col("value"), 3.0), 6).alias("saturated"), vx.degradation(F.col("value") * 100, F.expr("CASE event_id % 50 WHEN 0 THEN 1L << 20 WHEN 1 THEN 1L << 28 WHEN 2 THEN 1L << 30 ELSE 1L << 40 END")).alias("level"))


_STATE = "CASE WHEN NOT (message_id % 50 = 3 OR text_class = 'ephemeral' AND message_id % 2 = 1) THEN 'delivered' WHEN text_class = 'ephemeral' AND created_at < TIMESTAMP '2024-01-25' THEN 'expired' ELSE 'not_delivered' END"


@query(with_tables("messages revisions", f"SELECT message_id, state, CASE WHEN state = 'delivered' THEN sha256(text) END AS body_sha256 FROM (SELECT m.message_id, {_STATE.replace('message_id', 'm.message_id').replace('created_at', 'm.created_at')} AS state, r.text FROM messages m JOIN revisions r ON r.revision_id = m.head_revision_id) UNION ALL SELECT -5, 'not_found', NULL"))
def fetch_states(spark: SparkSession, d: str) -> DataFrame:
    """Every message asked for, with the body that is delivered."""
    from recall_engine.operators import retrieve

    m = Model(spark, d)
    heads = m.revisions().join(m.messages().select("head_revision_id", "text_class"), F.col("revision_id") == F.col("head_revision_id"))
    held = heads.filter("NOT (message_id % 50 = 3 OR (text_class = 'ephemeral' AND message_id % 2 = 1))").selectExpr("message_id AS object_hash", "text AS data")
    revs = m.revisions().withColumn("body_hash", F.col("message_id"))
    wanted = m.messages().select("message_id").union(spark.sql("SELECT -5L"))
    return retrieve.fetch(m.messages(), revs, held, wanted, now()).select("message_id", "state", F.when(F.col("state") == "delivered", F.sha2("body", 256)).alias("body_sha256"))


@query("SELECT severity, \"check\", count(*) AS n FROM (SELECT 'problem' AS severity, 'gap' AS \"check\" FROM (SELECT l_linenumber, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS last FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE l_linenumber <> last + 1 UNION ALL SELECT 'problem', 'fork' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1) UNION ALL SELECT 'problem', 'drift' FROM (SELECT l_orderkey, max(l_linenumber) AS h, max(l_linenumber) FILTER (l_linestatus = 'O') AS c FROM lineitem GROUP BY 1) WHERE coalesce(h, 0) <> coalesce(c, 0)) GROUP BY ALL")
def doctor(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what the checks of a log find, over line items as events of orders."""
    lines = Model(spark, d).raw("lineitem")
    events = lines.selectExpr("CAST(l_orderkey AS STRING) AS device_id", "1 AS generation", "l_linenumber AS sequence", "CAST(l_partkey AS STRING) AS event_id", "'x' AS wall_time")
    done = lines.filter("l_linestatus = 'O'").selectExpr("CAST(l_orderkey AS STRING) AS device_id", "1 AS generation", "l_linenumber AS s").groupBy("device_id", "generation").agg(F.max("s").alias("checkpoint"))
    none = events.selectExpr("event_id", "true AS retryable", "'' AS reason").filter(F.lit(False))
    objects = events.selectExpr("event_id AS object_hash").filter(F.lit(False))
    found = checks.doctor(events, {"checkpoint": done, "parked_events": none, "attachments": objects}, objects, now())
    return found.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("n"))
