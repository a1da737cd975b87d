"""The engine's tables as views over the driver's tables, with fixed formulas; the same in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
#: A few retrieval requests: words, and the vector of one message. The last two are answered within words and by attachments alone.
QUERIES = ((1, "the of and", 3), (2, "with that", 10), (3, "le la des", 20), (4, "der die", 7), (5, "license", 40), (6, "icens", 50), (7, "copy middot", 60))
VIEWS = ((1, "src1", "the of", 3, ("en",)), (2, "src2", None, None, ("de", "fr")), (3, "src7", "le la", 20, ("es",)))
MODEL = "unit64"


def now():
    return F.lit(NOW).cast("timestamp")


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than there are cores, dealt out evenly; any other as it is. Small files of one
    row group would else keep one core busy with all of their text."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Model:
    """Lazily derived tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(df) if name in ("documents", "pages") else df

    def messages(self) -> DataFrame:
        d = self.raw("documents")
        return d.selectExpr(
            "doc_id AS message_id", "doc_id AS event_id", "doc_id * 10 + 1 AS head_revision_id", "source AS sender", "CAST(NULL AS BIGINT) AS thread_id",
            "CAST(NULL AS BIGINT) AS reply_to", "timestampadd(HOUR, CAST(doc_id % 1000 AS INT), timestamp'2024-01-01') AS created_at", "CAST(doc_id % 4 AS INT) AS priority",
            "doc_id % 17 = 0 AS retracted", "doc_id % 23 = 0 AS pinned", "doc_id % 29 = 0 AS confirmed", "lang AS topic_id",
            "CASE WHEN doc_id % 13 = 0 THEN 'ephemeral' WHEN doc_id % 3 = 0 THEN 'canonical' ELSE 'eager-searchable' END AS text_class",
            "CASE WHEN doc_id % 31 = 0 THEN source END AS recipient", "n_chars AS body_len",
        )

    def revisions(self) -> DataFrame:
        """A head for each message, and for every fifth an older revision, the text with a word before it."""
        d = self.raw("documents")
        head = d.selectExpr("doc_id * 10 + 1 AS revision_id", "doc_id AS message_id", "text", "timestampadd(HOUR, CAST(doc_id % 1000 AS INT), timestamp'2024-01-01') AS created_at")
        old = d.filter("doc_id % 5 = 0").selectExpr("doc_id * 10 AS revision_id", "doc_id AS message_id", "concat('draft ', text) AS text", "timestamp'2024-01-01' AS created_at")
        return head.unionByName(old)

    def topics(self) -> DataFrame:
        return self.raw("documents").selectExpr("lang AS topic_id", "concat('lang/', lang) AS name").distinct()

    def links(self) -> DataFrame:
        return self.raw("documents").selectExpr("doc_id AS link_id", "doc_id AS message_id", "lang AS topic_id", "doc_id % 7 = 0 AS protected", "doc_id % 11 = 0 AND doc_id % 7 <> 0 AS removed")

    def turns(self) -> DataFrame:
        """Conversations as threads: each turn replies to the one before."""
        return self.raw("conversations").selectExpr(
            "conv_id * 1000 + turn AS message_id", "CASE WHEN turn > 0 THEN conv_id * 1000 END AS thread_id", "CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS reply_to",
            "role AS sender", "timestampadd(MINUTE, CAST(turn AS INT), timestamp'2024-01-01') AS created_at", "text",
        )

    def signals(self) -> DataFrame:
        n = self.raw("documents").agg(F.count(F.lit(1)).alias("n_docs"))
        return self.raw("events").crossJoin(F.broadcast(n)).selectExpr("user_id AS principal", "event_id % n_docs AS message_id", "event_type AS kind", "CAST(1 + event_id % 4 AS INT) AS weight", "CAST(ts AS TIMESTAMP) AS created_at")

    def interactions(self) -> DataFrame:
        """Every event is a retrieval; a purchase found something, an error didn't, a signup worked around."""
        n = self.raw("documents").agg(F.count(F.lit(1)).alias("n_docs"))
        k = F.get_json_object("props", "$.k").cast("long")
        e = self.raw("events").crossJoin(F.broadcast(n)).withColumn("k", k)
        return e.selectExpr(
            "event_id AS interaction_id", "CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('t', user_id) END AS task_id", "concat('p', user_id % 20) AS principal", "event_type AS kind",
            "k * 50 AS budget", "CAST(value * 10 AS BIGINT) AS payload_chars", "CAST(ts AS TIMESTAMP) AS created_at", "event_id % n_docs AS message_id", "CAST(1 + event_id % 12 AS INT) AS final_rank",
            "CASE event_type WHEN 'purchase' THEN 'found' WHEN 'error' THEN 'not_found' WHEN 'signup' THEN 'workaround' END AS outcome", "k",
        )

    def impressions(self) -> DataFrame:
        return self.interactions().filter("kind = 'view'").select("interaction_id", "message_id", "final_rank")

    def fetches(self) -> DataFrame:
        return self.interactions().filter("kind = 'purchase'").select("interaction_id", "message_id", "task_id", "principal")

    def vectors(self) -> DataFrame:
        """Every third vector is that of an older revision."""
        return self.raw("embeddings").select(F.col("vec_id").alias("message_id"), (F.col("vec_id") * 10 + F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1)).alias("revision_id"), F.lit(MODEL).alias("model_id"), F.col("embedding").alias("vector"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("topic_id"))

    def attachments(self) -> DataFrame:
        """Pages hang on messages; every third page is shared by the next message."""
        p = self.raw("pages")
        own = p.selectExpr("page_id AS message_id", "page_id AS object_hash", "CASE page_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'important' WHEN 2 THEN 'pinned' ELSE 'ephemeral' END AS durability")
        again = p.filter("page_id % 3 = 0").selectExpr("page_id + 1 AS message_id", "page_id AS object_hash", "'normal' AS durability")
        return own.unionByName(again)

    def pins(self) -> DataFrame:
        return self.raw("pages").filter("page_id % 6 = 0").selectExpr("page_id AS pin_id", "concat('p', page_id % 3) AS principal", "page_id AS object_hash", "page_id % 12 = 0 AS removed")

    def derivatives(self) -> DataFrame:
        return self.raw("pages").filter("page_id % 5 <> 0").selectExpr("page_id AS derivative_id", "page_id AS object_hash", "'text' AS derivative_type", "CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status", "page_id % 9 = 0 AS invalidated", "regexp_replace(html, '<[^>]*>', ' ') AS text")

    def holders(self) -> DataFrame:
        return self.raw("pages").selectExpr("page_id AS object_hash", "explode(sequence(1, CAST(1 + page_id % 4 AS INT))) AS holder")

    def queries(self) -> DataFrame:
        """query_id, query, model_id, vector of each request."""
        q = self.spark.sql(f"SELECT * FROM VALUES {_values(QUERIES, spark=True)} AS q(query_id, query, vec_id)")
        return q.join(self.raw("embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left").withColumn("model_id", F.lit(MODEL))

    def views(self) -> DataFrame:
        v = self.spark.sql(f"SELECT * FROM VALUES {_values(VIEWS, spark=True)} AS v(query_id, view, query, vec_id, topics)")
        return v.join(self.raw("embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left").withColumn("model_id", F.lit(MODEL))

    def subscriptions(self) -> DataFrame:
        """Standing interests, each the vector of one message, by rule."""
        s = self.raw("embeddings").filter("vec_id % 50 = 7")
        return s.selectExpr(
            "vec_id AS subscription_id", "CASE WHEN vec_id % 100 = 7 THEN 'percentile' ELSE 'top_n' END AS mode", "90 AS percentile", "5 AS top_n", "72 AS window_hours", "CAST(vec_id % 4 AS INT) AS cap_per_day",
            "CASE WHEN vec_id % 150 = 7 THEN array('c1', 'c2', 'c3') ELSE array() END AS topics", "embedding AS vector",
        ).withColumn("model_id", F.lit(MODEL))

    def vector_links(self) -> DataFrame:
        return self.vectors().select("message_id", "topic_id", F.lit(False).alias("removed"))


def _values(rows, spark: bool = False) -> str:
    many = "array({})" if spark else "[{}]"
    lit = lambda x: "NULL" if x is None else "'" + x + "'" if isinstance(x, str) else many.format(", ".join(f"'{y}'" for y in x)) if isinstance(x, tuple) else str(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


#: The same tables as SQL, each the body of a common table expression.
SQL = {
    "messages": """SELECT doc_id AS message_id, doc_id AS event_id, doc_id * 10 + 1 AS head_revision_id, source AS sender, CAST(NULL AS BIGINT) AS thread_id,
  TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 1000 AS INTEGER)) AS created_at, CAST(doc_id % 4 AS INTEGER) AS priority, doc_id % 17 = 0 AS retracted, doc_id % 23 = 0 AS pinned,
  doc_id % 29 = 0 AS confirmed, lang AS topic_id, CASE WHEN doc_id % 13 = 0 THEN 'ephemeral' WHEN doc_id % 3 = 0 THEN 'canonical' ELSE 'eager-searchable' END AS text_class,
  CASE WHEN doc_id % 31 = 0 THEN source END AS recipient, n_chars AS body_len FROM documents""",
    "revisions": """SELECT doc_id * 10 + 1 AS revision_id, doc_id AS message_id, text, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 1000 AS INTEGER)) AS created_at FROM documents
  UNION ALL SELECT doc_id * 10, doc_id, 'draft ' || text, TIMESTAMP '2024-01-01' FROM documents WHERE doc_id % 5 = 0""",
    "topics": "SELECT DISTINCT lang AS topic_id, 'lang/' || lang AS name FROM documents",
    "links": "SELECT doc_id AS link_id, doc_id AS message_id, lang AS topic_id, doc_id % 7 = 0 AS protected, doc_id % 11 = 0 AND doc_id % 7 <> 0 AS removed FROM documents",
    "turns": """SELECT conv_id * 1000 + turn AS message_id, CASE WHEN turn > 0 THEN conv_id * 1000 END AS thread_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS reply_to,
  role AS sender, TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INTEGER)) AS created_at, text FROM conversations""",
    "signals": "SELECT user_id AS principal, event_id % (SELECT count(*) FROM documents) AS message_id, event_type AS kind, CAST(1 + event_id % 4 AS INTEGER) AS weight, ts AS created_at FROM events",
    "interactions": """SELECT event_id AS interaction_id, CASE WHEN user_id % 10 = 0 THEN '' ELSE 't' || user_id END AS task_id, 'p' || (user_id % 20) AS principal, event_type AS kind,
  CAST(props->>'$.k' AS BIGINT) * 50 AS budget, CAST(trunc(value * 10) AS BIGINT) AS payload_chars, ts AS created_at, event_id % (SELECT count(*) FROM documents) AS message_id,
  CAST(1 + event_id % 12 AS INTEGER) AS final_rank, CASE event_type WHEN 'purchase' THEN 'found' WHEN 'error' THEN 'not_found' WHEN 'signup' THEN 'workaround' END AS outcome,
  CAST(props->>'$.k' AS BIGINT) AS k FROM events""",
    "impressions": "SELECT interaction_id, message_id, final_rank FROM interactions WHERE kind = 'view'",
    "fetches": "SELECT interaction_id, message_id, task_id, principal FROM interactions WHERE kind = 'purchase'",
    "vectors": "SELECT vec_id AS message_id, vec_id * 10 + CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS revision_id, 'unit64' AS model_id, embedding AS vector, 'c' || label AS topic_id FROM embeddings",
    "attachments": """SELECT page_id AS message_id, page_id AS object_hash, CASE page_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'important' WHEN 2 THEN 'pinned' ELSE 'ephemeral' END AS durability FROM pages
  UNION ALL SELECT page_id + 1, page_id, 'normal' FROM pages WHERE page_id % 3 = 0""",
    "pins": "SELECT page_id AS pin_id, 'p' || (page_id % 3) AS principal, page_id AS object_hash, page_id % 12 = 0 AS removed FROM pages WHERE page_id % 6 = 0",
    "derivatives": """SELECT page_id AS derivative_id, page_id AS object_hash, 'text' AS derivative_type, CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
  page_id % 9 = 0 AS invalidated, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages WHERE page_id % 5 <> 0""",
    "holders": "SELECT page_id AS object_hash, unnest(range(1, CAST(2 + page_id % 4 AS BIGINT))) AS holder FROM pages",
    "queries": f"SELECT q.*, e.embedding AS vector FROM (VALUES {_values(QUERIES)}) AS q(query_id, query, vec_id) LEFT JOIN embeddings e USING (vec_id)",
    "views": f"SELECT v.*, e.embedding AS vector FROM (VALUES {_values(VIEWS)}) AS v(query_id, view, query, vec_id, topics) LEFT JOIN embeddings e USING (vec_id)",
    "subs": """SELECT vec_id AS subscription_id, CASE WHEN vec_id % 100 = 7 THEN 'percentile' ELSE 'top_n' END AS mode, 90 AS percentile, 5 AS top_n, 72 AS window_hours,
  CAST(vec_id % 4 AS INTEGER) AS cap_per_day, CASE WHEN vec_id % 150 = 7 THEN ['c1', 'c2', 'c3'] ELSE [] END AS topics, embedding AS vector FROM embeddings WHERE vec_id % 50 = 7""",
}
_NEEDS = {"impressions": ("interactions",), "fetches": ("interactions",)}


def with_tables(names: str, body: str, **more: str) -> str:
    """SQL with the named tables, then further ones, before a query."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
