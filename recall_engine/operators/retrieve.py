"""Search, digest, thread and fetch: compositions of the retrieval and ranking operators, many queries in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.functions.text import quote_lines, snippet
from recall_engine.operators import lexical, lookups, ranking, vectors
from recall_engine.operators.index import Index, stated
from recall_engine.params import PARAMS, Params, Weights
from recall_engine.schemas import LATENCIES


@dataclass(frozen=True)
class Corpus:
    """The tables that retrieval reads. messages: message_id, event_id, head_revision_id, sender, thread_id, created_at,
    priority, retracted, pinned, confirmed; revisions: revision_id, message_id, text; vectors: message_id, model_id,
    vector; salience (may be None): message_id, salience, novelty, impressions; attachments: message_id, object_hash, and
    derivatives: derivative_id, object_hash, status, invalidated, text (both may be None); index: a stored index of the
    revisions, and derivative_index one of the derivatives, asked in place of their texts (both may be None)."""

    messages: DataFrame
    revisions: DataFrame
    vectors: DataFrame | None = None
    salience: DataFrame | None = None
    attachments: DataFrame | None = None
    derivatives: DataFrame | None = None
    index: Index | None = None
    derivative_index: Index | None = None


def relevance(c: Corpus, queries: DataFrame, scope: DataFrame | None = None, lexical_only: bool = False, p: Params = PARAMS) -> DataFrame:
    """(query_id, message_id, lex_rank, vec_rank, rrf). The lexical list has messages that hold the words, then those whose
    attachments do, then those that hold the terms anywhere. A scope is applied after the lexical list is cut and before
    the vector list is, as the store does. queries: query_id, query and, for vectors, model_id and vector."""
    queries, _ = stated(queries)
    sources = [lexical.word_search(c.messages, c.revisions, queries, p.candidates, p=p, index=c.index)]
    if c.attachments is not None and c.derivatives is not None:
        sources.append(lexical.derivative_search(c.messages, c.attachments, c.derivatives, queries, p.candidates, index=c.derivative_index))
    sources.append(lexical.substring_search(c.messages, c.revisions, queries, p.candidates, p=p, index=c.index))
    found = lexical.ordered_union(*sources, k=p.candidates)
    if scope is not None:
        inside = found.join(scope, "message_id", "left_semi").withColumnRenamed("rank", "_of_all")
        found = lexical.top_per_query(inside, p.candidates, "_of_all")
    lists = {"lex_rank": found}
    if c.vectors is not None and not lexical_only:
        shown = c.messages.filter(~F.col("retracted")).select("message_id")
        known = c.vectors.join(shown if scope is None else shown.join(scope, "message_id", "left_semi"), "message_id", "left_semi")
        lists["vec_rank"] = vectors.cosine_topk(known, queries.filter(F.col("vector").isNotNull()), p.candidates)
    fused = ranking.rrf(lists, p.rrf_k)
    return fused if "vec_rank" in lists else fused.withColumn("vec_rank", F.lit(None).cast("int"))


def hydrated(c: Corpus, found: DataFrame) -> DataFrame:
    """Found messages with what ranking needs."""
    rows = c.messages.select("message_id", "event_id", "head_revision_id", "sender", "thread_id", "created_at", "priority", "pinned", "confirmed")
    out = found.join(rows, "message_id")
    if c.salience is None:
        return out.withColumns({"salience": F.lit(0.0), "novelty": F.lit(0.0), "impressions": F.lit(0).cast("long")})
    return out.join(c.salience.select("message_id", "salience", "novelty", "impressions"), "message_id", "left")


def search(c: Corpus, queries: DataFrame, now: Column, k: int = PARAMS.default_k, weights: Weights = PARAMS.search_p0, scope: DataFrame | None = None, lexical_only: bool = False, quota: bool = False, p: Params = PARAMS) -> DataFrame:
    """The first k messages of each query with all ranking terms. quota: reserve a tenth for what few have seen.
    lexical_only: leave vectors out, as a loaded system does."""
    found = hydrated(c, relevance(c, queries, scope, lexical_only, p)).withColumn("mandatory", F.lit(None).cast("string"))
    ranked = ranking.rank(found, weights, now, p.half_search, p=p)
    return ranking.exploration_quota(ranked, k, F.col("impressions"), p) if quota else ranked.filter(F.col("final_rank") <= k)


def rendered(c: Corpus, hits: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Hits with the text that a client receives for each."""
    bodies = c.revisions.select(F.col("revision_id").alias("head_revision_id"), snippet(F.col("text"), p.snippet).alias("_snippet"))
    line = F.concat_ws("\t", F.col("final_rank").cast("string"), F.col("message_id").cast("string"), F.col("head_revision_id").cast("string"), F.col("score").cast("string"), F.coalesce("mandatory", F.lit("-")), F.concat(F.lit("from="), "sender"))
    return hits.join(bodies, "head_revision_id", "left").withColumn("rendered", F.concat(line, F.lit("\n"), quote_lines(F.coalesce("_snippet", F.lit("")))))


def digest_candidates(messages: DataFrame, links: DataFrame, views: DataFrame) -> DataFrame:
    """(query_id, message_id, mandatory) that belong in each view's digest: messages of its topics, those that name it
    as recipient, pinned ones. views: query_id, view, topics; recipients are in messages.recipient. A message that has
    more than one reason keeps the first of recipient, pin."""
    shown = messages.filter(~F.col("retracted"))
    topical = views.select("query_id", F.explode("topics").alias("topic_id")).join(lookups.live_links(links).select("message_id", "topic_id"), "topic_id").select("query_id", "message_id").distinct()
    topical = topical.join(shown.select("message_id"), "message_id", "left_semi").withColumn("mandatory", F.lit(None).cast("string"))
    named = views.select("query_id", F.col("view").alias("recipient")).join(shown.select("message_id", "recipient"), "recipient").select("query_id", "message_id", F.lit("recipient").alias("mandatory"))
    pinned = views.select("query_id").crossJoin(shown.filter("pinned").select("message_id")).withColumn("mandatory", F.lit("pin"))
    every = topical.unionByName(named).unionByName(pinned)
    return every.groupBy("query_id", "message_id").agg(F.min_by("mandatory", ranking.mandatory_class(F.col("mandatory"))).alias("mandatory"))


def digest(c: Corpus, views: DataFrame, links: DataFrame, now: Column, weights: Weights = PARAMS.digest_p0, matched: DataFrame | None = None, p: Params = PARAMS) -> DataFrame:
    """Each view's digest, ranked. Relevance lists are those of the whole corpus; members outside them have no fusion
    score. Views without an interest query (null) rank all alike. matched: (query_id, message_id) from subscriptions."""
    members = digest_candidates(c.messages, links, views)
    if matched is not None:
        new = matched.join(members, ["query_id", "message_id"], "left_anti").select("query_id", "message_id", F.lit("subscription").alias("mandatory"))
        members = members.unionByName(new)
    asked = views.filter(F.col("query").isNotNull())
    found = relevance(c, asked, p=p).select("query_id", "message_id", "lex_rank", "vec_rank", "rrf")
    with_rrf = members.join(found, ["query_id", "message_id"], "left").withColumn("rrf", F.coalesce("rrf", F.lit(0.0)))
    ranked = ranking.rank(hydrated(c, with_rrf.join(asked.select("query_id"), "query_id", "left_semi")), weights, now, p.half_digest, p=p)
    silent = members.join(asked.select("query_id"), "query_id", "left_anti").withColumns({"lex_rank": F.lit(None).cast("int"), "vec_rank": F.lit(None).cast("int"), "rrf": F.lit(0.0)})
    return ranked.unionByName(ranking.rank(hydrated(c, silent), weights, now, p.half_digest, uniform=True, p=p))


def omitted_mandatory(budgeted: DataFrame) -> DataFrame:
    """(query_id, omitted_mandatory): what had to be delivered and didn't fit; subscription matches don't count."""
    missed = ~F.col("included") & F.col("mandatory").isin("recipient", "pin")
    return budgeted.groupBy("query_id").agg(F.count_if(missed).alias("omitted_mandatory"))


def threads(messages: DataFrame, roots: DataFrame) -> DataFrame:
    """(query_id, message_id, final_rank): root and members of each thread, oldest first. roots: query_id, root."""
    member = messages.select("message_id", "created_at", F.coalesce("thread_id", "message_id").alias("root"))
    return lexical.top_per_query(roots.join(member, "root"), 1 << 30, "created_at", "message_id").withColumnRenamed("rank", "final_rank")


def fetch(messages: DataFrame, revisions: DataFrame, objects: DataFrame, wanted: DataFrame, now: Column, p: Params = PARAMS) -> DataFrame:
    """(message_id, state, body): delivered, expired (an ephemeral body past its time), not_delivered, or not_found."""
    known = messages.select("message_id", "head_revision_id", "text_class", "created_at", F.lit(True).alias("_known"))
    bodies = revisions.select(F.col("revision_id").alias("head_revision_id"), "body_hash").join(objects.select(F.col("object_hash").alias("body_hash"), F.col("data").alias("body")), "body_hash", "left")
    out = wanted.select("message_id").join(known, "message_id", "left").join(bodies, "head_revision_id", "left")
    old = (F.unix_micros(now) - F.unix_micros("created_at")) / F.lit(3.6e9) > p.ttl_ephemeral
    state = F.when(F.col("_known").isNull(), "not_found").when(F.col("body").isNotNull(), "delivered").when((F.col("text_class") == "ephemeral") & old, "expired").otherwise("not_delivered")
    return out.select("message_id", state.alias("state"), "body")


def impressions_of(interaction: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interactions, impressions) to append for a retrieval. interaction: query_id, interaction_id, task_id, principal,
    kind, created_at. A task that isn't given is named after the interaction, and marked as inferred."""
    missing = F.coalesce(F.col("task_id"), F.lit("")) == ""
    task = F.when(missing, F.concat(F.lit("task-"), F.left("interaction_id", F.lit(8)))).otherwise(F.col("task_id"))
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"))
    rows = interaction.join(counted, "query_id", "left").withColumns({"inferred": missing, "task_id": task, "result_count": F.coalesce("result_count", F.lit(0))})
    return rows.drop("query_id"), hits.join(interaction.select("query_id", "interaction_id"), "query_id").select("interaction_id", "message_id", F.col("final_rank").alias("position"))


def record_latencies(samples: DataFrame, folder: str) -> None:
    """Appends latencies (kind, micros, created_at) to those that the gates judge; samples without a time or below zero are left out."""
    schema = samples.sparkSession.createDataFrame([], LATENCIES).schema
    rows = samples.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    rows.filter("kind IS NOT NULL AND micros >= 0 AND created_at IS NOT NULL").write.mode("append").parquet(folder)


def recorded_latencies(spark: SparkSession, folder: str) -> DataFrame:
    """What has been recorded."""
    return spark.read.schema(LATENCIES).parquet(folder)


def save_search(saved: DataFrame, name: str, query: str) -> DataFrame:
    """The saved searches with one more, or with its query replaced."""
    if not name or not all(ch.isalnum() or ch in "-_" for ch in name):
        raise ValueError(f"not a name: {name!r}")
    new = saved.sparkSession.createDataFrame([(name, query)], "name string, query string")
    return saved.filter(F.col("name") != name).unionByName(new).orderBy("name")


def remove_search(saved: DataFrame, name: str) -> DataFrame:
    """The saved searches without one; unchanged if there is none of that name."""
    return saved.filter(F.col("name") != name).orderBy("name")


def saved_queries(saved: DataFrame) -> DataFrame:
    """Saved searches as a table of queries."""
    return saved.select(F.col("name").alias("query_id"), "query").orderBy("name")
