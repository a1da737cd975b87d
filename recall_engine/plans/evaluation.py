"""Queries over telemetry, subscriptions, calibration, corpora and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_engine.operators import calibration, checks, corpora, extraction, subscriptions
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


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def _latencies(m: Model) -> DataFrame:
    return m.raw("events").selectExpr("event_type AS kind", "CAST(event_id * 7919 % 100003 AS BIGINT) AS micros")


@query("SELECT kind, count(*) AS n, max(micros) FILTER (i = 95 * n // 100) AS picked FROM (SELECT event_type AS kind, event_id * 7919 % 100003 AS micros, row_number() OVER (PARTITION BY event_type ORDER BY event_id * 7919 % 100003) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def gates_p95(spark: SparkSession, d: str) -> DataFrame:
    return checks.percentile_by_offset(_latencies(Model(spark, d)), "micros", 95, ["kind"])


_COUNTERS = """SELECT count(*) FILTER (outcome = 'found') AS found, count(*) FILTER (outcome = 'not_found') AS not_found, count(*) FILTER (outcome = 'workaround') AS workaround,
count(*) FILTER (budget > 0) AS budgeted, count(*) FILTER (budget > 0 AND payload_chars > budget) AS violations FROM interactions"""
_P95 = "SELECT n AS samples, micros AS p95_micros FROM (SELECT event_id * 7919 % 100003 AS micros, row_number() OVER (ORDER BY event_id * 7919 % 100003) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = 95 * n // 100"
_AT5 = "SELECT count(*) FILTER (outcome IS NOT NULL) AS outcomes, count(*) FILTER (outcome = 'found' AND final_rank <= 5) AS at_5 FROM interactions"


@query(with_tables("interactions", "SELECT * FROM c, p", c=_COUNTERS, p=_P95))
def gate_counters(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return checks.gate_counters(m.interactions(), _latencies(m))


def _success(m: Model) -> DataFrame:
    i = m.interactions()
    shown = i.select("interaction_id", "message_id", "final_rank")
    return calibration.success_at_5(i.withColumnRenamed("message_id", "outcome_message_id"), shown)


@query(with_tables("interactions", _AT5))
def success_at_5(spark: SparkSession, d: str) -> DataFrame:
    return _success(Model(spark, d))


@query(
    with_tables(
        "interactions",
        """SELECT unnest(['budget compliance', 'visible within the limit', 'success at 5', 'workarounds']) AS gate,
unnest([CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN samples < 20 THEN 'INCONCLUSIVE' WHEN p95_micros >= 200000 THEN 'FAIL' ELSE 'PASS' END,
  CASE WHEN t < 30 THEN 'INCONCLUSIVE' WHEN at_5 * 100 // t < 70 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN t < 30 THEN 'INCONCLUSIVE' WHEN workaround * 100 // t > 25 THEN 'FAIL' ELSE 'PASS' END]) AS verdict,
unnest([violations, p95_micros, at_5 * 100 // t, workaround * 100 // t]) AS measured FROM (SELECT *, found + not_found + workaround AS t FROM c, p, a)""",
        c=_COUNTERS, p=_P95, a=_AT5,
    )
)
def gates_report(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return checks.gate_verdicts(checks.gate_counters(m.interactions(), _latencies(m)), _success(m))


def _terms(m: Model) -> DataFrame:
    """Explanations by rule: twelve candidates for each found outcome."""
    found = m.interactions().filter("outcome = 'found'").select("interaction_id", "task_id", F.col("message_id").alias("found"))
    return found.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j")).selectExpr(
        "interaction_id AS episode", "task_id", "found", "found + j - interaction_id % 13 AS message_id", "(interaction_id * 31 + j * 17) % 97 / 97.0D AS r", "0.0D AS s", "(interaction_id * 7 + j * 29) % 89 / 89.0D AS f",
        "(interaction_id + j) % 4 / 3.0D AS p", "0.0D AS i", "0.0D AS n",
    )


_EPS = """SELECT interaction_id AS episode, task_id, message_id AS found, message_id + j - interaction_id % 13 AS message_id, (interaction_id * 31 + j * 17) % 97 / 97.0::DOUBLE AS r, (interaction_id * 7 + j * 29) % 89 / 89.0::DOUBLE AS f,
  (interaction_id + j) % 4 / 3.0::DOUBLE AS p FROM interactions, range(12) t(j) WHERE outcome = 'found'"""
_GRID = "SELECT -(a * 25 + b * 5 + (4 - a - b)) AS grid_id, a / 4.0::DOUBLE AS w_r, b / 4.0::DOUBLE AS w_f, (4 - a - b) / 4.0::DOUBLE AS w_p FROM range(5) x(a), range(5) y(b) WHERE a + b <= 4"
_RANKS = """SELECT grid_id, episode, CASE WHEN max(fs) IS NULL THEN 0 ELSE count(*) FILTER (s > fs OR s = fs AND message_id < found) + 1 END AS place FROM (
  SELECT *, max(s) FILTER (message_id = found) OVER (PARTITION BY grid_id, episode) AS fs FROM (SELECT *, r * w_r + 0.0::DOUBLE + f * w_f + p * w_p AS s FROM eps, grid)) GROUP BY 1, 2"""
_EVAL = "SELECT grid_id, avg(CASE WHEN place BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END) AS success_at_5, avg(CASE WHEN place > 0 THEN 1.0::DOUBLE / place ELSE 0 END) AS mrr, count(*) AS episodes FROM {} GROUP BY 1"


@query(with_tables("interactions", "SELECT grid_id, round(success_at_5, 6) AS success_at_5, round(mrr, 6) AS mrr, episodes FROM (" + _EVAL.format("ranks") + ")", eps=_EPS, grid=_GRID, ranks=_RANKS))
def mrr_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = calibration.simplex(spark, 0.25, ("r", "f", "p"))
    return calibration.evaluate(calibration.found_ranks(_terms(Model(spark, d)), grid)).select("grid_id", r6("success_at_5"), r6("mrr"), "episodes")


_HOLD = "SELECT DISTINCT episode, dense_rank() OVER (ORDER BY task_id) % 4 = 0 AS holdout FROM eps"


@query(with_tables("interactions", _HOLD, eps=_EPS))
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return calibration.holdout(_terms(Model(spark, d))).select("episode", "holdout").distinct()


@query(
    with_tables(
        "interactions",
        """SELECT b.grid_id, round(b.success_at_5, 6) AS success_at_5, round(b.mrr, 6) AS mrr, b.episodes, round(h.success_at_5, 6) AS holdout_success_at_5, round(h.mrr, 6) AS holdout_mrr
FROM (SELECT * FROM train ORDER BY success_at_5 DESC, mrr DESC, grid_id LIMIT 1) b LEFT JOIN held h USING (grid_id)""",
        eps=_EPS, grid=_GRID, ranks=_RANKS, hold=_HOLD, train=_EVAL.format("(SELECT * FROM ranks JOIN hold USING (episode) WHERE NOT holdout)"), held=_EVAL.format("(SELECT * FROM ranks JOIN hold USING (episode) WHERE holdout)"),
    )
)
def calibrate_weights(spark: SparkSession, d: str) -> DataFrame:
    grid = calibration.simplex(spark, 0.25, ("r", "f", "p"))
    best = calibration.calibrate(_terms(Model(spark, d)), grid)
    return best.select("grid_id", r6("success_at_5"), r6("mrr"), "episodes", r6("holdout_success_at_5"), r6("holdout_mrr"))


@query(
    with_tables(
        "interactions",
        """SELECT term, count(*) AS n, round(min(x), 6) AS least, round(max(x) FILTER (i = n // 2), 6) AS median, round(max(x), 6) AS most, round(avg(x), 6) AS mean FROM (
SELECT term, x, row_number() OVER (PARTITION BY term ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY term) AS n FROM (
SELECT 'r' AS term, r * 0.9::DOUBLE AS x FROM eps UNION ALL SELECT 'f', f * 0.07::DOUBLE FROM eps UNION ALL SELECT 'p', p * 0.03::DOUBLE FROM eps UNION ALL SELECT unnest(['s', 'i', 'n']), 0.0 FROM eps)) GROUP BY 1""",
        eps=_EPS,
    )
)
def rank_stats(spark: SparkSession, d: str) -> DataFrame:
    return calibration.rank_stats(_terms(Model(spark, d)), {"r": 0.9, "f": 0.07, "p": 0.03}).select("term", "n", r6("least"), r6("median"), r6("most"), r6("mean"))


#: The granularity of the reference, over the terms that its profiles weigh.
STEP, ACTIVE = 0.05, ("r", "s", "f", "i", "n")


def _all_terms(m: Model) -> DataFrame:
    """The explanations by rule, with values for all terms."""
    return _terms(m).withColumns({t: F.expr(f"(episode * {a} + (message_id - found) * {b} + {b} * 100) % {c} / {c}.0D") for t, a, b, c in (("s", 13, 19, 83), ("i", 5, 11, 79), ("n", 3, 23, 73))})


@query()
def mrr_grid_fine(spark: SparkSession, d: str) -> DataFrame:
    """``mrr_grid`` over all 10,626 vectors of steps of 0.05; tests hold it against the plain way."""
    grid = calibration.simplex(spark, STEP, ACTIVE)
    return calibration.evaluate_counts(calibration.place_counts(_all_terms(Model(spark, d)), grid)).select("grid_id", r6("success_at_5"), r6("mrr"), "episodes")


@query()
def calibrate_weights_fine(spark: SparkSession, d: str) -> DataFrame:
    """``calibrate_weights`` over all 10,626 vectors of steps of 0.05."""
    best = calibration.calibrate_fine(_all_terms(Model(spark, d)), calibration.simplex(spark, STEP, ACTIVE))
    return best.select("grid_id", *[f"w_{t}" for t in ACTIVE], r6("success_at_5"), r6("mrr"), "episodes", r6("holdout_success_at_5"), r6("holdout_mrr"))


_DELIVERED = "SELECT subscription_id, event_id % 500 AS message_id, ts AS delivered_at FROM events JOIN subs ON user_id % 10 = subscription_id // 50 % 10 WHERE event_type = 'click'"


def _delivered(m: Model) -> DataFrame:
    s = m.subscriptions().select("subscription_id")
    e = m.raw("events").filter("event_type = 'click'")
    return e.join(s, F.col("user_id") % 10 == F.expr("subscription_id div 50 % 10")).selectExpr("subscription_id", "event_id % 500 AS message_id", "CAST(ts AS TIMESTAMP) AS delivered_at")


_TRAIL = "SELECT subscription_id, count(*) FILTER (h <= 24) AS last_day, count(*) FILTER (h <= window_hours) AS last_window FROM (SELECT s.subscription_id, window_hours, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(delivered_at)) / 3.6e9::DOUBLE AS h FROM subs s LEFT JOIN delivered USING (subscription_id)) GROUP BY 1"


@query(with_tables("subs", _TRAIL, delivered=_DELIVERED))
def trailing_cap(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return subscriptions.trailing_deliveries(_delivered(m), m.subscriptions(), now())


_SIMS = """SELECT subscription_id, v.message_id, list_inner_product(s.vector::DOUBLE[], v.vector::DOUBLE[]) AS sim FROM subs s, vectors v JOIN messages m USING (message_id)
  WHERE NOT retracted AND NOT pinned AND (len(topics) = 0 OR list_contains(topics, v.topic_id)) AND NOT EXISTS (SELECT 1 FROM delivered e WHERE e.subscription_id = s.subscription_id AND e.message_id = v.message_id)"""


def _of_users(m: Model, kind: str, value: str) -> DataFrame:
    """Subscriptions with what events of a kind say, each different value once with its number n, counted before subscriptions are joined."""
    e = m.raw("events").filter(F.col("event_type") == kind).groupBy((F.col("user_id") % 10).alias("_u"), F.expr(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(m.subscriptions().select("subscription_id"), F.col("_u") == F.expr("subscription_id div 50 % 10")).select("subscription_id", "_v", "n")


def _looked_at(m: Model) -> tuple[DataFrame, ...]:
    delivered = _of_users(m, "click", "event_id % 500").select("subscription_id", F.col("_v").alias("message_id"))
    return m.messages(), m.vectors(), m.vector_links(), delivered, m.messages().filter("pinned")


@query(with_tables("subs messages vectors", "SELECT subscription_id, message_id, round(sim, 6) AS sim FROM sims", delivered=_DELIVERED, sims=_SIMS))
def sub_matching(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return subscriptions.similarities(m.subscriptions(), *_looked_at(m), 6)


_OBS = "SELECT subscription_id, (event_id % 1000) / 1000.0::DOUBLE AS sim FROM events JOIN subs ON user_id % 10 = subscription_id // 50 % 10 WHERE event_type = 'signup'"


@query(
    with_tables(
        "subs messages vectors",
        """SELECT subscription_id, message_id, place, place <= 5 AND sim >= reference AS included FROM (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY sim DESC, message_id) AS place FROM sims) JOIN ref USING (subscription_id)""",
        delivered=_DELIVERED, sims=_SIMS, observed=_OBS,
        mixed="SELECT subscription_id, sim, row_number() OVER (PARTITION BY subscription_id ORDER BY sim) - 1 AS i, count(*) OVER (PARTITION BY subscription_id) AS m FROM (SELECT subscription_id, sim FROM sims UNION ALL SELECT * FROM observed)",
        ref="SELECT subscription_id, sim + CASE WHEN mode = 'percentile' THEN 0.0 ELSE 0.15 END::DOUBLE AS reference FROM mixed JOIN subs USING (subscription_id) WHERE i = CASE WHEN mode = 'percentile' THEN least(m * percentile // 100, m - 1) ELSE m // 4 END",
    )
)
def sub_calibration(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    subs = m.subscriptions().withColumn("allowance", F.col("top_n").cast("long"))
    observed = _of_users(m, "signup", "event_id % 1000").selectExpr("subscription_id", "_v / 1000.0D AS sim", "n")
    return subscriptions.calibrated(subs, *_looked_at(m), observed).select("subscription_id", "message_id", F.col("place").cast("long").alias("place"), "included")


@query(with_tables("subs", "SELECT subscription_id, greatest(0, least(cap_per_day - last_day, CASE WHEN mode = 'top_n' THEN 5 - last_window ELSE cap_per_day - last_day END))::BIGINT AS allowance FROM subs JOIN trail USING (subscription_id)", delivered=_DELIVERED, trail=_TRAIL))
def sub_allowances(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return subscriptions.allowances(m.subscriptions(), subscriptions.trailing_deliveries(_delivered(m), m.subscriptions(), now()))


@query("SELECT item_id AS id, CASE WHEN ('0x' || sha256('salt' || item_id)[1:4])::INT < 19660 THEN 'holdout' ELSE 'dev' END AS split FROM benchmark")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    q = Model(spark, d).raw("benchmark").select(F.col("item_id").alias("id"))
    return corpora.assign_splits(q, "salt")


_ASKED = "SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: strlen(x) >= 2)) AS terms FROM benchmark"
_GREP = """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {}) AS rank FROM (SELECT *, bool_or(every) OVER (PARTITION BY query_id) AS full_hit FROM (
  SELECT query_id, doc_id AS id, len(list_filter(terms, lambda t: contains(lower(text), t))) AS hit, hit = len(terms) AS every FROM documents, asked WHERE hit > 0)) WHERE every OR NOT full_hit QUALIFY rank <= 10"""


def _asked(m: Model) -> DataFrame:
    """All benchmark items, with their whole texts as requests."""
    return m.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH asked AS ({_ASKED}) " + _GREP.format("id"))
def grep_baseline(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return corpora.grep(m.raw("documents").select(F.col("doc_id").alias("id"), "text"), _asked(m)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH asked AS ({_ASKED}) " + _GREP.format("id % 100 DESC, id DESC"))
def notes_baseline(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    items = m.raw("documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 100).alias("created_at"))
    return corpora.notes(items, _asked(m)).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT id, running FROM (SELECT doc_id AS id, sum(length(doc_id::VARCHAR) + length(lang) + length(text) + 5) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 20000")
def notes_tail(spark: SparkSession, d: str) -> DataFrame:
    items = Model(spark, d).raw("documents").selectExpr("doc_id AS id", "lang AS title", "text", "doc_id AS created_at")
    return corpora.notes_tail(items, 20000).select("id", "running")


@query(
    """WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 4 THEN doc_id * 3 END AS dup FROM documents), s AS (SELECT i.id, i.dup, t.id AS there, t.dup AS next FROM i LEFT JOIN i t ON t.id = i.dup WHERE i.dup IS NOT NULL)
SELECT CASE WHEN there IS NULL THEN 'missing' WHEN next IS NOT NULL THEN 'chain' ELSE 'kept' END AS outcome, count(*) AS n FROM s GROUP BY 1"""
)
def mine_duplicates(spark: SparkSession, d: str) -> DataFrame:
    issues = Model(spark, d).raw("documents").selectExpr("doc_id AS id", "split_part(text, '\n', 1) AS title", "text AS body", "CASE WHEN doc_id % 9 = 4 THEN doc_id * 3 END AS duplicate_of")
    return corpora.mine_duplicates(issues)[2]


@query("SELECT id, list_sort(list(DISTINCT o)) AS relevant FROM (SELECT doc_id AS id, unnest([doc_id - 1, doc_id - 2, doc_id - 4]) AS o FROM documents WHERE doc_id % 4 = 0) WHERE o >= 0 AND o % 4 <> 0 GROUP BY 1")
def mine_questions(spark: SparkSession, d: str) -> DataFrame:
    q = Model(spark, d).raw("documents").selectExpr("doc_id AS id", "split_part(text, '\n', 1) AS title", "text AS body", "CASE WHEN doc_id % 4 = 0 THEN array(doc_id - 1, doc_id - 2, doc_id - 4) END AS originals")
    return corpora.mine_questions(q)[1].select("id", "relevant")


@query("SELECT 'notes/' || (doc_id % 50 + 1) || '.md' AS target, count(*) AS n FROM documents WHERE 'notes/' || (doc_id % 50 + 1) || '.md' <> 'notes/' || doc_id || '.md' AND doc_id % 50 + 1 IN (SELECT doc_id FROM documents) GROUP BY 1")
def mine_links(spark: SparkSession, d: str) -> DataFrame:
    """Links in whole texts; the test texts have none of their own, so each gets two by rule."""
    docs = Model(spark, d).raw("documents").selectExpr("concat('notes/', doc_id, '.md') AS path", "concat(coalesce(text, ''), ' see [a longer name](', doc_id % 50 + 1, '.md) and [short](1.md)') AS text")
    return corpora.mine_links(docs).select(F.element_at("relevant", 1).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'unknown item' AS problem, count(*) AS n FROM benchmark WHERE item_id % 7 = 0 AND 10000000 NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'item repeats', count(*) FROM documents WHERE doc_id % 3 = 0")
def corpus_validate(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    docs = m.raw("documents").select(F.col("doc_id").alias("id"))
    queries = m.raw("benchmark").selectExpr("item_id AS id", "CASE WHEN item_id % 7 = 0 THEN array(10000000L) ELSE array(1L) END AS relevant")
    found = corpora.validate(docs.union(docs.filter("id % 3 = 0")), queries)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


_JUDGED = "SELECT item_id AS query_id, list(doc_id) AS relevant FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1"


@query(
    f"WITH asked AS ({_ASKED}), found AS ({_GREP.format('id')}), judged AS ({_JUDGED}), hits AS (SELECT query_id, min(rank) AS f, count(*) AS h FROM found JOIN judged USING (query_id) WHERE rank <= 5 AND list_contains(relevant, id) GROUP BY 1) "
    "SELECT count(*) AS queries, avg((f IS NOT NULL)::INT::DOUBLE) AS success, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, round(avg(coalesce(h::DOUBLE / len(relevant), 0)), 6) AS recall FROM judged LEFT JOIN hits USING (query_id)"
)
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """The file search, judged: an item's relevant documents are those that hold its whole text."""
    m = Model(spark, d)
    docs = m.raw("documents").select(F.col("doc_id").alias("id"), "text")
    items = m.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    judged = corpora.holders(docs, items).groupBy("query_id").agg(F.collect_list("id").alias("relevant"))
    return corpora.scores(corpora.grep(docs, _asked(m)), judged).select("queries", "success", r6("mrr"), r6("recall"))


@query("SELECT event_id, event_type <> 'click' OR event_id % 600 <= 300 AS body_kept FROM events")
def late_bodies(spark: SparkSession, d: str) -> DataFrame:
    e = Model(spark, d).raw("events").withColumn("created_at", F.col("ts").cast("timestamp"))
    e = e.withColumn("arrived_at", F.expr("timestampadd(SECOND, CAST(event_id % 600 AS INT), created_at)")).withColumn("text_class", F.when(F.col("event_type") == "click", "ephemeral").otherwise("canonical"))
    return corpora.lateness(e).select("event_id", "body_kept")


@query("SELECT CASE WHEN page_id % 4 = 0 THEN 'html' WHEN page_id % 4 = 1 THEN 'pdf' WHEN page_id % 4 = 2 THEN 'text' WHEN page_id % 8 = 3 THEN 'html' ELSE '' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def content_sniff(spark: SparkSession, d: str) -> DataFrame:
    p = Model(spark, d).raw("pages")
    data = F.when(F.col("page_id") % 4 == 0, F.col("html")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("%PDF-1.7"), "html")).when(F.col("page_id") % 4 == 2, F.lit("plain words")).otherwise(F.concat(F.lit("\0"), F.when(F.col("page_id") % 8 == 3, F.col("html")).otherwise(F.lit("bytes"))))
    return p.select(extraction.sniff(F.encode(data, "UTF-8")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of all pages, by the streaming parser; no SQL says this."""
    p = Model(spark, d).raw("pages").select(F.col("page_id").alias("object_hash"), F.encode("html", "UTF-8").alias("data"))
    return extraction.extract_all(p)


@query("SELECT e.vec_id AS message_id, CAST(trunc(sim * 10000) AS INT) AS sim_bp, sim >= 0.5 AS agrees FROM (SELECT a.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) e")
def summary_check(spark: SparkSession, d: str) -> DataFrame:
    v = Model(spark, d).vectors().select("message_id", "vector")
    return extraction.check_summaries(v, v.select((F.col("message_id") - 1).alias("message_id"), "vector"))


@query()
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """Hashed bags of words of all documents; the hash is the engine's own."""
    from recall_engine.operators.vectors import hash_embed as embed

    return embed(Model(spark, d).raw("documents"), "doc_id", "text", 64).select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))
