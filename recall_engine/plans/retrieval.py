"""Retrieval and ranking queries."""

from __future__ import annotations

import inspect
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.functions.text import ACCENTED, FOLDED, snippet, words
from recall_engine.operators import index, lexical, lookups, ranking, retrieve, salience, vectors
from recall_engine.params import PARAMS
from recall_engine.sources.files import checkpointed, shared_folder
from recall_engine.sources.model import Model, now, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


_FOLD = f"translate(lower(coalesce({{}}, '')), '{ACCENTED}', '{FOLDED}')"
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{N}}\p{{Co}}_\-#@]+')"
_TOKENS = f"SELECT revision_id, len(w) AS doc_len, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT revision_id, {_WORDS.format('text')} AS w FROM revisions)"
_STATS = "SELECT (SELECT count(*) FROM revisions) AS n, (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM revisions) AS avg_len"
_TERMS = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) AS phrase, term, count(*) OVER (PARTITION BY query_id) AS phrases FROM (SELECT query_id, unnest(string_split(query, ' ')) AS term, unnest(range(len(string_split(query, ' ')))) AS i FROM queries)"
_SCORED_FROM = """SELECT query_id, revision_id, -list_sum(list(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len)) ORDER BY phrase)) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id, phrase) AS df FROM {hits}), {stats} GROUP BY query_id, revision_id, phrases HAVING count(*) = phrases"""
_SCORED = _SCORED_FROM.format(hits="hits", stats="stats")
_HITS = "SELECT query_id, phrase, phrases, revision_id, doc_len, count(*) AS tf FROM tok JOIN terms USING (term) GROUP BY ALL"
_LEX = """SELECT query_id, message_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, message_id) AS rank
  FROM scored JOIN messages ON head_revision_id = revision_id WHERE NOT retracted QUALIFY rank <= 100"""
_LEX_CTES = {"tok": _TOKENS, "stats": _STATS, "terms": _TERMS, "hits": _HITS, "scored": _SCORED, "lex": _LEX}
_DERIV = f"""SELECT DISTINCT query_id, a.message_id FROM (SELECT query_id, derivative_id, phrases FROM (
  SELECT DISTINCT query_id, phrases, term, derivative_id FROM terms JOIN (SELECT derivative_id, unnest({_WORDS.format("text")}) AS term FROM derivatives WHERE status = 'ok' AND NOT invalidated) USING (term))
  GROUP BY ALL HAVING count(*) = phrases) h JOIN derivatives d USING (derivative_id) JOIN attachments a USING (object_hash) JOIN messages m ON m.message_id = a.message_id WHERE NOT m.retracted"""
_DERIV_RANKED = "SELECT query_id, message_id, row_number() OVER (PARTITION BY query_id ORDER BY message_id) AS rank FROM deriv QUALIFY rank <= 100"
_FULL_CTES = {
    "tok": _TOKENS, "stats": _STATS, "terms": _TERMS, "hits": _HITS, "scored": _SCORED, "of_words": _LEX, "deriv": _DERIV, "dr": _DERIV_RANKED,
    "t": "SELECT revision_id, lower(coalesce(text, '')) AS low, greatest(0, length(lower(coalesce(text, ''))) - 2) AS doc_len FROM revisions",
    "tterms": "SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY i) AS phrase, count(*) OVER (PARTITION BY query_id) AS phrases FROM (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term, unnest(range(len(string_split(query, ' ')))) AS i FROM queries) WHERE length(term) >= 3",
    "tstats": "SELECT count(*) AS n, avg(doc_len) AS avg_len FROM t",
    "thits": "SELECT query_id, phrase, phrases, revision_id, doc_len, (length(low) - length(replace(low, term, ''))) // length(term) AS tf FROM t, tterms WHERE contains(low, term)",
    "tscored": _SCORED_FROM.format(hits="thits", stats="tstats"),
    "tri": _LEX.replace("scored", "tscored"),
    "every": """SELECT query_id, message_id, min(source) AS source, arg_min(rank, source) AS r FROM (SELECT query_id, message_id, rank, 0 AS source FROM of_words
  UNION ALL SELECT query_id, message_id, rank, 1 FROM dr UNION ALL SELECT query_id, message_id, rank, 2 FROM tri) GROUP BY ALL""",
    "lex": "SELECT query_id, message_id, source, row_number() OVER (PARTITION BY query_id ORDER BY source, r, message_id) AS rank FROM every QUALIFY rank <= 100",
}
_VEC = """SELECT q.query_id, v.message_id, list_inner_product(q.vector::DOUBLE[], v.vector::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY q.query_id ORDER BY sim DESC, v.message_id) AS rank
  FROM queries q, vectors v JOIN messages USING (message_id) WHERE NOT retracted AND q.vector IS NOT NULL QUALIFY rank <= 100"""
_RRF = """SELECT query_id, message_id, l.rank AS lex_rank, v.rank AS vec_rank, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS rrf
  FROM lex l FULL JOIN vec v USING (query_id, message_id)"""
_NOW = "TIMESTAMP '2024-02-01'"
_AGE = f"greatest(0.0, (epoch_us({_NOW}) - epoch_us(created_at)) / 3.6e9::DOUBLE)"
_PCT = "CASE WHEN count(*) OVER (PARTITION BY query_id) = 1 THEN 1.0 ELSE percent_rank() OVER (PARTITION BY query_id ORDER BY rrf) END"


def _ranked(half: float, w, source: str, uniform: bool = False) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE mandatory WHEN 'recipient' THEN 0 WHEN 'pin' THEN 1 WHEN 'subscription' THEN 2 ELSE 3 END, score DESC, created_at DESC, event_id) AS final_rank
  FROM (SELECT *, r * {w.r}::DOUBLE + s * {w.s}::DOUBLE + f * {w.f}::DOUBLE + p * {w.p}::DOUBLE + i * {w.i}::DOUBLE + n * {w.n}::DOUBLE AS score
  FROM (SELECT *, {"1.0::DOUBLE" if uniform else _PCT} AS r, coalesce(salience, 0)::DOUBLE AS s, pow(2, -{_AGE} / {half}) AS f,
    priority / 3.0::DOUBLE * CASE WHEN pinned OR confirmed THEN 1.0 ELSE pow(2, -{_AGE} / 60.0) END AS p,
    CASE WHEN pinned THEN 1.0 WHEN confirmed THEN 0.6 ELSE 0.0 END::DOUBLE AS i, coalesce(novelty, 0)::DOUBLE AS n FROM {source}))"""


def _index_of(m: Model, name: str, *parts: DataFrame, id_col: str = "revision_id", only: str | None = None) -> index.Index:
    """The index of a derived table, each part a batch. It is named by the files that the table comes from and by how
    it is derived and indexed, so it is built once for them, in the shared folder, and later queries find it. One that is asked for
    words or trigrams only is built with these alone, if there is no whole one yet."""
    files = m.spark.read.parquet(f"{m.dir}/documents.parquet").select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").cast("decimal(38,0)").alias("h"))
    how = inspect.getsource(getattr(Model, name)) + inspect.getsource(index)
    mark = files.agg(F.sha2(F.concat(F.sum("h").cast("string"), F.lit(how)), 256)).first()[0]
    folder = f"{shared_folder(m.spark)}/index-4-{name}-{mark}"
    batches = tuple(range(len(parts)))
    held = index.find(m.spark, folder, id_col, batches)
    if held is None and only:
        folder = f"{folder}-{only}"
        held = index.find(m.spark, folder, id_col, batches)
    if held is None:
        for i, part in enumerate(parts):
            index.write(part, folder, i, id_col, parts=(only,) if only else index.PARTS)
        held = index.read(m.spark, folder, id_col)
    return held


def stored(m: Model, only: str | None = None) -> index.Index:
    """An index of the revisions, written in two batches: older revisions came first."""
    revisions = m.revisions()
    return _index_of(m, "revisions", revisions.filter("revision_id % 10 = 0"), revisions.filter("revision_id % 10 <> 0"), only=only)


def stored_derivatives(m: Model) -> index.Index:
    """An index of attachments' texts; nobody asks for terms within their words."""
    live = m.derivatives().filter("status = 'ok'")
    return _index_of(m, "derivatives", live, id_col="derivative_id", only="words")


def corpus(m: Model, salient: DataFrame | None = None) -> retrieve.Corpus:
    """An index of trigrams that isn't there yet costs more than a batch of requests saves by it: terms within words are looked for in the
    index's texts."""
    return retrieve.Corpus(m.messages(), m.revisions(), m.vectors(), salient, m.attachments(), m.derivatives(), stored(m, "words"), stored_derivatives(m))


@query(with_tables("messages revisions queries", "SELECT query_id, message_id, round(score, 6) AS score, rank FROM lex", **_LEX_CTES))
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lexical.word_search(m.messages(), m.revisions(), m.queries(), index=stored(m, "words")).select("query_id", "message_id", r6("score", "score"), F.col("rank").cast("long").alias("rank"))


@query(
    with_tables(
        "revisions",
        "SELECT query_id, revision_id, round(score, 6) AS score FROM scored",
        tok=_TOKENS, stats=_STATS,
        hits="""SELECT 1 AS query_id, 1 AS phrase, 2 AS phrases, a.revision_id, a.doc_len, count(*) AS tf FROM tok a JOIN tok b ON a.revision_id = b.revision_id AND b.pos = a.pos + 1
  WHERE a.term = 'of' AND b.term = 'the' GROUP BY ALL UNION ALL SELECT 1, 2, 2, revision_id, doc_len, count(*) FROM tok WHERE term = 'and' GROUP BY ALL""",
        scored=_SCORED,
    )
)
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Words joined by a full stop are a phrase: next to each other."""
    held = stored(Model(spark, d), "words")
    asked = spark.sql("SELECT 1 AS query_id, 'of.the and' AS query")
    return lexical.bm25(held, held.word_stats(), asked).select("query_id", "revision_id", r6("score", "score"))


_TRI = ((1, "thre onanti"), (2, "license gnu"), (3, "éaux x"))


@query(
    with_tables(
        "messages revisions",
        """SELECT query_id, message_id, round(score, 6) AS score, rank FROM (SELECT query_id, message_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, message_id) AS rank
FROM scored JOIN messages ON head_revision_id = revision_id WHERE NOT retracted) WHERE rank <= 100""",
        t="SELECT revision_id, lower(coalesce(text, '')) AS low, greatest(0, length(lower(coalesce(text, ''))) - 2) AS doc_len FROM revisions",
        asked="SELECT * FROM (VALUES (1, 'thre', 1, 2), (1, 'onanti', 2, 2), (2, 'license', 1, 2), (2, 'gnu', 2, 2), (3, 'éaux', 1, 1)) AS q(query_id, term, phrase, phrases)",
        stats="SELECT count(*) AS n, avg(doc_len) AS avg_len FROM t",
        hits="SELECT query_id, phrase, phrases, revision_id, doc_len, (length(low) - length(replace(low, term, ''))) // length(term) AS tf FROM t, asked WHERE contains(low, term)",
        scored=_SCORED,
    )
)
def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    asked = spark.createDataFrame(list(_TRI), "query_id int, query string")
    return lexical.substring_search(m.messages(), m.revisions(), asked, index=stored(m, "grams")).select("query_id", "message_id", r6("score", "score"), F.col("rank").cast("long").alias("rank"))


@query(with_tables("messages attachments derivatives queries", "SELECT * FROM dr", terms=_TERMS, deriv=_DERIV, dr=_DERIV_RANKED))
def derivative_search(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lexical.derivative_search(m.messages(), m.attachments(), m.derivatives(), m.queries(), index=stored_derivatives(m)).select("query_id", "message_id", F.col("rank").cast("long").alias("rank"))


@query(with_tables("messages revisions attachments derivatives queries", "SELECT query_id, message_id, source, rank FROM lex", **_FULL_CTES))
def lexical_union(spark: SparkSession, d: str) -> DataFrame:
    """Words first, then attachments' texts, then terms within words; at most a hundred a query."""
    m = Model(spark, d)
    a = lexical.word_search(m.messages(), m.revisions(), m.queries())
    b = lexical.derivative_search(m.messages(), m.attachments(), m.derivatives(), m.queries())
    c = lexical.substring_search(m.messages(), m.revisions(), m.queries())
    return lexical.ordered_union(a, b, c).select("query_id", "message_id", "source", F.col("rank").cast("long").alias("rank"))


@query(with_tables("messages revisions attachments derivatives queries", "SELECT query_id, message_id, source, rank FROM lex", **_FULL_CTES))
def lexical_union_stored(spark: SparkSession, d: str) -> DataFrame:
    """As lexical_union, from a stored index."""
    m = Model(spark, d)
    held = stored(m)
    a = lexical.word_search(m.messages(), m.revisions(), m.queries(), index=held)
    b = lexical.derivative_search(m.messages(), m.attachments(), m.derivatives(), m.queries(), index=stored_derivatives(m))
    c = lexical.substring_search(m.messages(), m.revisions(), m.queries(), index=held)
    return lexical.ordered_union(a, b, c).select("query_id", "message_id", "source", F.col("rank").cast("long").alias("rank"))


@query(SQL["trigram_search"])
def trigram_search_stored(spark: SparkSession, d: str) -> DataFrame:
    """As trigram_search, from an index whose batches were merged into one of more buckets, after texts that aren't in the
    table were added and removed again."""
    m = Model(spark, d)
    folder = f"{shared_folder(spark)}/index-merged-{uuid.uuid4().hex}"
    revisions = m.revisions()
    index.write(revisions.filter("revision_id % 10 = 0"), folder, 0, buckets=8)
    index.write(revisions.filter("revision_id % 10 <> 0").unionByName(revisions.filter("revision_id % 3 = 0").withColumn("revision_id", -F.col("revision_id") - 1)), folder, 1, buckets=8)
    index.remove(revisions.filter("revision_id % 3 = 0").select((-F.col("revision_id") - 1).alias("revision_id")), folder, 2)
    index.merge(spark, folder, 3, buckets=16)
    asked = spark.createDataFrame(list(_TRI), "query_id int, query string")
    found = lexical.substring_search(m.messages(), m.revisions(), asked, index=index.read(spark, folder))
    return found.select("query_id", "message_id", r6("score", "score"), F.col("rank").cast("long").alias("rank"))


@query(with_tables("revisions", "SELECT count(*) AS texts, (SELECT count(*) FROM tok)::BIGINT AS words, sum(greatest(0, length(lower(coalesce(text, ''))) - 2))::BIGINT AS grams FROM revisions", tok=_TOKENS))
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """Builds an index of all revisions anew: what it counts."""
    folder = f"{shared_folder(spark)}/index-built"
    index.write(Model(spark, d).revisions(), folder)
    return index.read(spark, folder).stats.agg(F.sum("n").alias("texts"), F.sum("words").alias("words"), F.sum("grams").alias("grams"))


_GOLDEN = {
    "queries": "SELECT item_id AS query_id, array_to_string(" + _WORDS.format("text") + ", ' ') AS query FROM benchmark",
    "tok": _TOKENS, "stats": _STATS, "terms": _TERMS, "hits": _HITS, "scored": _SCORED, "lex": _LEX,
    "judged": "SELECT item_id AS query_id, doc_id AS message_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "firsts": "SELECT j.query_id, min(l.rank) AS first FROM (SELECT DISTINCT query_id FROM judged) j LEFT JOIN (SELECT lex.* FROM lex JOIN judged USING (query_id, message_id)) l USING (query_id) GROUP BY 1",
}


@query(with_tables("messages revisions", "SELECT count(*) AS queries, count(*) FILTER (first <= 5) AS success_at_5, round(coalesce(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 0), 6) AS mrr_at_10 FROM firsts", **_GOLDEN))
def golden_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark items as requests to the word search, judged by the documents that carry their text: success at five and the
    mean reciprocal rank among ten, over the items that some document carries."""
    m = Model(spark, d)
    items = m.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = items.select("query_id", F.array_join(words(F.col("text")), " ").alias("query"))
    judged = m.raw("documents").select(F.col("doc_id").alias("message_id"), F.col("text").alias("_t")).join(lexical.checked_broadcast(items.filter("text IS NOT NULL")), F.contains("_t", "text")).select("query_id", "message_id")
    judged = checkpointed(judged)
    found = lexical.word_search(m.messages(), m.revisions(), asked, index=stored(m, "words")).join(judged, ["query_id", "message_id"])
    first = judged.select("query_id").distinct().join(found.groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")
    gain = F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)
    return first.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("first") <= 5).alias("success_at_5"), F.round(F.coalesce(F.avg(gain), F.lit(0.0)), 6).alias("mrr_at_10"))


@query(with_tables("messages vectors queries", "SELECT query_id, message_id, round(sim, 6) AS sim, rank FROM vec", vec=_VEC))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    shown = m.vectors().join(m.messages().filter("NOT retracted").select("message_id"), "message_id", "left_semi")
    return vectors.cosine_topk(shown, m.queries().filter("vector IS NOT NULL")).select("query_id", "message_id", r6("sim", "sim"), F.col("rank").cast("long").alias("rank"))


@query(with_tables("messages revisions attachments derivatives vectors queries", "SELECT query_id, message_id, lex_rank, vec_rank, round(rrf, 9) AS rrf FROM fused", **_FULL_CTES, vec=_VEC, fused=_RRF))
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return retrieve.relevance(corpus(m), m.queries()).select("query_id", "message_id", F.col("lex_rank").cast("long").alias("lex_rank"), F.col("vec_rank").cast("long").alias("vec_rank"), F.round("rrf", 9).alias("rrf"))


@query("WITH t AS (SELECT source AS query_id, doc_id, CAST(n_chars % 50 AS DOUBLE) AS rrf FROM documents UNION ALL SELECT 'alone', -1, 5.0) SELECT query_id, doc_id, round(" + _PCT + ", 9) AS r FROM t")
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    t = Model(spark, d).raw("documents").selectExpr("source AS query_id", "doc_id", "CAST(n_chars % 50 AS DOUBLE) AS rrf").union(spark.sql("SELECT 'alone', -1L, 5.0D"))
    return t.select("query_id", "doc_id", F.round(ranking.percentile(F.col("rrf")), 9).alias("r"))


@query(with_tables("messages", f"SELECT message_id, round(pow(2, -{_AGE} / 2160.0), 9) AS search, round(pow(2, -{_AGE} / 72.0), 9) AS digest FROM messages"))
def freshness(spark: SparkSession, d: str) -> DataFrame:
    from recall_engine.functions.values import freshness as fresh

    at = F.col("created_at")
    return Model(spark, d).messages().select("message_id", F.round(fresh(at, now(), PARAMS.half_search), 9).alias("search"), F.round(fresh(at, now(), PARAMS.half_digest), 9).alias("digest"))


@query(with_tables("messages", f"SELECT message_id, round(priority / 3.0::DOUBLE * CASE WHEN pinned OR confirmed THEN 1.0 ELSE pow(2, -{_AGE} / 60.0) END, 9) AS p, CASE WHEN pinned THEN 1.0 WHEN confirmed THEN 0.6 ELSE 0.0 END::DOUBLE AS i FROM messages"))
def priority_decay(spark: SparkSession, d: str) -> DataFrame:
    from recall_engine.functions.values import effective_priority

    p = effective_priority(F.col("priority"), F.col("created_at"), now(), F.col("pinned") | F.col("confirmed"))
    return Model(spark, d).messages().select("message_id", F.round(p, 9).alias("p"), ranking.intent(F.col("pinned"), F.col("confirmed")).alias("i"))


_PLAIN = "SELECT f.*, m.event_id, m.created_at, m.priority, m.pinned, m.confirmed, NULL AS mandatory, 0.0 AS salience, 0.0 AS novelty, 0 AS impressions FROM fused f JOIN messages m USING (message_id)"
_SHOW = "SELECT query_id, message_id, final_rank, round(r, 6) AS r, round(f, 6) AS f, round(p, 6) AS p, round(score, 6) AS score FROM ranked WHERE final_rank <= 10"


def _shown(df: DataFrame, *more) -> DataFrame:
    return df.select("query_id", "message_id", F.col("final_rank").cast("long").alias("final_rank"), r6("r", "r"), r6("f", "f"), r6("p", "p"), *more, r6("score", "score"))


@query(with_tables("messages revisions attachments derivatives vectors queries", _SHOW, **_FULL_CTES, vec=_VEC, fused=_RRF, cand=_PLAIN, ranked=_ranked(2160.0, PARAMS.search_p0, "cand")))
def search_p0(spark: SparkSession, d: str) -> DataFrame:
    """Words and vectors, fused and ranked: the first ten of each request."""
    m = Model(spark, d)
    return _shown(retrieve.search(corpus(m), m.queries(), now()))


@query(with_tables("messages revisions attachments derivatives vectors queries", _SHOW, **_FULL_CTES, fused="SELECT query_id, message_id, rank AS lex_rank, NULL AS vec_rank, 1.0::DOUBLE / (60 + rank) AS rrf FROM lex", cand=_PLAIN, ranked=_ranked(2160.0, PARAMS.search_p0, "cand")))
def search_lexical_only(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return _shown(retrieve.search(corpus(m), m.queries(), now(), lexical_only=True))


_SALIENCE = {
    "demand": """SELECT message_id, coalesce(i, 0) AS impressions, coalesce(f, 0) AS fetches FROM (SELECT message_id, count(*) AS i FROM impressions GROUP BY 1) FULL JOIN
  (SELECT message_id, count(DISTINCT coalesce(nullif(task_id, ''), nullif(principal, ''), interaction_id::VARCHAR)) AS f FROM fetches GROUP BY 1) USING (message_id)""",
    "refs": """SELECT message_id, sum(n)::BIGINT AS refs FROM (SELECT first AS message_id, count(*) AS n FROM
  (SELECT a.message_id, first_value(a.message_id) OVER (PARTITION BY object_hash ORDER BY created_at, a.message_id) AS first FROM attachments a JOIN messages USING (message_id)) WHERE message_id <> first GROUP BY 1) GROUP BY 1""",
    "once": f"""SELECT principal, message_id, created_at, weight, (epoch_us({_NOW}) - epoch_us(created_at)) / 3.6e9::DOUBLE AS age FROM signals
  QUALIFY row_number() OVER (PARTITION BY principal, message_id, kind ORDER BY greatest(age, 0), weight DESC) = 1""",
    "valued": "SELECT principal, message_id, strftime(created_at, '%Y-%m-%d') AS day, CASE WHEN weight <= 0 THEN 1 ELSE least(weight, 3) END * 0.3::DOUBLE * pow(2, -greatest(age, 0) / 720.0) AS w FROM once",
    "weights": "SELECT message_id, sum(CASE WHEN total > 5.0 THEN w * 5.0 / total ELSE w END) AS weight FROM (SELECT *, sum(w) OVER (PARTITION BY principal, day) AS total FROM valued) GROUP BY 1",
    "sal": """SELECT message_id, coalesce(impressions, 0) AS impressions, least(1.0, greatest(0.0, 0.5::DOUBLE * least(1.0, greatest(0.0, CASE WHEN coalesce(impressions, 0) < 5 AND (coalesce(fetches, 0) + 1.0::DOUBLE) / (coalesce(impressions, 0) + 5) < 0.2
  THEN 0.2::DOUBLE ELSE (coalesce(fetches, 0) + 1.0::DOUBLE) / (coalesce(impressions, 0) + 5) END)) + 0.3::DOUBLE * (1 - pow(2, -coalesce(refs, 0) / 3.0::DOUBLE)) + 0.2::DOUBLE * (1 - pow(2, -coalesce(weight, 0) / 5.0::DOUBLE)))) AS salience,
  pow(2, -coalesce(impressions, 0) / 8.0::DOUBLE) AS novelty FROM demand FULL JOIN refs USING (message_id) FULL JOIN weights USING (message_id)""",
}
_SAL_TABLES = "messages interactions impressions fetches signals attachments"


def salient(m: Model) -> DataFrame:
    demands = salience.demand(m.impressions(), m.fetches())
    refs = salience.reference_in_degree(m.messages(), m.attachments())
    out = salience.salience(demands, refs, salience.effective_signals(m.signals(), now()))
    return out.join(demands.select("message_id", "impressions"), "message_id", "left").withColumn("impressions", F.coalesce("impressions", F.lit(0)))


@query(with_tables("interactions impressions fetches", "SELECT message_id, impressions::BIGINT AS impressions, fetches::BIGINT AS fetches FROM demand", demand=_SALIENCE["demand"]))
def demand(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return salience.demand(m.impressions(), m.fetches())


@query(with_tables("signals", "SELECT message_id, round(weight, 6) AS weight FROM weights", once=_SALIENCE["once"], valued=_SALIENCE["valued"], weights=_SALIENCE["weights"]))
def signal_weights(spark: SparkSession, d: str) -> DataFrame:
    return salience.effective_signals(Model(spark, d).signals(), now()).select("message_id", r6("weight", "weight"))


@query(with_tables("signals", "SELECT message_id, sum(coalesce(weight, 1))::BIGINT AS weight FROM signals GROUP BY 1"))
def signal_sums(spark: SparkSession, d: str) -> DataFrame:
    return salience.signal_sums(Model(spark, d).signals())


@query(
    with_tables(
        "turns",
        "SELECT message_id, sum(n)::BIGINT AS refs FROM (SELECT reply_to AS message_id, count(*) AS n FROM turns WHERE reply_to IS NOT NULL GROUP BY 1 UNION ALL SELECT first, count(*) FROM (SELECT a.message_id, first_value(a.message_id) OVER (PARTITION BY object_hash ORDER BY created_at, a.message_id) AS first FROM att a JOIN turns USING (message_id)) WHERE message_id <> first GROUP BY 1) GROUP BY 1",
        att="SELECT message_id, message_id % 7 AS object_hash FROM turns",
    )
)
def ref_indegree(spark: SparkSession, d: str) -> DataFrame:
    t = Model(spark, d).turns()
    return salience.reference_in_degree(t, t.select("message_id", (F.col("message_id") % 7).alias("object_hash")))


@query(with_tables(_SAL_TABLES, "SELECT message_id, round(salience, 6) AS salience, round(novelty, 6) AS novelty FROM sal", **_SALIENCE))
def salience_scores(spark: SparkSession, d: str) -> DataFrame:
    return salient(Model(spark, d)).select("message_id", r6("salience", "salience"), r6("novelty", "novelty"))


_P2 = "SELECT f.*, m.event_id, m.created_at, m.priority, m.pinned, m.confirmed, NULL AS mandatory, salience, novelty, impressions FROM fused f JOIN messages m USING (message_id) LEFT JOIN sal USING (message_id)"


@query(
    with_tables(
        _SAL_TABLES + " revisions derivatives vectors queries",
        "SELECT query_id, message_id, final_rank, round(r, 6) AS r, round(f, 6) AS f, round(p, 6) AS p, round(s, 6) AS s, round(n, 6) AS n, round(score, 6) AS score FROM placed WHERE place <= 10",
        **_FULL_CTES, vec=_VEC, fused=_RRF, **_SALIENCE, cand=_P2, ranked=_ranked(2160.0, PARAMS.search_p2, "cand"),
        marked="SELECT *, final_rank > 9 AND coalesce(impressions, 0) < 5 AS fresh FROM ranked",
        counted="SELECT *, sum(fresh::INT) OVER (PARTITION BY query_id ORDER BY final_rank) AS nth FROM marked",
        placed="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN final_rank <= 9 THEN 0 WHEN fresh AND nth <= 1 THEN 1 ELSE 2 END, final_rank) AS place FROM counted",
    )
)
def search_p2(spark: SparkSession, d: str) -> DataFrame:
    """With salience, intent and novelty, and a tenth of the places for what few have seen."""
    m = Model(spark, d)
    return _shown(retrieve.search(corpus(m, salient(m)), m.queries(), now(), weights=PARAMS.search_p2, quota=True), r6("s", "s"), r6("n", "n"))


@query(
    """WITH ranked AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS final_rank, doc_id % 9 AS impressions FROM documents),
counted AS (SELECT *, final_rank > 18 AND impressions < 5 AS fresh, sum((final_rank > 18 AND impressions < 5)::INT) OVER (PARTITION BY query_id ORDER BY final_rank) AS nth FROM ranked)
SELECT query_id, doc_id, final_rank FROM counted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN final_rank <= 18 THEN 0 WHEN fresh AND nth <= 2 THEN 1 ELSE 2 END, final_rank) <= 20"""
)
def exploration_quota(spark: SparkSession, d: str) -> DataFrame:
    t = Model(spark, d).raw("documents").selectExpr("source AS query_id", "doc_id", "row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS final_rank", "doc_id % 9 AS impressions")
    return ranking.exploration_quota(t, 20, F.col("impressions")).select("query_id", "doc_id", F.col("final_rank").cast("long").alias("final_rank"))


@query(
    """WITH t AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS final_rank, rtrim(left(text, 200), chr(10)) AS rendered FROM documents),
r AS (SELECT *, sum(length(rendered)) OVER w + 20 AS running, final_rank = max(final_rank) OVER (PARTITION BY query_id) AS last FROM t WINDOW w AS (PARTITION BY query_id ORDER BY final_rank ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (running + CASE WHEN last THEN 0 ELSE 10 END <= 2500)::INT AS fits FROM r)
SELECT query_id, doc_id, final_rank, running::BIGINT AS running_chars, min(fits) OVER (PARTITION BY query_id ORDER BY final_rank ROWS UNBOUNDED PRECEDING) = 1 AS included FROM f"""
)
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    t = Model(spark, d).raw("documents").select(F.col("source").alias("query_id"), "doc_id", F.expr("row_number() OVER (PARTITION BY source ORDER BY doc_id)").cast("long").alias("final_rank"), snippet(F.col("text")).alias("rendered"))
    return ranking.within_budget(t, 2500, header_chars=20).select("query_id", "doc_id", "final_rank", "running_chars", "included")


_MEMBERS = """SELECT query_id, message_id, CASE min(c) WHEN 0 THEN 'recipient' WHEN 1 THEN 'pin' END AS mandatory FROM (
  SELECT query_id, l.message_id, 3 AS c FROM (SELECT query_id, unnest(topics) AS topic_id FROM views) v JOIN links l USING (topic_id) JOIN messages m ON m.message_id = l.message_id WHERE NOT l.removed AND NOT m.retracted
  UNION ALL SELECT query_id, message_id, 0 FROM views JOIN messages ON recipient = view WHERE NOT retracted
  UNION ALL SELECT query_id, message_id, 1 FROM views, messages WHERE pinned AND NOT retracted) GROUP BY 1, 2"""


@query(with_tables("messages links views", "SELECT * FROM members", members=_MEMBERS))
def digest_mandatory(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return retrieve.digest_candidates(m.messages(), m.links(), m.views())


@query(
    with_tables(
        "messages revisions attachments derivatives vectors links views",
        "SELECT query_id, message_id, final_rank, mandatory, round(r, 6) AS r, round(f, 6) AS f, round(score, 6) AS score FROM (SELECT * FROM ranked UNION ALL SELECT * FROM silent)",
        queries="SELECT * FROM views WHERE query IS NOT NULL", **_FULL_CTES, vec=_VEC, fused=_RRF, members=_MEMBERS,
        cand="SELECT b.*, coalesce(rrf, 0) AS rrf, m.event_id, m.created_at, m.priority, m.pinned, m.confirmed, 0.0 AS salience, 0.0 AS novelty FROM members b LEFT JOIN fused USING (query_id, message_id) JOIN messages m USING (message_id)",
        asked="SELECT * FROM cand WHERE query_id IN (SELECT query_id FROM queries)", quiet="SELECT * FROM cand WHERE query_id NOT IN (SELECT query_id FROM queries)",
        ranked=_ranked(72.0, PARAMS.digest_p0, "asked"), silent=_ranked(72.0, PARAMS.digest_p0, "quiet", uniform=True),
    )
)
def digest_p0(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return retrieve.digest(corpus(m), m.views(), m.links(), now()).select("query_id", "message_id", F.col("final_rank").cast("long").alias("final_rank"), "mandatory", r6("r", "r"), r6("f", "f"), r6("score", "score"))


@query(
    with_tables(
        _SAL_TABLES + " revisions derivatives vectors links views",
        "SELECT query_id, message_id, final_rank, round(r, 6) AS r, round(s, 6) AS s, round(n, 6) AS n, round(score, 6) AS score FROM (SELECT * FROM ranked UNION ALL SELECT * FROM silent)",
        queries="SELECT * FROM views WHERE query IS NOT NULL", **_FULL_CTES, vec=_VEC, fused=_RRF, members=_MEMBERS, **_SALIENCE,
        cand="SELECT b.*, coalesce(rrf, 0) AS rrf, m.event_id, m.created_at, m.priority, m.pinned, m.confirmed, salience, novelty FROM members b LEFT JOIN fused USING (query_id, message_id) JOIN messages m USING (message_id) LEFT JOIN sal USING (message_id)",
        asked="SELECT * FROM cand WHERE query_id IN (SELECT query_id FROM queries)", quiet="SELECT * FROM cand WHERE query_id NOT IN (SELECT query_id FROM queries)",
        ranked=_ranked(72.0, PARAMS.digest_p2, "asked"), silent=_ranked(72.0, PARAMS.digest_p2, "quiet", uniform=True),
    )
)
def digest_p2(spark: SparkSession, d: str) -> DataFrame:
    """A digest ranked with salience, intent and novelty."""
    m = Model(spark, d)
    out = retrieve.digest(corpus(m, salient(m)), m.views(), m.links(), now(), weights=PARAMS.digest_p2)
    return out.select("query_id", "message_id", F.col("final_rank").cast("long").alias("final_rank"), r6("r", "r"), r6("s", "s"), r6("n", "n"), r6("score", "score"))


@query(with_tables("turns", "SELECT query_id, message_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at, message_id) AS final_rank FROM (SELECT message_id AS query_id, message_id AS root FROM turns WHERE thread_id IS NULL) JOIN (SELECT message_id, created_at, coalesce(thread_id, message_id) AS root FROM turns) USING (root)"))
def thread_expand(spark: SparkSession, d: str) -> DataFrame:
    t = Model(spark, d).turns()
    roots = t.filter("thread_id IS NULL").select(F.col("message_id").alias("query_id"), F.col("message_id").alias("root"))
    return retrieve.threads(t, roots).select("query_id", "message_id", F.col("final_rank").cast("long").alias("final_rank"))


@query(with_tables("messages revisions attachments derivatives vectors queries", "SELECT query_id, message_id, true AS exact, round(score, 6) AS score FROM ranked WHERE final_rank <= 10", **_FULL_CTES, vec=_VEC, fused=_RRF, cand=_PLAIN, ranked=_ranked(2160.0, PARAMS.search_p0, "cand")))
def explain_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Scores come back exactly from what was written down of them."""
    m = Model(spark, d)
    hits = retrieve.search(corpus(m), m.queries(), now()).withColumn("components", ranking.explanation(PARAMS.search_p0))
    return ranking.recompute(hits.select("query_id", "message_id", "components")).select("query_id", "message_id", "exact", r6("recomputed", "score"))


@query(with_tables("messages revisions attachments derivatives vectors queries", "SELECT query_id, message_id, term, round(value, 6) AS value, round(value * weight, 6) AS product FROM (SELECT query_id, message_id, unnest([{'term': 'r', 'value': r, 'weight': 0.9::DOUBLE}, {'term': 's', 'value': 0.0, 'weight': 0.0}, {'term': 'f', 'value': f, 'weight': 0.07}, {'term': 'p', 'value': p, 'weight': 0.03}, {'term': 'i', 'value': i, 'weight': 0.0}, {'term': 'n', 'value': 0.0, 'weight': 0.0}], recursive := true) FROM ranked WHERE final_rank <= 10)", **_FULL_CTES, vec=_VEC, fused=_RRF, cand=_PLAIN, ranked=_ranked(2160.0, PARAMS.search_p0, "cand")))
def why_ranked(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    hits = retrieve.search(corpus(m), m.queries(), now()).withColumn("components", ranking.explanation(PARAMS.search_p0))
    return ranking.why_ranked(hits.select("query_id", "message_id", "components")).select("query_id", "message_id", "term", r6("value", "value"), r6("product", "product"))


@query(with_tables("messages links", "SELECT m.message_id FROM messages m WHERE sender IN ('src1') AND EXISTS (SELECT 1 FROM links l WHERE l.message_id = m.message_id AND NOT removed AND topic_id IN ('en', 'de'))"))
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return lookups.scope_messages(m.messages(), m.links(), ["en", "de"], "src1")


@query(with_tables("messages revisions attachments derivatives vectors queries", _SHOW, **({"wide" if k == "lex" else k: v for k, v in _FULL_CTES.items()} | {"lex": "SELECT query_id, message_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM wide JOIN messages USING (message_id) WHERE sender = 'src1'"}),
    vec=_VEC.replace("NOT retracted AND", "NOT retracted AND sender = 'src1' AND"), fused=_RRF, cand=_PLAIN, ranked=_ranked(2160.0, PARAMS.search_p0, "cand")))
def search_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The scope cuts the word list after its first hundred, the vector list before."""
    m = Model(spark, d)
    return _shown(retrieve.search(corpus(m), m.queries(), now(), scope=lookups.scope_messages(m.messages(), m.links(), sender="src1")))
