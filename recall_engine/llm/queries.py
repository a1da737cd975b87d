"""The queries of the text-preparation operators, each over its whole table, and SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm import chat_format as chat

    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    messages = said.unionByName(own).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digest(chat.format_chat(messages))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.exact_dedup import exact_dedup_lower

    return exact_dedup_lower(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm import language_id as lid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lid.train(docs.filter(~lid.held_out()), order=F.xxhash64("doc_id"))
    return lid.identify(docs, model, keep=("doc_id",), spans=False).select("doc_id", lid.held_out().alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.sentencepiece_codec import encode_tokens

    return encode_tokens(table(spark, sf_dir, "documents"), outputs=False)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.vp_tree import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 20 = 0"), k=20, factor=1.0)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm import conversation_repair as repair

    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(repair.damaged(said), said)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.importance import resample

    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recall_engine.llm.minhash_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_exact_dedup,
        op3_language_id,
        op4_line_dedup,
        op5_sentencepiece,
        op6_packing,
        op7_html_extraction,
        op8_token_counts,
        op9_nearest_neighbours,
        op10_ngram_jaccard_join,
        op11_conversation_repair,
        op12_importance_resampling,
        op13_minhash_near_dedup,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op1_chat_formatting": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g') AS t FROM said
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>' || r || '<|body|>' || t || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op2_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS n FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)""",
    "op4_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT r, line, pos, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT k.r, count(f.key) AS n_dropped, string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (f.key IS NULL) AS kept FROM k LEFT JOIN f USING (key) GROUP BY k.r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN g USING (r)""",
    "op9_nearest_neighbours": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
