"""Lexical retrieval: an inverted index of words with positions, BM25, substrings, and their union.

All operators take a table of queries and answer them in one job. Statistics count every indexed revision; what is
not a head, or is retracted, is left out afterwards by a semi join, as a store does that never removes from its index.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions.text import words
from recall_engine.params import PARAMS, Params
from recall_engine.sources.files import checkpointed

if TYPE_CHECKING:
    from recall_engine.operators.index import Index


def checked_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A stated, small table marked for broadcast, if it has no more rows than that; else as it is. Spark's own estimate
    can't be relied on here: that of an exploded text is too low, and would send the index to every task instead."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def postings(texts: DataFrame, id_col: str = "revision_id", text_col: str = "text") -> DataFrame:
    """(id_col, doc_len, pos, term): every word of every text. Written out sorted by term, it is the index."""
    each = texts.select(id_col, words(F.col(text_col)).alias("_w"))
    # the outer form, since for the other one Spark would find the words once more to filter by their number
    return each.select(id_col, F.size("_w").alias("doc_len"), F.posexplode_outer("_w").alias("pos", "term")).filter("term IS NOT NULL")


def collection_stats(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_docs, avg_len over all texts, those without words included."""
    return texts.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(words(F.col(text_col)))).alias("_words")).select("n_docs", (F.col("_words") / F.col("n_docs")).alias("avg_len"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, offset, term, phrase_len, phrases): white space cuts a query into phrases, all of which must
    occur; a phrase is the words of its term, next to each other."""
    phrases = queries.select("query_id", F.posexplode(F.filter(F.split("query", r"\s+", -1), lambda x: x != "")).alias("phrase", "_t")).withColumn("_w", words(F.col("_t"))).filter(F.size("_w") > 0)
    return phrases.withColumn("phrases", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).select("query_id", "phrase", F.size("_w").alias("phrase_len"), "phrases", F.posexplode("_w").alias("offset", "term"))


def document_frequency(tf: DataFrame, id_col: str) -> DataFrame:
    """(query_id, phrase, df). It reads all columns of the counts, so that Spark makes them once for both their uses."""
    read = [F.min("tf").alias("_least"), F.max("phrases").alias("_phrases"), F.max("doc_len").alias("_len"), F.max(id_col).alias("_id")]
    counted = tf.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("df"), *read)
    return counted.filter("_least > 0 AND _phrases > 0 AND _len >= 0 AND (_id IS NOT NULL OR df > 0)").select("query_id", "phrase", "df")


def summed(scored: DataFrame, id_col: str) -> DataFrame:
    """(query_id, id_col, score) of texts that have all phrases of a query. The sum goes in the order of the phrases, so that
    equal texts score alike to the last bit, and ties are ties."""
    parts = scored.groupBy("query_id", id_col, "phrases").agg(F.array_sort(F.collect_list(F.struct("phrase", "_s"))).alias("_p")).filter(F.size("_p") == F.col("phrases"))
    return parts.select("query_id", id_col, (-F.aggregate("_p", F.lit(0.0), lambda t, x: t + x["_s"])).alias("score"))


def phrase_counts(index: DataFrame, wanted: DataFrame, id_col: str = "revision_id") -> DataFrame:
    """(query_id, phrase, phrases, id_col, doc_len, tf): how often each phrase stands in each text. index: rows of ``postings``."""
    hits = index.join(checked_broadcast(wanted), "term").withColumn("_start", F.col("pos") - F.col("offset"))
    runs = hits.groupBy("query_id", "phrase", "phrase_len", "phrases", id_col, "doc_len", "_start").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == F.col("phrase_len"))
    return runs.groupBy("query_id", "phrase", "phrases", id_col, "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame | Index, stats: DataFrame, queries: DataFrame, id_col: str = "revision_id", p: Params = PARAMS) -> DataFrame:
    """(query_id, id_col, score): less is better. All phrases of a query must occur. index: rows of ``postings``, or a stored index."""
    if isinstance(index, DataFrame):
        tf = phrase_counts(index, query_phrases(queries), id_col).repartition(id_col)
        tf = tf.join(document_frequency(tf, id_col), ["query_id", "phrase"])
    else:
        tf = index.matched(queries)
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(p.least_idf)).otherwise(raw)
    norm = F.col("tf") + F.lit(p.k1) * (F.lit(1 - p.b) + F.lit(p.b) * F.col("doc_len") / F.col("avg_len"))
    scored = tf.crossJoin(F.broadcast(stats)).withColumn("_s", idf * F.col("tf") * (p.k1 + 1) / norm)
    # what is summed of a text comes together by the text alone, as narrow rows, and stays there
    return summed(scored.select("query_id", "phrase", "phrases", id_col, "_s").repartition(id_col), id_col)


def top_per_query(scored: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query, with their rank."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def word_search(messages: DataFrame, revisions: DataFrame, queries: DataFrame, k: int = PARAMS.candidates, include_retracted: bool = False, p: Params = PARAMS, index: Index | None = None) -> DataFrame:
    """(query_id, message_id, score, rank) over head revisions. messages: message_id, head_revision_id, retracted;
    revisions: revision_id, message_id, text. A stored index of the revisions is asked in place of their texts."""
    held, stats = (postings(revisions), collection_stats(revisions)) if index is None else (index, index.word_stats())
    scored = bm25(held, stats, queries, p=p)
    heads = messages if include_retracted else messages.filter(~F.col("retracted"))
    heads = heads.select("message_id", F.col("head_revision_id").alias("revision_id"))
    return top_per_query(scored.join(heads, "revision_id"), k, "score", "message_id").select("query_id", "message_id", "score", "rank")


def substring_search(messages: DataFrame, revisions: DataFrame, queries: DataFrame, k: int = PARAMS.candidates, include_retracted: bool = False, least: int = 3, p: Params = PARAMS, index: Index | None = None) -> DataFrame:
    """(query_id, message_id, score, rank): every term of at least three code points occurs in the text, whatever
    the case; BM25 over occurrences, with the number of trigrams as length. Accents count. A stored index of the revisions
    finds the texts that have a rare term's trigrams; without one, or without trigrams in it, every text is searched."""
    terms = queries.select("query_id", F.posexplode(F.filter(F.split(F.lower("query"), r"\s+", -1), lambda x: F.char_length(x) >= least)).alias("phrase", "term"))
    terms = terms.withColumn("phrases", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    # occurrences may overlap, as those of a phrase of trigrams do; only those of a term that ends as it begins can
    selfish = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("term") - 1)), lambda i: F.left("term", i) == F.right("term", i)) & (F.char_length("term") > 1)
    at_each = F.concat(F.lit("(?=\\Q"), F.replace(F.col("term"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    terms = terms.withColumns({"_selfish": selfish, "_at_each": at_each})
    if index is None:
        low = F.lower(F.coalesce("text", F.lit("")))
        texts = revisions.select("revision_id", low.alias("_low"), F.greatest(F.lit(0), F.char_length(low) - 2).alias("doc_len"))
        stats = texts.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
        found = texts.join(checked_broadcast(terms), F.contains("_low", "term"))
    else:
        stats, found = index.text_stats(), index.candidates(terms).filter(F.contains("_low", "term"))
    plain = F.floor((F.octet_length("_low") - F.octet_length(F.replace(F.col("_low"), F.col("term"), F.lit("")))) / F.octet_length("term"))
    tf = found.withColumn("tf", F.when(F.col("_selfish"), F.regexp_count("_low", F.col("_at_each"))).otherwise(plain).cast("long"))
    tf = tf.select("query_id", "phrase", "phrases", "revision_id", "doc_len", "tf").repartition("revision_id")  # made once for both uses
    tf = tf if index is None else checkpointed(tf)
    df = document_frequency(tf, "revision_id")
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(p.least_idf)).otherwise(raw)
    norm = F.col("tf") + F.lit(p.k1) * (F.lit(1 - p.b) + F.lit(p.b) * F.col("doc_len") / F.col("avg_len"))
    scored = tf.join(df, ["query_id", "phrase"]).crossJoin(F.broadcast(stats)).withColumn("_s", idf * F.col("tf") * (p.k1 + 1) / norm)
    scored = summed(scored, "revision_id")
    heads = messages if include_retracted else messages.filter(~F.col("retracted"))
    heads = heads.select("message_id", F.col("head_revision_id").alias("revision_id"))
    return top_per_query(scored.join(heads, "revision_id"), k, "score", "message_id").select("query_id", "message_id", "score", "rank")


def derivative_search(messages: DataFrame, attachments: DataFrame, derivatives: DataFrame, queries: DataFrame, k: int = PARAMS.candidates, include_retracted: bool = False, index: Index | None = None) -> DataFrame:
    """(query_id, message_id, rank): messages with an attachment whose extracted text has all words; by message id.
    derivatives: derivative_id, object_hash, status, invalidated, text. A stored index of the derivatives is asked in place of
    their texts; those that have been invalidated since are left out."""
    live = derivatives.filter((F.col("status") == "ok") & ~F.col("invalidated"))
    held, stats = (postings(live, "derivative_id"), collection_stats(live)) if index is None else (index, index.word_stats())
    hit = bm25(held, stats, queries, "derivative_id").join(live.select("derivative_id", "object_hash"), "derivative_id").join(attachments.select("message_id", "object_hash"), "object_hash")
    shown = messages if include_retracted else messages.filter(~F.col("retracted"))
    found = hit.join(shown.select("message_id"), "message_id", "left_semi").select("query_id", "message_id").distinct()
    return top_per_query(found, k, "message_id")


def ordered_union(*sources: DataFrame, k: int = PARAMS.candidates) -> DataFrame:
    """(query_id, message_id, source, rank): the first source's rows, then what the next ones add, at most k a query.
    Each source has query_id, message_id and rank."""
    tagged = [s.select("query_id", "message_id", F.lit(i).alias("source"), F.col("rank").alias("_r")) for i, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    first = every.groupBy("query_id", "message_id").agg(F.min(F.struct("source", "_r")).alias("_at"))
    return top_per_query(first, k, "_at.source", "_at._r", "message_id").select("query_id", "message_id", F.col("_at.source").alias("source"), "rank")
