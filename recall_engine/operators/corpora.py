"""Evaluation corpora: validation, splits, miners, and plain baselines to compare with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from recall_engine.functions.text import split_terms
from recall_engine.functions.values import in_holdout
from recall_engine.operators.order import running
from recall_engine.params import PARAMS, Params


def validate(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(problem, id): ids that repeat, and judgments that name no item."""
    twice = lambda df, what: df.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.lit(what).alias("problem"), "id")
    judged = queries.select(F.col("id").alias("_q"), F.explode("relevant").alias("id"))
    lost = judged.join(items.select("id"), "id", "left_anti").select(F.lit("unknown item").alias("problem"), F.col("_q").alias("id")).distinct()
    none = queries.filter(F.size(F.coalesce("relevant", F.array().cast("array<string>"))) <= 0).select(F.lit("no judgment").alias("problem"), "id")
    return twice(items, "item repeats").unionByName(twice(queries, "query repeats")).unionByName(lost).unionByName(none)


def assign_splits(queries: DataFrame, salt: str, share: int = PARAMS.split_share) -> DataFrame:
    """Queries with split: dev or holdout, by a hash of salt and id."""
    return queries.withColumn("split", F.when(in_holdout(F.lit(salt), F.col("id").cast("string"), share), "holdout").otherwise("dev"))


def mine_duplicates(issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, queries, counts) from issues: id, title, body, duplicate_of. A duplicate asks for its canonical issue; where
    that is a duplicate itself, the chain is dropped and counted, as are those whose canonical issue is not there."""
    dup = issues.filter(F.col("duplicate_of").isNotNull())
    targets = issues.select(F.col("id").alias("duplicate_of"), F.col("duplicate_of").alias("_next"), F.lit(True).alias("_there"))
    seen = dup.join(targets, "duplicate_of", "left").withColumn("_why", F.when(F.col("_there").isNull(), "missing").when(F.col("_next").isNotNull(), "chain").otherwise("kept"))
    kept = seen.filter("_why = 'kept'")
    queries = kept.select("id", F.col("title").alias("query"), F.array("duplicate_of").alias("relevant"), F.lit("duplicate").alias("label_kind"))
    items = issues.join(kept.select(F.col("duplicate_of").alias("id")), "id", "left_semi").select("id", "title", "body")
    return items, queries, seen.groupBy(F.col("_why").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def mine_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, queries) from questions: id, title, body, originals. A closed question asks for all its originals that are
    there and aren't closed as duplicates themselves."""
    open_ = questions.filter(F.size(F.coalesce("originals", F.array().cast("array<string>"))) <= 0)
    pairs = questions.select("id", "title", F.explode("originals").alias("_o")).join(open_.select(F.col("id").alias("_o")), "_o", "left_semi")
    queries = pairs.groupBy("id", F.col("title").alias("query")).agg(F.array_sort(F.collect_set("_o")).alias("relevant")).withColumn("label_kind", F.lit("duplicate"))
    return open_.join(pairs.select(F.col("_o").alias("id")), "id", "left_semi").select("id", "title", "body"), queries


def mine_links(docs: DataFrame, least: int = 8) -> DataFrame:
    """(id, query, relevant) from Markdown files: path, text. The text of a link to another file asks for that file, if it is
    long enough to mean something."""
    found = docs.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\[[^\]\n]+\]\([^)\s]+\.md(?:#[^)\s]*)?\))"), F.lit(1))).alias("_i", "_l"))
    parts = found.select("path", "_i", F.trim(F.regexp_extract("_l", r"\[([^\]]+)\]", 1)).alias("query"), F.regexp_extract("_l", r"\(([^)#]+)", 1).alias("_t"))
    folder = F.regexp_extract("path", r"\A(.*/)?", 0)
    target = F.regexp_replace(F.concat(folder, F.regexp_replace("_t", r"\A\./", "")), r"[^/]+/\.\./", "")
    asked = parts.filter(F.char_length("query") >= least).withColumn("_target", target)
    known = asked.join(docs.select(F.col("path").alias("_target")), "_target", "left_semi").filter(F.col("_target") != F.col("path"))
    return known.select(F.concat_ws("#", "path", "_i").alias("id"), "query", F.array("_target").alias("relevant"))


def no_memory(queries: DataFrame) -> DataFrame:
    """The baseline that finds nothing."""
    return queries.select("query_id", F.lit(None).cast("string").alias("id"), F.lit(0).alias("rank")).filter(F.lit(False))


#: Texts that are counted at once, and tokens whose terms a task remembers.
_COUNTED, _KNOWN = 256, 500_000


def _inside(token: str, terms: dict[str, int], lengths: list[int]) -> list[int]:
    """The terms that a token has, as a whole or within."""
    found = set()
    for n in lengths:
        if n > len(token):
            break
        for i in range(len(token) - n + 1):
            if (t := terms.get(token[i : i + n])) is not None:
                found.add(t)
    return sorted(found)


def _lists(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists as one, with where each begins."""
    return np.array([x for one in each for x in one], np.int64), np.concatenate([[0], np.cumsum([len(one) for one in each])]).astype(np.int64)


def _through(row: np.ndarray, key: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, key) with each member of the key's list in place of the key."""
    n = at[key + 1] - at[key]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n), flat[np.repeat(at[key], n) + place]


def _once(row: np.ndarray, key: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort(row * many + key)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both // many, both % many


def _scan(items: DataFrame, queries: DataFrame, k: int, *order: Column) -> DataFrame:
    """Items with all terms of a query, in an order; where there is none, items with any.

    A term has letters and digits alone, so it stands in a text if it stands in one of the text's runs of these. A run is looked up
    once by its parts, whatever the number of queries, and of the items that have some terms those are left out whose query is known
    to have an item with all."""
    asked = queries.select("query_id", split_terms(F.col("query")).alias("_terms"))
    stated = [(r["query_id"], r["_terms"] or []) for r in asked.collect()]  # as many rows as there are requests
    terms: dict[str, int] = {}
    wanted = [[terms.setdefault(t, len(terms)) for t in own] for _, own in stated]
    lengths = sorted({len(t) for t in terms})
    askers: list[list[int]] = [[] for _ in terms]
    for q, own in enumerate(wanted):
        for t in own:
            askers[t].append(q)
    of_term, need, queried = _lists(askers), np.array([len(x) for x in wanted], np.int64), len(stated)
    kept = [c for c in items.columns if c != "text"]
    id_type = queries.schema["query_id"].dataType
    arrow_type = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, known = np.zeros(queried, bool), {}
        ids = pa.array([q for q, _ in stated], arrow_type)
        for b in batches:
            listed = b.column(b.num_columns - 1)
            coded = listed.flatten().dictionary_encode()
            held = []
            for token in coded.dictionary.to_pylist():
                if (one := known.get(token)) is None:
                    one = _inside(token, terms, lengths)
                    if len(known) < _KNOWN:
                        known[token] = one
                held.append(one)
            of_token, codes = _lists(held), np.asarray(coded.indices).astype(np.int64)
            sizes = np.diff(np.asarray(listed.offsets)) if listed.null_count == 0 else np.array([len(x) if x is not None else 0 for x in listed.to_pylist()])
            ends = np.cumsum(sizes)
            for first in range(0, b.num_rows, _COUNTED):
                n = min(_COUNTED, b.num_rows - first)
                doc = np.repeat(np.arange(n), sizes[first : first + n])
                doc, code = _once(doc, codes[ends[first] - sizes[first] : ends[first + n - 1]], max(1, len(held)))
                doc, term = _once(*_through(doc, code, *of_token), max(1, len(terms)))
                doc, query = _through(doc, term, *of_term)
                count = np.bincount(doc * queried + query, minlength=n * queried).reshape(n, queried)
                every = (count == need) & (need > 0)
                whole |= every.any(0)
                doc, query = np.nonzero(np.where(whole, every, count > 0))
                at = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(every[doc, query]), *[b.column(i).take(at) for i in range(len(kept))]], names=["query_id", "_all", *kept])

    tokens = F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+", -1)
    cut = items.filter("text IS NOT NULL").select(*kept, tokens.alias("_tokens"))
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("_all", T.BooleanType()), *[items.schema[c] for c in kept]])
    if not terms:
        return items.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(0)).select("query_id", "id", "rank")
    # the best with all and the best with some terms, of which Spark takes a few before they travel
    best = cut.mapInArrow(run, out).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_all").orderBy(*order))).filter(F.col("rank") <= k)
    best = best.withColumn("_some", F.bool_or("_all").over(Window.partitionBy("query_id")))
    return best.filter(F.col("_all") | ~F.col("_some")).select("query_id", "id", "rank")


#: Bytes by which a passage is looked for, and bits of a table of where it may begin.
_HEAD, _BITS = 8, 20


def holders(items: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, id) of the items (id, text) that hold a whole passage (query_id, text). All places of a text are looked up at once by the
    eight bytes that stand there, and passages are compared in full where these may be theirs; shorter ones are looked for each."""
    stated = [(r["query_id"], r["text"].encode()) for r in passages.filter("text IS NOT NULL").select("query_id", "text").collect()]  # as many as there are requests
    id_type = passages.schema["query_id"].dataType
    arrow_type = to_arrow_type(id_type)
    slot = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)
    short = [q for q, (_, p) in enumerate(stated) if len(p) < _HEAD]
    heads: dict[int, list[int]] = {}
    for q, (_, p) in enumerate(stated):
        if len(p) >= _HEAD:
            heads.setdefault(int.from_bytes(p[:_HEAD], "little"), []).append(q)
    listed = np.array(sorted(heads), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array([q for q, _ in stated], arrow_type)
        table = np.zeros(1 << _BITS, bool)
        table[slot(listed)] = True
        for b in batches:
            found: list[tuple[int, int]] = []
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                found += [(q, i) for q in short if stated[q][1] in text]
                if len(text) < _HEAD or not len(listed):
                    continue
                own: set[int] = set()
                for shift in range(_HEAD):
                    n = (len(text) - shift) // _HEAD
                    here = np.frombuffer(text, "<u8", n, shift) if n > 0 else np.zeros(0, np.uint64)
                    at = np.flatnonzero(table[slot(here)])
                    for k in at.tolist():
                        for q in heads.get(int(here[k]), ()):
                            if q not in own and text.startswith(stated[q][1], shift + k * _HEAD):
                                own.add(q)
                found += [(q, i) for q in sorted(own)]
            q, i = ([x[c] for x in found] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q, pa.int64())), b.column(0).take(pa.array(i, pa.int64()))], names=["query_id", "id"])

    out = T.StructType([T.StructField("query_id", id_type), items.schema["id"]])
    return items.filter("text IS NOT NULL").select("id", "text").mapInArrow(run, out)


def grep(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """A search through files: items (id, text) in order of id. queries are a stated, small set."""
    return _scan(items, queries, k, F.col("id"))


def notes(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """A search through notes, the newest first: items (id, text, created_at)."""
    return _scan(items, queries, k, F.desc("created_at"), F.desc("id"))


def notes_tail(items: DataFrame, budget: int) -> DataFrame:
    """The newest notes that fit the budget, read as one file from its end: id, created_at, running. items: id, title, text,
    created_at. What is put in order, by ranges, are ids, times and lengths."""
    cost = F.char_length(F.concat(F.col("id").cast("string"), F.lit(": "), "title", F.lit("\n"), "text", F.lit("\n\n")))
    sized = running(items.select("id", "created_at", cost.alias("_cost")), "_cost", [F.desc("created_at"), F.desc("id")], name="running")
    return sized.filter(F.col("running") <= budget).select("id", "created_at", "running")


def scores(results: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(queries, success, mrr, recall) of ranked results: query_id, id, rank; judged by queries: query_id, relevant."""
    judged = queries.select("query_id", "relevant", F.size("relevant").alias("_m"))
    hits = results.join(judged, "query_id").filter(F.array_contains("relevant", F.col("id")) & (F.col("rank") <= k)).groupBy("query_id").agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_hits"))
    every = judged.join(hits, "query_id", "left")
    return every.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("_first").isNotNull().cast("double")).alias("success"), F.avg(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(F.col("_hits") / F.col("_m"), F.lit(0.0))).alias("recall"))


def lateness(events: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Events with body_kept: an ephemeral body counts only if it arrives soon after it was made; the event stays."""
    late = (F.unix_micros("arrived_at") - F.unix_micros("created_at")) / F.lit(1e6)
    return events.withColumn("body_kept", (F.col("text_class") != "ephemeral") | (late <= p.late_accept_s))
