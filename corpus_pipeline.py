"""A corpus pipeline of four stages over ``documents``: language, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm import language_id as lid
from recall_engine.llm.common import BLANKS, restored, set_aside, shared_folder, table
from recall_engine.llm.line_dedup import line_dedup
from recall_engine.llm.ngram_join import keep_one
from recall_engine.llm.packing import pack

#: Documents whose language is less certain than this, or that have no letter, are rejected.
LEAST_SCORE = 0.3


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in one of the learned languages, with the predicted language in ``lang``."""
    model = lid.train(docs.filter(~lid.held_out()), order=F.xxhash64("doc_id"))
    inner, (text,) = set_aside(docs, "text")
    found = lid.identify(inner, model, text, keep=tuple(inner.columns), spans=False)
    kept = found.filter((F.col("lang_pred") != lid.UND) & (F.col("score") >= LEAST_SCORE))
    return restored(kept, docs, lang=F.col("lang_pred")).select(*_names(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more stay in the first of them alone; documents left without a line go."""
    inner, (doc_id, given) = set_aside(docs, "doc_id", "text")
    out = line_dedup(inner, doc_id, given, min_docs=10, min_chars=1, first_stays=True)
    kept = out.filter((F.col("_n_dropped") == 0) | (F.btrim("_kept", F.lit(BLANKS)) != ""))
    text = F.when(F.col("_n_dropped") == 0, F.col(given)).otherwise(F.col("_kept"))
    return restored(kept, docs, text=text, n_chars=F.char_length(text).cast("long")).select(*_names(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group of near duplicates."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return pack(docs)


STAGES = [("language", language), ("repeated_lines", repeated_lines), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL can say neither a learned language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
