"""Vector retrieval: cosine of unit vectors in double precision, brute force per query, and a hashing embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.functions.text import words
from recall_engine.operators.lexical import checked_broadcast, top_per_query
from recall_engine.params import PARAMS


def dot(a: Column, b: Column) -> Column:
    """The inner product, in the order of the components; -1 where lengths differ."""
    product = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).otherwise(F.aggregate(product, F.lit(0.0), lambda s, x: s + x))


def normalise(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    wide = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, wide).otherwise(F.transform(wide, lambda x: x / norm))


def encoded(df: DataFrame, vector: str = "vector", name: str = "data") -> DataFrame:
    """The rows with a vector as bytes: 32-bit floats, little-endian; null for null. Components that are null make a vector null."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    whole = ~F.exists(vector, lambda x: x.isNull())
    return df.withColumn(name, F.when(whole, pack(F.col(vector).cast("array<float>"))))


def decoded(df: DataFrame, data: str = "data", name: str = "vector", dims: int | None = None) -> DataFrame:
    """The rows with bytes as a vector; null where they aren't whole floats, or not as many as they should be."""

    @F.pandas_udf("array<float>")
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or len(x) % 4 or dims is not None and len(x) != 4 * dims else np.frombuffer(x, "<f4"))

    return df.withColumn(name, unpack(F.col(data)))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = PARAMS.candidates) -> DataFrame:
    """(query_id, message_id, sim, rank). vectors: message_id, model_id, vector; queries: query_id, model_id, vector.
    Models are never compared with each other. A few queries meet every vector where it lies; the query table is
    broadcast if it is small, else joined by model."""
    q = queries.select("query_id", "model_id", F.col("vector").alias("_q"))
    scored = vectors.join(checked_broadcast(q), "model_id").select("query_id", "message_id", dot(F.col("_q"), F.col("vector")).alias("sim"))
    return top_per_query(scored, k, F.desc("sim"), "message_id")


def hash_embed(texts: DataFrame, id_col: str, text_col: str, dims: int = 384) -> DataFrame:
    """(id_col, vector): a signed bag of hashed words of unit length; a stand-in for a learned embedder. A text's words are summed where it
    lies; rows of one id count together."""
    hashed = texts.select(id_col, F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column(1)
            h = listed.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(listed.offsets)))
            sign = np.where(h >> 40 & 1, 1.0, -1.0)
            sums = np.bincount(row * dims + h % dims, sign, b.num_rows * dims).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims), pa.array(sums))], names=[id_col, "_v"])

    out = T.StructType([texts.select(id_col).schema.fields[0], T.StructField("_v", T.ArrayType(T.IntegerType()))])
    each = hashed.mapInArrow(run, out).groupBy(id_col).agg(F.collect_list("_v").alias("_l"))
    whole = F.when(F.size("_l") == 1, F.col("_l")[0]).otherwise(F.aggregate(F.slice("_l", 2, F.size("_l")), F.col("_l")[0], lambda a, x: F.zip_with(a, x, lambda p, q: p + q)))
    return each.select(id_col, normalise(whole).alias("vector"))


def pending_embeddings(revisions: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """Revisions without a vector of this model, oldest first; a vector of another revision of the message doesn't count.
    vectors: revision_id, model_id."""
    done = vectors.filter(F.col("model_id") == model_id).select("revision_id")
    return revisions.join(done, "revision_id", "left_anti").select("revision_id", "message_id", "created_at").orderBy("created_at", "revision_id")


def head_vectors(vectors: DataFrame, messages: DataFrame, model_id: str, include_retracted: bool = False) -> DataFrame:
    """(message_id, model_id, vector) of each message's head revision; vectors of superseded revisions are left out.
    vectors: revision_id, model_id, vector."""
    shown = messages if include_retracted else messages.filter(~F.col("retracted"))
    own = vectors.filter(F.col("model_id") == model_id).select(F.col("revision_id").alias("head_revision_id"), "model_id", "vector")
    return own.join(shown.select("message_id", "head_revision_id"), "head_revision_id").select("message_id", "model_id", "vector")


def migrate(vectors: DataFrame, keep: str) -> DataFrame:
    """The vectors of one model alone: those of others go, and their revisions are pending again."""
    return vectors.filter(F.col("model_id") == keep)
