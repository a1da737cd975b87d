"""Exact deduplication by content hash.

Rows are grouped by the 128-bit hash of their normalised text together with the text itself, so bytes are compared
inside every hash group and two texts that share a hash stay apart. The first aggregation runs before the shuffle:
a group of copies, however large, leaves each task as one row. Only groups with more than one row come back to the
rows, by a join that Spark may split where one group is very large.

Defined results: null text counts as empty, so null and empty texts are copies of each other; a null id never wins
over one that is not null; rows that share both id and text are all marked as kept if their id is the one that
stays; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.common import ascii_lower


def md5_128(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = lambda c: c, hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row a document: id_col, keep_id, group_size, kept, text_sha256.

    keep is "smallest" or "largest": which id of a group of equal texts stays. hash128 is the grouping hash; a weak
    one costs time, never correctness.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    texts = docs.select(F.col(id_col).alias("_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    sha = F.unhex(F.sha2(F.col("_text"), 256)).alias("_sha")
    groups = (
        texts.groupBy(hash128(F.col("_text")).alias("_hash"), "_text")
        .agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("_hash", sha, "_keep", "_n")
    )
    rows = texts.select("_id", hash128(F.col("_text")).alias("_hash"), sha)
    keep_id = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return rows.join(groups, ["_hash", "_sha"], "left").select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup_lower(docs: DataFrame) -> DataFrame:
    """Texts are equal after lower-casing A-Z only; the largest id stays."""
    return exact_dedup(docs, keep="largest", normalise=ascii_lower)
