"""Line deduplication by range-partitioned line hashes, in DataFrame expressions only.

Every line of every document becomes a row of its key's 128-bit hash, the document and the position. Hashes are uniform, so
the bounds of ranges are computed, not sampled: a range is a run of hashes and, within it, a run of the documents' own
hashes, so a line that a third of all documents share spreads over DOC_RUNS ranges. Rows are sorted by hash, document and
position within each range. Streaming over it keeps the first occurrence of a key in a document; counts and first places of
a key leave each range as one row, and what is frequent goes back to just the ranges that hold it. What goes back to the
documents is not text but a run-length bitmap for each document that loses lines: the runs of lines that stay.

Defined results: null or empty text is one empty line; a key is the line without blanks at both ends, with A-Z in
lower case; keys shorter than min_chars code points are never dropped; each row is a document, also where ids repeat or are null, and
rows that share both id and text keep or lose the same lines; an empty table gives no rows; extra columns stay, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.llm.common import BLANKS, ascii_lower, restored, set_aside

#: The end of a run that reaches to the last line; runs of line hashes and of document hashes (powers of two) that bound a range.
OPEN, HASH_RUNS, DOC_RUNS = (1 << 31) - 2, 256, 256


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _identity(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: the id, and the text where ids repeat."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th")]


def line_entries(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Every line that has a key: _range (the partition of its range), _h1, _h2, _id, _th, _pos."""
    keys = docs.select(*_identity(id_col, text_col), F.posexplode(lines_of(F.col(text_col))).alias("_pos", "_line")).withColumn("_key", line_key(F.col("_line")))
    hashed = keys.filter(F.char_length("_key") >= min_chars).select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"), "_id", "_th", "_pos")
    top = lambda c, runs: F.shiftrightunsigned(c, 65 - runs.bit_length())
    place = top(F.col("_h1"), HASH_RUNS) * DOC_RUNS + top(F.xxhash64("_id", "_th"), DOC_RUNS)
    return _by_range(hashed.select(F.coalesce(F.pmod(place, F.lit(_partitions(docs))), F.lit(0)).cast("int").alias("_range"), "*"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_range(df: DataFrame) -> DataFrame:
    """Ranges are dealt to partitions in turn: _range says to which."""
    return df.repartitionById(_partitions(df), F.col("_range"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, first_stays: bool = False) -> DataFrame:
    """One row a document that loses lines: _id, _th, _dropped (their number), _runs (the runs of lines that stay).

    Keys of at least min_chars code points in at least min_docs documents lose their lines: all of them, or with
    first_stays all but the first in order of document and position.
    """
    entries = line_entries(docs, id_col, text_col, min_chars)
    key = ["_range", "_h1", "_h2"]
    within = Window.partitionBy(*key, "_id", "_th").orderBy("_pos")
    firsts = entries.withColumn("_rank", F.rank().over(within)).filter("_rank = 1")  # one for each of rows that are equal in all
    first = [F.min(F.struct("_id", "_th", "_pos")).alias("_first")] if first_stays else []
    counts = firsts.groupBy(*key).agg(F.count(F.lit(1)).alias("_docs"), *first)
    everywhere = Window.partitionBy("_h1", "_h2")
    total = {"_docs": F.sum("_docs").over(everywhere)} | ({"_first": F.min("_first").over(everywhere)} if first_stays else {})
    frequent = counts.withColumns(total).filter(F.col("_docs") >= min_docs).drop("_docs")
    hit = entries.join(_by_range(frequent), key)
    if first_stays:
        hit = hit.filter(~F.struct("_id", "_th", "_pos").eqNullSafe(F.col("_first")))
    gone = hit.groupBy("_id", "_th").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    return gone.select("_id", "_th", F.size("_gone").alias("_dropped"), _runs(F.col("_gone")).alias("_runs"))


def _runs(gone: Column) -> Column:
    """The runs between dropped positions, as start and length; the last one is open to the end."""
    from_ = F.concat(F.array(F.lit(-1)), gone)
    to = F.concat(gone, F.array(F.lit(OPEN)))
    return F.filter(F.zip_with(from_, to, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length"))), lambda r: r["length"] > 0)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, and _n_lines, _n_dropped and _kept (the text of the lines that stay), which
    replace columns of these names."""
    given, (own_id, own_text) = set_aside(docs, id_col, text_col)
    left = given.select("*", *_identity(own_id, own_text))
    b = bitmaps.select(F.col("_id").alias("_bid"), F.col("_th").alias("_bth"), "_runs", "_dropped")
    joined = left.join(b, left["_id"].eqNullSafe(F.col("_bid")) & (left["_th"] == F.col("_bth")), "left")
    text = F.coalesce(F.col(own_text), F.lit(""))
    lines = lines_of(F.col(own_text))
    kept = F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    return restored(
        joined,
        docs,
        _n_lines=F.size(lines).cast("long"),
        _n_dropped=F.coalesce("_dropped", F.lit(0)).cast("long"),
        _kept=F.when(F.col("_runs").isNull(), text).otherwise(kept),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, first_stays: bool = False) -> DataFrame:
    """The documents with _n_lines, _n_dropped and _kept."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_docs, min_chars, first_stays), id_col, text_col)
