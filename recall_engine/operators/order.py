"""Places, running totals and quantiles of orders of any length, without one task that holds the whole.

Rows are dealt out by ranges of their order, sorted within each range, and written to the shared folder, so that later steps
and reruns see the same ranges. A range is then counted or summed, its offset is the sum of the ranges before it, and a
row's place is its range's offset and its own place in the range. What comes together is one row for each range, and of
groups one for each range that a group reaches into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.sources.files import checkpointed

#: Rows of a range are numbered from a multiple of 2^33 on, as Spark does it.
_PART = 33


def _dealt(df: DataFrame, order: Sequence[Column | str], by: Sequence[str]) -> DataFrame:
    """The rows in ranges, with _at, which rises with the order, and _part, the range."""
    keys = [*by, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return checkpointed(rows).withColumn("_part", F.shiftright("_at", _PART))


def _beside(rows: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what is known of their range. Without groups that is one row a range, whose number Spark's settings bound."""
    if not by:
        return rows.join(F.broadcast(ranges), "_part")
    ranges = ranges.withColumnsRenamed({c: f"_by_{c}" for c in by}).withColumnRenamed("_part", "_in")
    on = rows["_part"] == ranges["_in"]
    for c in by:
        on &= rows[c].eqNullSafe(ranges[f"_by_{c}"])
    return rows.join(ranges, on).drop("_in", *[f"_by_{c}" for c in by])


def _offsets(ranges: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """ranges with _before, the sum of value over the ranges before, and _whole, that over all of the group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum(value).over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("_before", before).withColumn("_whole", F.sum(value).over(w))


def numbered(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "place", total: str | None = None) -> DataFrame:
    """The rows with their place in the order, from 1, of all rows or of each group, and with total the number of rows of
    the group. Rows that tie in the whole order get some places of those that they share."""
    rows = _dealt(df, order, by)
    ranges = rows.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    ranges = _offsets(ranges, "_n", by).select("_part", *by, (F.coalesce("_before", F.lit(0)) - F.col("_first") + 1).alias("_shift"), "_whole")
    out = _beside(rows, ranges, by).withColumn(name, F.col("_at") + F.col("_shift"))
    out = out.withColumn(total, F.col("_whole")) if total else out
    return out.drop("_at", "_part", "_shift", "_whole")


def running(df: DataFrame, value: str, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "running", total: str | None = None) -> DataFrame:
    """The rows with the sum of a whole-numbered value over all rows up to and with their own, and with total that over the group;
    null values add nothing. Rows that tie in the whole order are taken in some order."""
    rows = _dealt(df, order, by)
    ranges = _offsets(rows.groupBy("_part", *by).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_n")), "_n", by)
    ranges = ranges.select("_part", *by, F.coalesce("_before", F.lit(0)).alias("_before"), "_whole")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    out = _beside(rows.withColumn("_own", own), ranges, by).withColumn(name, F.col("_before") + F.col("_own"))
    out = out.withColumn(total, F.col("_whole")) if total else out
    return out.drop("_at", "_part", "_own", "_before", "_whole")


def smaller(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "smaller", total: str | None = None) -> DataFrame:
    """(by, value, name, total): for each different value the number of rows with a smaller one, ties counted once before they are
    put in order. Nulls count as smallest."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    out = running(counted, "_c", [F.col(value).asc_nulls_first()], by, "_to", total or "_all")
    out = out.withColumn(name, F.col("_to") - F.col("_c"))
    return out.drop("_to") if total else out.drop("_to", "_all")


def with_smaller(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "smaller", total: str = "total") -> DataFrame:
    """The rows with the number of rows of their group that have a smaller value, and the number of all of them."""
    found = smaller(df, value, by, name, total).drop("_c").withColumnsRenamed({c: f"_own_{c}" for c in (*by, value)})
    on = df[value].eqNullSafe(found[f"_own_{value}"])
    for c in by:
        on &= df[c].eqNullSafe(found[f"_own_{c}"])
    return df.join(found, on).drop(*[f"_own_{c}" for c in (*by, value)])


def element_at(df: DataFrame, value: str, place: Column, by: Sequence[str] = (), total: str = "total") -> DataFrame:
    """(by, value, total): the value at a place of each group's order, counted from 0. place may use total, the number
    of the group's rows. Nulls come first."""
    found = smaller(df, value, by, "_less", total)
    return found.filter((place >= F.col("_less")) & (place < F.col("_less") + F.col("_c"))).select(*by, value, total)
