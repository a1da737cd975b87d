"""Log segments read by many tasks each: frames are found where their magic stands, so any split of a file can begin anywhere.

Spark's own text reader cuts files at the magic, and gives each piece to the split that it begins in; so segments lie in any store that
Spark reads, and large ones are split like any text. A piece is a frame's inside; where a record holds the magic itself, its
pieces are put together again by the frame's stated length and checksum. Frames whose pieces lie in different splits are put
together in a second pass over what was left at the splits' ends. A damaged frame is reported with its place, and reading
goes on at the next sound one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_engine.sources.files import LIMIT, MAGIC, VERSION, checkpointed, crc32c

_INSIDE, _CRC = struct.Struct("<BQ"), struct.Struct("<I")
FRAME, PIECE, TOTAL = "frame", "piece", "total"
_ROW = "segment string, block long, kind string, offset long, record binary, error string"


def _claimed(piece: bytes) -> int:
    """How many bytes a frame takes after its magic, by what its first piece says; 0 if that can't be."""
    if len(piece) < _INSIDE.size:
        return 0
    version, size = _INSIDE.unpack_from(piece)
    return _INSIDE.size + size + _CRC.size if version == VERSION and size <= LIMIT else 0


def _sound(inside: bytes) -> bool:
    return crc32c(inside[_INSIDE.size : -_CRC.size]) == _CRC.unpack_from(inside, len(inside) - _CRC.size)[0]


def assembled(pieces: list[bytes], first: bool, last: bool) -> list[tuple[int, int, str, bytes]]:
    """(offset, pieces taken, kind, bytes) of a run of pieces, offsets from the first one's magic. A frame is as many pieces as its
    stated length takes, if that ends where a piece does and the checksum holds. Pieces at either end that are no frame stay
    pieces, unless the run begins or ends the file: then, like those between frames, they are errors, of kind "" with their bytes."""
    size = np.array([len(p) + len(MAGIC) for p in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    out, i, n = [], 0, len(pieces)
    seen = False  # a sound frame
    while i < n:
        want = _claimed(pieces[i])
        end = int(np.searchsorted(begin, begin[i] + len(MAGIC) + want)) if want else 0
        whole = want and end <= n and begin[end] == begin[i] + len(MAGIC) + want
        inside = MAGIC.join(pieces[i:end]) if whole else b""
        if whole and _sound(inside):
            out.append((int(begin[i]), end - i, FRAME, inside[_INSIDE.size : -_CRC.size]))
            i, seen = end, True
            continue
        reaches_out = bool(want) and begin[i] + len(MAGIC) + want > begin[n] and not last
        if reaches_out:  # what follows here may be inside of it
            out += [(int(begin[k]), 1, PIECE, pieces[k]) for k in range(i, n)]
            break
        out.append((int(begin[i]), 1, "" if seen or first else PIECE, pieces[i]))
        i += 1
    return out


def _why(piece: bytes) -> str:
    if len(piece) < _INSIDE.size:
        return "short header"
    if not _claimed(piece):
        return "length" if piece[0] == VERSION else "not a frame"
    return "short record" if len(piece) < _claimed(piece) else "checksum"


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same first columns, together."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _split(key: tuple, rows: list[tuple]) -> list[tuple]:
    """The frames, errors and open pieces of one split, with offsets from its own beginning, and its length."""
    segment, block = key
    pieces = [r[0] for r in rows]
    out, at = [], 0
    if block == 0:  # what comes before the file's first magic
        if pieces[0]:
            out.append((segment, block, "", 0, None, "not a frame"))
        at, pieces = len(pieces[0]), pieces[1:]
    for offset, _, kind, data in assembled(pieces, block == 0, False):
        out.append((segment, block, kind, at + offset, data if kind else None, "" if kind else _why(data)))
    total = at + sum(len(p) + len(MAGIC) for p in pieces)
    return [*out, (segment, block, TOTAL, total, None, "")]


def _stitched(segment: str, rows: list[tuple]) -> list[tuple]:
    """What becomes of a segment's open pieces, in order: (offset, piece)."""
    out: list[tuple] = []
    i = 0
    while i < len(rows):
        j, run = i + 1, [rows[i][1]]
        while j < len(rows) and rows[j][0] == rows[j - 1][0] + len(MAGIC) + len(rows[j - 1][1]):
            run.append(rows[j][1])
            j += 1
        for offset, _, kind, data in assembled(run, True, True):
            out.append((segment, 0, kind, rows[i][0] + offset, data if kind else None, "" if kind else _why(data)))
        i = j
    return out


def scan_segments(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(segment, offset, record, error): every sound frame of all segment files with its record, and every stretch that isn't one with
    what is wrong. Files are split at split_bytes, by default as Spark's settings say. A task holds a split; of open pieces
    there are few, unless a file is damaged throughout, and those of one segment pass one task."""
    key, given = "spark.sql.files.maxPartitionBytes", None
    if split_bytes:
        given = spark.conf.get(key)
        spark.conf.set(key, str(split_bytes))
    try:
        raw = spark.read.option("lineSep", MAGIC.decode()).text(path)
        pieces = raw.select(F.col("_metadata.file_path").alias("segment"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, rows in _by_key(batches, 2):
                yield _batch(_split(k, rows), _ROW)

        held = checkpointed(pieces.mapInArrow(first, _ROW))
    finally:
        if given is not None:
            spark.conf.set(key, given)
    # where each split begins: the lengths of those before it. A segment has a row here for each of its splits.
    before = F.coalesce(F.sum("offset").over(Window.partitionBy("segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = held.filter(F.col("kind") == TOTAL).withColumn("_base", before).select("segment", "block", "_base")
    placed = held.filter(F.col("kind") != TOTAL).join(bases, ["segment", "block"]).withColumn("offset", F.col("offset") + F.col("_base")).drop("_base")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (segment,), rows in _by_key(batches, 1):
            yield _batch(_stitched(segment, rows), _ROW)

    left = placed.filter(F.col("kind") == PIECE).repartition("segment").sortWithinPartitions("segment", "offset").select("segment", "offset", "record")
    out = placed.filter(F.col("kind") != PIECE).unionByName(left.mapInArrow(second, _ROW).select(placed.columns))
    return out.select("segment", "offset", F.when(F.col("kind") == FRAME, F.decode("record", "UTF-8")).alias("record"), "error")
