"""File sources and sinks: framed log segments, content-addressed objects, corpora as JSON lines, views as text."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.schemas import CORPUS_ITEMS, CORPUS_QUERIES

#: Fixed values of the frame format: magic, version, length of the record (64 bits, little-endian), record, CRC-32C of the record
#: (32 bits, little-endian); a longer record than LIMIT is a broken length.
MAGIC, VERSION, LIMIT = b"CRNF", 1, 16 << 20
_HEAD, _CRC = struct.Struct("<4sBQ"), struct.Struct("<I")
#: The reflected polynomial of CRC-32C (Castagnoli); a fixed value.
CASTAGNOLI = 0x82F63B78


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (CASTAGNOLI if i & 1 else 0)
        table.append(i)
    return table


_TABLE = _crc_table()
_TABLE_U = np.array(_TABLE, np.uint32)
#: Bytes of a row where a long record is taken as many rows at once, and from which length on that pays.
_ROW, _LONG = 256, 1 << 14


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by what it makes of each bit, on every number."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= op[i] * (x >> np.uint32(i) & np.uint32(1))
    return out


def _past(n: int) -> np.ndarray:
    """The map that n zero bytes make of a checksum, by repeated squaring."""
    bit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out, step = bit, bit >> np.uint32(8) ^ _TABLE_U[bit & np.uint32(0xFF)]
    while n:
        out = _apply(step, out) if n & 1 else out
        step, n = _apply(step, step), n >> 1
    return out


def crc32c(data: bytes) -> int:
    """Short records byte by byte; long ones as rows of bytes, all at once, whose checksums are joined in pairs."""
    if len(data) < _LONG:
        c = 0xFFFFFFFF
        for b in data:
            c = c >> 8 ^ _TABLE[(c ^ b) & 0xFF]
        return c ^ 0xFFFFFFFF
    rows = 1 << (-(-len(data) // _ROW) - 1).bit_length()
    cells = np.zeros(rows * _ROW, np.uint8)  # zeros in front don't change a checksum that starts at zero
    cells[len(cells) - len(data) :] = np.frombuffer(data, np.uint8)
    c = np.zeros(rows, np.uint32)
    for column in np.ascontiguousarray(cells.reshape(rows, _ROW).T):
        c = c >> np.uint32(8) ^ _TABLE_U[(c ^ column) & np.uint32(0xFF)]
    op = _past(_ROW)
    while len(c) > 1:
        c, op = _apply(op, c[0::2]) ^ c[1::2], _apply(op, op)
    return int(c[0]) ^ int(_apply(_past(len(data)), np.array([0xFFFFFFFF], np.uint32))[0]) ^ 0xFFFFFFFF


def encode_frame(record: bytes) -> bytes:
    """Magic, version, length, record, checksum."""
    return _HEAD.pack(MAGIC, VERSION, len(record)) + record + _CRC.pack(crc32c(record))


def decode_frames(data: bytes, mode: str = "permissive") -> Iterator[tuple[int, bytes | None, str]]:
    """(offset, record, error) of each frame. A broken tail ends the segment: permissive reports it, dropmalformed leaves
    it out, failfast raises."""
    at = 0
    while at < len(data):
        error, record, size = "", None, 0
        if len(data) - at < _HEAD.size:
            error = "short header"
        else:
            magic, version, size = _HEAD.unpack_from(data, at)
            if magic != MAGIC or version != VERSION:
                error = "not a frame"
            elif size > LIMIT:
                error = "length"
            elif len(data) - at < _HEAD.size + size + 4:
                error = "short record"
            else:
                record = data[at + _HEAD.size : at + _HEAD.size + size]
                if crc32c(record) != _CRC.unpack_from(data, at + _HEAD.size + size)[0]:
                    error, record = "checksum", None
        if error and mode == "failfast":
            raise ValueError(f"{error} at {at}")
        if not error or mode == "permissive":
            yield at, record, error
        if error:
            return
        at += _HEAD.size + size + 4


@functools.cache
def _steps() -> np.ndarray:
    """(k, byte, value): what 2^k zero bytes make of each byte of a checksum."""
    bit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step, out = bit >> np.uint32(8) ^ _TABLE_U[bit & np.uint32(0xFF)], np.empty((32, 4, 256), np.uint32)
    for k in range(32):
        for j in range(4):
            out[k, j] = _apply(step, np.arange(256, dtype=np.uint32) << np.uint32(8 * j))
        step = _apply(step, step)
    return out


def _advanced(c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What zero bytes, as many as each length says, make of each checksum."""
    c = c.copy()
    for k in range(int(lengths.max()).bit_length() if len(lengths) else 0):
        odd = (lengths >> k & 1).astype(bool)
        x, t = c[odd], _steps()[k]
        c[odd] = t[0][x & np.uint32(0xFF)] ^ t[1][x >> np.uint32(8) & np.uint32(0xFF)] ^ t[2][x >> np.uint32(16) & np.uint32(0xFF)] ^ t[3][x >> np.uint32(24)]
    return c


def sound_frames(data: bytes, starts: list[int]) -> np.ndarray:
    """Which of some places begin a sound frame. Every byte goes into a checksum once, however many frames are claimed: that of a
    range follows from those of what ends at its two ends."""
    at = np.array(starts, np.int64)
    size = np.array([_HEAD.unpack_from(data, i)[2] if data.startswith(MAGIC, i) and i + _HEAD.size <= len(data) and data[i + 4] == VERSION else LIMIT + 1 for i in starts], np.uint64)
    ok = size <= LIMIT
    begin = at + _HEAD.size
    end = begin + np.where(ok, size, 0).astype(np.int64)
    ok &= end + _CRC.size <= len(data)
    begin, end = begin[ok], end[ok]
    if not len(begin):
        return ok
    points = np.unique(np.concatenate([[0], begin, end]))
    each = np.array([crc32c(data[i:j]) for i, j in zip(points[:-1].tolist(), points[1:].tolist(), strict=True)], np.uint32)
    upto = np.zeros(len(points), np.uint32)
    for k, gap in enumerate(np.diff(points).tolist()):
        upto[k + 1] = _advanced(upto[k : k + 1], np.array([gap]))[0] ^ each[k]
    found = upto[np.searchsorted(points, end)] ^ _advanced(upto[np.searchsorted(points, begin)], end - begin)
    ok[np.flatnonzero(ok)] = found == np.array([_CRC.unpack_from(data, i)[0] for i in end.tolist()], np.uint32)
    return ok


def segment_state(data: bytes) -> tuple[int, str]:
    """How many bytes of a segment are sound, and whether it is clean, torn (nothing sound follows the break: the tail of an append
    that broke off, which may be cut) or corrupt (a sound frame follows, so something inside was damaged)."""
    good = 0
    for at, record, error in decode_frames(data):
        if error:
            claimed = [m.start() for m in re.finditer(re.escape(MAGIC), data[at + 1 :])]
            return at, "corrupt" if sound_frames(data, [at + 1 + i for i in claimed]).any() else "torn"
        good = at + _HEAD.size + len(record) + _CRC.size
    return good, "clean"


def repaired(data: bytes) -> bytes:
    """A segment without its torn tail; a corrupt one is refused."""
    good, state = segment_state(data)
    if state == "corrupt":
        raise ValueError(f"corrupt at {good}")
    return data[:good]


def segment_states(spark: SparkSession, path: str) -> DataFrame:
    """(segment, size, good, state) of all segment files: what a recovery would keep of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(d), *segment_state(d)) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["segment", "size", "good", "state"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "segment string, size long, good long, state string")


def log_origins(spark: SparkSession, folder: str) -> DataFrame:
    """(device_id, generation, segments, first, bytes) of each origin that has segments in a log's folder, from the names of its
    files alone: device/generation/seg_<first sequence>.seg."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "seg_*.seg").load(folder).select("path", "length")
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/(\d+)/seg_(\d+)\.seg$", i)
    named = files.select(part(1).alias("device_id"), part(2).try_cast("int").alias("generation"), part(3).try_cast("long").alias("_first"), "length").filter("generation IS NOT NULL")
    return named.groupBy("device_id", "generation").agg(F.count(F.lit(1)).alias("segments"), F.min("_first").alias("first"), F.sum("length").alias("bytes"))


def read_segments(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """(segment, offset, record, error) of all segment files, one task or more a file; records are JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(decode_frames(data, mode))
                yield pa.RecordBatch.from_pydict({"segment": pa.array([name] * len(rows), pa.string()), "offset": pa.array([r[0] for r in rows], pa.int64()), "record": pa.array([None if r[1] is None else r[1].decode("utf-8", "replace") for r in rows], pa.string()), "error": pa.array([r[2] for r in rows], pa.string())})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "segment string, offset long, record string, error string")


def put_objects(df: DataFrame, path: str, data: str = "data") -> None:
    """Adds objects, named by the hash of their bytes, in folders of the hash's first two digits."""
    named = df.select(F.sha2(F.col(data).cast("binary"), 256).alias("object_hash"), F.col(data).cast("binary").alias("data")).dropDuplicates(["object_hash"])
    named.withColumn("prefix", F.left("object_hash", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(path)


def get_objects(spark: SparkSession, path: str, hashes: DataFrame | None = None) -> DataFrame:
    """(object_hash, data) of the objects wanted whose bytes still have their hash."""
    held = spark.read.parquet(path)
    if hashes is not None:
        wanted = hashes.select("object_hash").distinct().withColumn("prefix", F.left("object_hash", F.lit(2)))
        held = held.join(wanted, ["prefix", "object_hash"], "left_semi")
    return held.filter(F.sha2("data", 256) == F.col("object_hash")).select("object_hash", "data").dropDuplicates(["object_hash"])


def read_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(items, queries) of a corpus folder; its manifest's checksums must hold."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json").toLocalIterator()))
    for f in manifest["files"]:
        data = spark.read.format("binaryFile").load(f"{folder}/{f['name']}").select(F.sha2("content", 256).alias("h")).first()
        if data is None or data.h != f["sha256"]:
            raise ValueError(f"checksum of {f['name']}")
    return spark.read.schema(CORPUS_ITEMS).json(f"{folder}/items.jsonl"), spark.read.schema(CORPUS_QUERIES).json(f"{folder}/queries.jsonl")


def corpus_manifest(files: Iterable[tuple[str, bytes]], **about) -> str:
    """The manifest of a corpus: names, sizes and hashes of its files."""
    return _manifest([{"name": n, "sha256": hashlib.sha256(d).hexdigest(), "bytes": len(d)} for n, d in files], **about)


def _manifest(each: list[dict], **about) -> str:
    total = hashlib.sha256("".join(f["sha256"] for f in each).encode()).hexdigest()
    return json.dumps({"schema_version": 1, **about, "files": each, "checksum": total}, sort_keys=True, indent=1)


def write_corpus(items: DataFrame, queries: DataFrame, folder: str, **about) -> None:
    """A corpus that ``read_corpus`` reads: items and queries as JSON lines, in as many parts as there are tasks, and last of all the
    manifest with the hash of every part; a write that breaks off has none."""
    spark = items.sparkSession
    parts = {"items.jsonl": (items, CORPUS_ITEMS), "queries.jsonl": (queries, CORPUS_QUERIES)}
    for name, (df, schema) in parts.items():
        fields = spark.createDataFrame([], schema).schema.fields
        df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").json(f"{folder}/{name}")
    written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{folder}/{n}" for n in parts])
    name = F.regexp_extract("path", r"/((?:items|queries)\.jsonl/[^/]+)$", 1).alias("name")
    each = written.select(name, F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy("name").collect()  # one row a part
    text = _manifest([r.asDict() for r in each], **about)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")


def write_results(df: DataFrame, path: str) -> None:
    """Outcome records of an evaluation run, as JSON lines; nothing is scored in them."""
    df.withColumn("schema_version", F.lit(1)).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    out = spark.read.schema(f"schema_version int, {schema}").json(path)
    return out.filter("schema_version = 1").drop("schema_version")


def write_views(df: DataFrame, path: str, key: str, text: str) -> None:
    """A text file in a folder for each key: digests, maps, compaction reports."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def canonical_json(value) -> str:
    """The one text of a JSON value: keys in order of UTF-16 units, no white space, integers only, at most 2^53 - 1."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > (1 << 53) - 1:
            raise ValueError("number too large")
        return str(value)
    if isinstance(value, float):
        raise ValueError("numbers must be integers")
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
    return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical_json(value[k]) for k in keys) + "}"


def shared_folder(spark: SparkSession) -> str:
    """Where the cluster keeps what executors share: ``spark.checkpoint.dir``, else the checkpoint folder set in the session,
    else a folder in the warehouse."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/shared").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that driver and executors share, without the plan that made them."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", "") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
