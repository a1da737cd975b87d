"""Events whose ids commit to all that they say and to all that came before them in their origin.

An id is the SHA-256 of the canonical JSON of the whole envelope, payload and the id of the event before included, without the
id itself and the signature. So nothing in a log can be changed, left out or put in another place without an id that no
longer fits. New ids follow one another, so they are made by an ordered pass over each origin's new events; checking needs no
order, since each event names the one before it: every id is computed again where the event lies, without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.schemas import ENVELOPE
from recall_engine.sources.files import canonical_json

#: What is hashed in front of an envelope, so that no other hash of the same bytes is an id.
DOMAIN = b"recall-engine event 1\n"
#: What an id doesn't cover.
OUTSIDE = ("event_id", "signature")


def envelope_fields() -> dict[str, T.DataType]:
    """The fields that an id covers."""
    return {f.name: f.dataType for f in T.StructType.fromDDL(ENVELOPE).fields if f.name not in OUTSIDE}


def _whole(text: str) -> int:
    n = int(text)
    if abs(n) > (1 << 53) - 1:
        raise ValueError("number too large")
    return n


def _no_fraction(text: str) -> float:
    raise ValueError("numbers must be integers")


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key comes twice")
    return out


_STRICT = json.JSONDecoder(parse_int=_whole, parse_float=_no_fraction, parse_constant=_no_fraction, object_pairs_hook=_pairs)
_PLAIN = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical(value) -> str:
    """The one text of a JSON value that ``_STRICT`` has read: keys sorted by UTF-16 units, no white space. Where no character lies beyond
    U+FFFF that is the order of code points, which the library sorts by."""
    text = _PLAIN.encode(value)
    return text if text.isascii() or max(text) < "\ud800" else canonical_json(value)


def event_digest(envelope: dict) -> str:
    """The id of an envelope, a mapping from field to value. Null fields, empty previous ids and empty lists count as absent. The payload
    is JSON text; what isn't JSON with whole numbers and distinct keys raises ValueError."""
    said = {k: v for k, v in envelope.items() if v is not None and k not in OUTSIDE and not (k in ("previous_event_id", "parent_ids") and not v)}
    if "payload" in said:
        said["payload"] = _STRICT.decode(said["payload"])
    return hashlib.sha256(DOMAIN + canonical(said).encode()).hexdigest()


def _fields(events: DataFrame) -> list[str]:
    return [c for c in envelope_fields() if c in events.columns]


def _digest_or_none(envelope: dict) -> str | None:
    try:
        return event_digest(envelope)
    except (ValueError, RecursionError):  # not JSON, or text that isn't Unicode
        return None


def with_own_id(events: DataFrame, name: str = "own_id") -> DataFrame:
    """The events with the id that follows from what they say; null where the payload has no canonical form."""
    fields = _fields(events)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(fields))]
            own = [_digest_or_none(dict(zip(fields, row, strict=True))) for row in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[len(fields) :], pa.array(own, pa.string())], names=[*b.schema.names[len(fields) :], name])

    kinds = envelope_fields()
    said = [F.col(c).cast(kinds[c]).alias(f"_said_{c}") for c in fields]
    out = T.StructType([*events.schema.fields, T.StructField(name, T.StringType())])
    return events.select(*said, *events.columns).mapInArrow(run, out)


def identified(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """New events with their event_id and previous_event_id. events: device_id, generation, sequence and further fields of the
    envelope, whose sequences follow the heads (device_id, generation, event_id) of their origins, none for a new one. A
    payload without a canonical form stops the job."""
    events = events.drop("event_id", "previous_event_id")
    if heads is None:
        given = events.withColumn("_head", F.lit(None).cast("string"))
    else:
        known = heads.select("device_id", "generation", F.col("event_id").alias("_head"))
        given = events.join(known, ["device_id", "generation"], "left")
    fields, kept = _fields(events), events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, last = None, ""
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(fields))]
            heads_ = b.column(b.num_columns - 1).to_pylist()
            ids, before = [], []
            for row, head in zip(zip(*cols, strict=True), heads_, strict=True):
                said = dict(zip(fields, row, strict=True))
                if (said["device_id"], said["generation"]) != origin:
                    origin, last = (said["device_id"], said["generation"]), head or ""
                before.append(last)
                last = event_digest({**said, "previous_event_id": last})
                ids.append(last)
            rest = b.columns[len(fields) : -1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.string()), pa.array(before, pa.string())], names=[*kept, "event_id", "previous_event_id"])

    out = T.StructType([*events.schema.fields, T.StructField("event_id", T.StringType()), T.StructField("previous_event_id", T.StringType())])
    kinds = envelope_fields()
    said = [F.col(c).cast(kinds[c]).alias(f"_said_{c}") for c in fields]
    dealt = given.repartition("device_id", "generation").sortWithinPartitions("device_id", "generation", "sequence")
    return dealt.select(*said, *kept, "_head").mapInArrow(run, out)
