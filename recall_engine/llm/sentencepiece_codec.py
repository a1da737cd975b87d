"""SentencePiece encoding and decoding through a distinct-chunk table.

With the model's spaces turned to markers, a marked word is a run of markers and the letters up to the next one. If
no piece of the vocabulary has a marker after another character, no merge can cross from one marked word to the
next, so each distinct marked word is segmented once, by the library, and the ids are joined back by position. Each
worker keeps the table of the chunks it has met, up to a bound, so no word is shuffled. A model with pieces
that cross markers, or with a normaliser that changes texts, is encoded whole instead.

Defined results: null text counts as empty and gives the end id alone; ids may be null or repeat; very long texts
and words are whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import hold, tokenizer_path

MARK, LONGEST = "▁", 64
_CHUNKS = re.compile(" (?: *)[^ ]*")


@functools.lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def splits_at_markers(path: str) -> bool:
    """True if marked words can be segmented on their own: no piece crosses into the next marked word, the
    normaliser leaves texts alone, a marker is put before the text and extra spaces stay."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    joint = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces) or proto.trainer_spec.treat_whitespace_as_suffix
    return plain and not joint and any(p.piece == MARK for p in proto.pieces) and proto.trainer_spec.model_type in (1, 2)


class Chunks(dict):
    """The distinct-chunk table: from a marked word, without its first marker, to its ids as text, their number and
    what they decode to. It keeps the first ``most`` entries, among which the frequent ones are, but no long ones: a text without
    spaces is one chunk, and the table is bounded in bytes too."""

    def __init__(self, sp, most: int = 400_000):
        super().__init__()
        self.sp, self.most = sp, most

    def __missing__(self, chunk: str) -> tuple[str, int, str]:
        ids = self.sp.encode(chunk) if chunk else [self.sp.piece_to_id(MARK)]  # a lone marker: a space at the end
        found = (" ".join(map(str, ids)), len(ids), self.sp.decode(ids))
        if len(self) < self.most and len(chunk) <= LONGEST:
            self[chunk] = found
        return found


def chunks_of(text: str) -> list[str]:
    """Marked words without their first marker; the library puts it back."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNKS.findall(" " + text)]


_tables: dict[str, Chunks] = {}


def encode_decode(text: str, path: str) -> tuple[str, int, str]:
    """The ids of a text with the end id, as decimals with one space between; their number; the decoded text."""
    sp = _model(path)
    if not splits_at_markers(path):
        ids = [*sp.encode(text), sp.eos_id()]
        return " ".join(map(str, ids)), len(ids), sp.decode(ids)
    end = str(sp.eos_id())
    if not text:
        return end, 1, sp.decode([sp.eos_id()])
    found = list(map(_tables.setdefault(path, Chunks(sp)).__getitem__, chunks_of(text)))
    ids, counts, words = zip(*found, strict=True)
    return " ".join((*ids, end)), sum(counts) + 1, " ".join(words)


def encode_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", outputs: bool = True) -> DataFrame:
    """One row a document: id_col, n_tokens, ids_sha256, decoded_sha256, and with outputs the ids (decimal text)
    and the decoded text."""
    path = tokenizer_path(vocabulary)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if outputs:
        fields += [T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sentencepiece", _tables.clear)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            done = [encode_decode(t, path) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([n for _, n, _ in done], pa.int64()), pa.array([sha(i) for i, _, _ in done], pa.string()), pa.array([sha(d) for *_, d in done], pa.string())]
            if outputs:
                cols += [pa.array([i for i, _, _ in done], pa.string()), pa.array([d for *_, d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, T.StructType(fields))
