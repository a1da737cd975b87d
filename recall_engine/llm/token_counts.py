"""Token counts by a map-side two-tier lookup of pre-token lengths.

Byte-pair merges never cross pre-tokens, so a text has as many tokens as its pre-tokens have together. The first
tier is a compact table of the corpus's most frequent pre-tokens and their lengths, counted over all documents (each
task sends its own most frequent ones, pre-summed) and broadcast; its size is a parameter, whatever the corpus. The
second tier is a cache in each worker: a pre-token that is in neither is encoded once and remembered. Pre-tokens
are never shuffled one by one, and the tables change only the speed, never a count.

Texts with characters that Python and the library might split differently (controls, rare spaces, numbers that aren't decimal
digits, what Unicode added after version 3.2), or with the library's special strings, go to the library as a whole.

Defined results: null text counts as empty, with no bytes and no tokens; ids may be null or repeat, each row is
counted; very long texts are whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import BYTE_CHARS, hold, plain, tokenizer_path

#: Longer pre-tokens are not remembered, so that a worker's tables are bounded in bytes too.
LONGEST = 64
#: The pre-token pattern of byte-level BPE, for the texts that ``plain`` admits.
_PRE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Lengths(dict):
    """Lengths of pre-tokens; what it lacks, it encodes and keeps, in at most ``most`` entries more, none of them long."""

    def __init__(self, encode, known: Iterable[tuple[str, int]] = (), most: int = 400_000):
        super().__init__(known)
        self.encode, self.left = encode, most

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if self.left > 0 and len(piece) <= LONGEST:
            self.left -= 1
            self[piece] = n
        return n


def piece_encoder(tokenizer) -> Callable[[str], list]:
    """The tokens of one pre-token: by the library's merges alone where nothing else is done to a pre-token before them."""
    from tokenizers import models, pre_tokenizers

    if isinstance(tokenizer.model, models.BPE) and tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
        model = tokenizer.model
        return lambda piece: model.tokenize(piece.translate(BYTE_CHARS))
    return lambda piece: tokenizer.encode(piece, add_special_tokens=False).ids


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    specials = [a.content for a in t.get_added_tokens_decoder().values()]
    return t, specials


def compact(counted: Iterable[tuple[str, int]]) -> tuple[str, bytes]:
    """Pre-tokens joined by NUL, which plain texts lack, and their lengths in a byte each."""
    kept = [(p, n) for p, n in counted if n < 256]
    return "\0".join(p for p, _ in kept), bytes(n for _, n in kept)


_tables: dict[tuple, Lengths] = {}


def _table(path: str, key: int, packed: tuple[str, bytes]) -> Lengths:
    """The worker's tables, built once for each broadcast."""
    if (path, key) not in _tables:
        _tables.clear()
        _tables[path, key] = Lengths(piece_encoder(_tokenizer(path)[0]), zip(packed[0].split("\0"), packed[1], strict=True) if packed[1] else ())
    return _tables[path, key]


def count_tokens(text: str, lengths: Lengths, tokenizer, specials: list[str]) -> int:
    if plain(text) and not any(s in text for s in specials):
        return sum(map(lengths.__getitem__, _PRE.findall(text)))
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def frequent_pretokens(docs: DataFrame, text_col: str, size: int, each: int) -> list[str]:
    """The most frequent pre-tokens of all documents, at most ``size``; each task sends at most ``each``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if plain(text):
                    seen.update(p for p in _PRE.findall(text) if len(p) <= LONGEST)
            if len(seen) > 40 * each:
                seen = Counter(dict(seen.most_common(20 * each)))
        top = seen.most_common(each)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("text <> ''")
    top = texts.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    return [r.piece for r in top.select("piece").toLocalIterator()] if size else []


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", table_size: int = 32_768, limit: int = 512) -> DataFrame:
    """One row a document: id_col, n_bytes, n_tokens, over_limit."""
    path = tokenizer_path(vocabulary)
    tokenizer, _ = _tokenizer(path)
    pieces = frequent_pretokens(docs, text_col, table_size, table_size // 4)
    encode = piece_encoder(tokenizer)
    packed = docs.sparkSession.sparkContext.broadcast(compact((p, len(encode(p))) for p in pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token_counts", _tables.clear)
        tok, specials = _tokenizer(path)
        lengths = _table(path, id(packed), packed.value)
        for b in batches:
            n = [count_tokens(t, lengths, tok, specials) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("_bytes"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return given.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
