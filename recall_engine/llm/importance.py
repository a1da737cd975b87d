"""Importance resampling towards a target distribution, over hashed word n-grams.

Two passes over the documents in Arrow batches. The first counts features by bucket with ``np.bincount`` into one vector for
each partition; ``treeReduce`` merges the vectors on the executors, so that the driver gets one vector, whatever the
corpus. The same is done for the target's texts. The second pass gathers each feature's gain, the logarithm of how much
likelier its bucket is in the target, from a broadcast vector, and sums them by document with ``bincount``'s weights. A
document's score is its mean gain and a Gumbel noise that its id alone decides, so taking the highest scores draws
without replacement in proportion to the importance. Places come from ranges of the scores (``operators.order``), so no
task holds all of them.

Texts are lower-cased in A-Z only. Words are runs of digits, letters a-z and characters from U+0080 on. Features are all
runs of 1 to ``width`` words joined by one space, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo
``buckets``. A document that is longer than a piece is read in pieces that carry the words before them, so memory is bounded by a
piece, unless a single word is longer.

Defined results: null and empty texts have no features, and weight 0; a null id is hashed as the empty text; rows that share
an id share their noise, and of rows that tie in score and id those with fewer features, then lower weights, come first;
repeated rows are drawn one by one; an empty table gives no rows, an empty target counts as zero everywhere; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.common import checkpointed, hold
from recall_engine.operators.order import numbered

#: Words of more bytes than this are hashed one by one; bytes of text that are taken at once.
LONG, PIECE = 48, 1 << 20
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[0x80:] = True
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """What each byte makes of a CRC-32 register (reflected polynomial EDB88320, a fixed value)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_T = _crc_table()


def _zeros_table() -> np.ndarray:
    """(length, byte of the register, value): what so many zero bytes make of a register; registers are linear, so the
    four bytes are looked up apart."""
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    for n in range(LONG):
        out[n + 1] = _T[out[n] & np.uint32(0xFF)] ^ out[n] >> np.uint32(8)
    return out


_ZEROS = _zeros_table()


def _after(register: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The registers after further words, from those of the words alone, which began with all ones."""
    c = register ^ _ONES
    out = word.copy()
    for k in range(4):
        out ^= _ZEROS[length, k, c >> np.uint32(8 * k) & np.uint32(0xFF)]
    return out


def _registers(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC register of each word of at most LONG bytes, all words at once, byte by byte."""
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    out = np.full(len(at), _ONES)
    for i in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -i, "left"))  # words with more than i bytes
        out[:k] = _T[(out[:k] ^ data[at[:k] + i]) & np.uint32(0xFF)] ^ out[:k] >> np.uint32(8)
    back = np.empty(len(at), np.uint32)
    back[order] = out
    return back


def text_features(texts: list[bytes], width: int, buckets: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text's place, number of words of each text) of lower-cased texts. Of texts in skip the
    first so many words have been counted before: features that end in them are left out."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    bounds = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    owner = np.searchsorted(bounds, starts, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[owner]
    long = np.flatnonzero(size > LONG)
    short = np.where(size > LONG, 0, size)
    word = _registers(data, starts, short)
    raw = {i: data[starts[i] : ends[i]].tobytes() for i in long.tolist()}
    for i, w in raw.items():
        word[i] = zlib.crc32(w) ^ 0xFFFFFFFF
    new = place >= (skip[owner] if skip is not None else 0)
    run, found, owners = word, [word[new]], [owner[new]]
    for n in range(1, width):
        # runs of n words, each with the word that follows it
        spaced = _T[(run[:-1] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ run[:-1] >> np.uint32(8)
        run = _after(spaced, word[n:], short[n:])
        for i in long[long >= n].tolist():
            run[i - n] = zlib.crc32(raw[i], int(spaced[i - n]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        whole = (place[n:] >= n) & new[n:]
        found.append(run[whole])
        owners.append(owner[n:][whole])
    bucket = ((np.concatenate(found) ^ _ONES) % np.uint32(buckets)).astype(np.int64)
    return bucket, np.concatenate(owners), n_words - (np.minimum(skip, n_words) if skip is not None else 0)


def _pieces(text: bytes, width: int, most: int) -> Iterator[tuple[bytes, int]]:
    """A lower-cased text in pieces that end where no word is cut. A piece begins with the last width - 1 words before it, if there
    are as many; their number comes along."""
    at, carried = 0, []
    while True:
        end = at + most
        while end < len(text) and _WORD[text[end]]:
            end += 1
        piece = b" ".join([*carried, text[at:end]]) if at else text[:end]
        yield piece, len(carried)
        if end >= len(text):
            return
        at, carried, stop = end, [], len(piece)
        while len(carried) < width - 1 and stop:
            while stop and not _WORD[piece[stop - 1]]:
                stop -= 1
            begin = stop
            while begin and _WORD[piece[begin - 1]]:
                begin -= 1
            if begin < stop:
                carried.insert(0, piece[begin:stop])
            stop = begin


def _runs(texts: list[str | None], width: int, most: int) -> Iterator[tuple[list[int], list[bytes], np.ndarray]]:
    """Pieces of texts, gathered to about a piece's size: the text's place, the piece, the words to skip."""
    own, held, skip, size = [], [], [], 0
    for i, t in enumerate(texts):
        for piece, back in _pieces((t or "").encode().lower(), width, most):
            own.append(i)
            held.append(piece)
            skip.append(back)
            size += len(piece) + 1
            if size >= most:
                yield own, held, np.array(skip, np.int64)
                own, held, skip, size = [], [], [], 0
    if own:
        yield own, held, np.array(skip, np.int64)


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000, width: int = 2, piece: int = PIECE) -> np.ndarray:
    """How many features fall into each bucket, over all texts: one vector a partition, merged on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("importance")
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for _, held, skip in _runs(b.column(0).to_pylist(), width, piece):
                seen += np.bincount(text_features(held, width, buckets, skip)[0], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([seen.tobytes()], pa.binary())})

    vectors = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    # an empty table may have no partition at all
    return vectors.union(texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)).treeReduce(np.add)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the logarithm of its share in the target over that in the corpus, both smoothed by one, in thousandths
    rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    one = lambda own, aim: math.floor(1000 * math.log(float(aim + 1) * float(s + n) / (float(own + 1) * float(t + n))))
    return np.array([one(a, b) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(h: int) -> int:
    """Gumbel noise of a 32-bit hash, in thousandths rounded down."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", width: int = 2, seed: int = 7, piece: int = PIECE) -> DataFrame:
    """One row a document: id_col, n_words, n_features, weight (the mean gain rounded down) and score."""
    held_gains = docs.sparkSession.sparkContext.broadcast(gains)  # as many numbers as there are buckets
    digits = F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), F.lit(8))
    given = docs.select(F.col(id_col).alias("_id"), F.conv(digits, 16, 10).cast("long").alias("_h"), F.col(text_col).cast("string").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("importance")
        gain = held_gains.value
        for b in batches:
            k = b.num_rows
            words, features, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
            for own, held, skip in _runs(b.column(2).to_pylist(), width, piece):
                bucket, at, n_words = text_features(held, width, len(gain), skip)
                own, n = np.array(own), len(held)
                np.add.at(words, own, n_words)
                np.add.at(features, own, np.bincount(at, minlength=n))
                # whole numbers far below 2^53, so the sums of doubles are exact
                np.add.at(total, own, np.bincount(at, weights=gain[bucket], minlength=n).astype(np.int64))
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            score = weight + np.array([noise(h) for h in b.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight, score))], names=["_id", "n_words", "n_features", "weight", "score"])

    return given.mapInArrow(run, f"_id {kind}, n_words long, n_features long, weight long, score long").withColumnRenamed("_id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25, least_words: int = 20, buckets: int = 10_000, width: int = 2, seed: int = 7, piece: int = PIECE) -> DataFrame:
    """One row a document: id_col, n_words, n_features, weight, score, rank. rank is 1, 2, 3, ... for the drawn ones,
    so many percent of the documents of least_words words or more, rounded down; it is null for all others."""
    if width < 1 or buckets < 1:
        raise ValueError("width and buckets must be at least 1")
    gains = bucket_gains(feature_counts(docs, text_col, buckets, width, piece), feature_counts(target, target_col, buckets, width, piece))
    rows = checkpointed(scored(docs, gains, id_col, text_col, width, seed, piece))
    enough = F.col("n_words") >= least_words
    placed = numbered(rows.filter(enough), [F.desc("score"), F.col(id_col).asc_nulls_last(), "n_features", "weight"], name="_place", total="_n")
    drawn = F.when(F.col("_place") <= F.floor(F.col("_n") * percent / 100), F.col("_place"))
    left = rows.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", drawn.cast("long")).drop("_place", "_n").unionByName(left)
