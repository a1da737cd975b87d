"""Lexical retrieval packing: neighbours from a sharded BM25 index fill each seed document's window.

A document is its token ids and one end id. Full windows are cut off long documents where they are tokenised, so
only tails shorter than a window travel: as token ids, to shards of documents whose number follows from the number
of rows, so a shard has a bounded number of tails of a bounded length. Document frequencies and the mean length are
counted over all tails. A tail's BM25 weights, projected to a few dimensions, lead it down a tree of splits along the
main directions of a sample, so that tails with much weight in common meet in a shard. Each shard builds an inverted
index over its tails, with token ids as terms and BM25 weights. The first unused document seeds a window; the index
returns its unused neighbours by all of its terms, best first, and those that fit go in whole. What is left of the window
takes the first part of the best neighbour that didn't fit, or of the next unused document, and its rest seeds the next
window. A shard's last window is cut into sequences whose lengths are powers of two, so nothing is padded. A neighbour
in another shard is not found; the README has the share that is.

Defined results: null text counts as empty and has the end id alone; each row is packed, also where ids repeat or
are null; ties in score go to the smaller place in the shard (order of id, then of text); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import BYTE_CHARS, checkpointed, hold, tokenizer_path, unsure

#: The pre-token pattern of the word-end vocabulary, for lower-case words that ``plain`` admits.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Marks other than commas and full stops, in lower-case text, and these side by side: next to one, they would be part of its pre-token.
_MARKED = r"[^a-z0-9ß-öø-ÿœ \n\t.,]|[.,][.,]"
#: Words, and pre-tokens, that a worker remembers with their ids; those that come later are encoded again in each batch.
MOST_WORDS, MOST_PIECES = 500_000, 500_000
#: Longer words are not remembered, so that a worker's tables are bounded in bytes too.
LONGEST = 64
#: Dimensions of the projection, the units of a component, and the tails that the splits are learned from.
DIMS, UNITS, SAMPLE = 64, 256, 65_536
#: Parts in which the tasks' counts are summed before they come to the driver.
TALLIES = 16
K1, B = 1.2, 0.75


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, {}, {}


def _encode_words(tokenizer, words: list[str]) -> dict[str, bytes]:
    """The ids of pre-tokens as little-endian bytes, by the library's merges."""
    merge = tokenizer.model.tokenize
    found = [[t.id for t in merge(w if w.isascii() else w.translate(BYTE_CHARS))] for w in words]
    data, ends = np.array([i for f in found for i in f], "<u4").tobytes(), np.cumsum([0] + [4 * len(f) for f in found]).tolist()
    return {w: data[a:b] for w, a, b in zip(words, ends[:-1], ends[1:], strict=True)}


def _new_words(tokenizer, words: list[str], known: dict[str, bytes], pieces: dict[str, bytes]) -> dict[str, bytes]:
    """The ids of words that aren't known: of letters alone, they are pre-tokens; others are put together from theirs."""
    out = _encode_words(tokenizer, [w for w in words if w.isalpha()])
    mixed = {w: _PRE.findall(w) for w in words if w not in out}
    here = _encode_words(tokenizer, list({p for s in mixed.values() for p in s if p not in pieces and p not in known and p not in out}))
    ids = lambda p: pieces.get(p) or known.get(p) or out.get(p) or here[p]
    made = {w: b"".join(map(ids, s)) for w, s in mixed.items()}
    pieces.update(islice(((p, x) for p, x in here.items() if len(p) <= LONGEST), max(0, MOST_PIECES - len(pieces))))
    return out | made


def token_ids(texts: pa.Array, path: str) -> list[np.ndarray]:
    """The ids that the library gives each text. Distinct words of plain texts are looked up once, those not yet known by
    their pre-tokens. Other texts go to the library as a whole."""
    tokenizer, known, pieces = _tokenizer(path)
    whole = pc.or_(pc.match_substring_regex(texts, unsure(folded=True).pattern), pc.match_substring(texts, "<|"))
    out: list[np.ndarray | None] = [None] * len(texts)
    for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
        out[i] = np.array(tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
    low = pc.utf8_lower(texts.filter(pc.invert(whole)))
    # lone commas and full stops are pre-tokens of their own: fewer different words
    parted = pc.replace_substring(pc.replace_substring(low, ",", " , "), ".", " . ")
    words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, _MARKED), low, parted))
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = list(map(known.get, distinct))
    if None in found:
        new = _new_words(tokenizer, [w for w, f in zip(distinct, found, strict=True) if f is None], known, pieces)
        found = [new[w] if f is None else f for w, f in zip(distinct, found, strict=True)]
        known.update(islice(((w, x) for w, x in new.items() if len(w) <= LONGEST), max(0, MOST_WORDS - len(known))))
    size = np.array([len(f) // 4 for f in found], np.int64)
    codes = coded.indices.to_numpy()
    sizes = size[codes]
    ends = np.append(0, np.cumsum(sizes))
    place = np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], sizes) + np.arange(ends[-1])
    ids = np.frombuffer(b"".join(found), "<u4")[place]
    bounds = ends[np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))].tolist()
    for i, a, b in zip(np.flatnonzero(~whole.to_numpy(zero_copy_only=False)).tolist(), bounds[:-1], bounds[1:], strict=True):
        out[i] = ids[a:b]
    return out


def _slices(col: pa.Array, most: int = 3_000_000) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(col):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1
        yield col.slice(at, upto - at)
        at = upto


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


class Stats:
    """How many tails there are, their mean length, and in how many each term stands."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Stats:
        terms = np.concatenate([np.unique(d) for d in docs]).astype(np.int64) if docs else np.zeros(0, np.int64)
        return cls(len(docs), sum(map(len, docs)) / max(1, len(docs)), np.bincount(terms))

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | int, k1: float = K1, b: float = B) -> np.ndarray:
        """BM25 weights of terms in tails of a length."""
        df = self.df[term]
        return np.log1p((self.n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(1.0, self.mean)))


class Bm25:
    """An inverted index over the documents of a shard: terms to places and weights, by the statistics of all shards."""

    def __init__(self, docs: list[np.ndarray], k1: float, b: float, stats: Stats | None = None):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        terms = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        key, tf = np.unique(terms * max(self.n, 1) + np.repeat(np.arange(self.n), lengths), return_counts=True)
        term, self.place = np.divmod(key, max(self.n, 1))
        self.terms, at, df = np.unique(term, return_index=True, return_counts=True)
        self.at = np.append(at, len(term))
        self.weight = (stats or Stats.of(docs)).weights(term, tf, lengths[self.place], k1, b)
        order = np.argsort(self.place.astype(np.uint16) if self.n < 1 << 16 else self.place, kind="stable")
        self.terms_of = np.repeat(np.arange(len(self.terms)), df)[order]
        self.of = np.append(0, np.cumsum(np.bincount(self.place, minlength=self.n)))
        # terms of an eighth of the documents or more: their weights by place, with no more room than eight times the postings
        common = np.flatnonzero(df * 8 >= max(self.n, 1))
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.full = np.zeros((len(common), self.n))
        for r, t in enumerate(common):
            self.full[r, self.place[at[t] : at[t] + df[t]]] = self.weight[at[t] : at[t] + df[t]]

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Places of unused documents that share any of the seed's terms, best first."""
        terms = self.terms_of[self.of[seed] : self.of[seed + 1]]
        row = self.row[terms]
        score = self.full[row[row >= 0]].sum(axis=0)
        rare = terms[row < 0]
        size = self.at[rare + 1] - self.at[rare]
        posting = np.repeat(self.at[rare] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score += np.bincount(self.place[posting], self.weight[posting], minlength=self.n)
        found = np.flatnonzero((score > 0) & free)
        return found[np.argsort(-score[found], kind="stable")]


@functools.lru_cache(maxsize=1)
def _signs(terms: int) -> np.ndarray:
    return np.random.default_rng(6).choice(np.array([-1, 1], np.float32), (terms, DIMS))


def project(ids: np.ndarray, stats: Stats) -> np.ndarray:
    """A tail's BM25 weights in DIMS random directions, at length 1, in whole units: sums of these are exact in any order."""
    term, tf = np.unique(ids, return_counts=True)
    v = stats.weights(term, tf, len(ids)).astype(np.float32) @ _signs(len(stats.df))[term]
    return np.rint(v * (UNITS / max(float(np.sqrt(v @ v)), 1e-9))).astype("<i2")


def grow(x: np.ndarray, hashes: np.ndarray, shards: int):
    """A tree that parts the sample evenly: (direction, where it is cut, hash at the cut, low side, high side), or None for a
    shard. Equal tails are told apart by hash, so copies don't fill a shard."""
    if shards < 2 or not len(x):
        return None
    low = shards // 2
    y = x - x.mean(0)
    v = np.linalg.eigh(y.T @ y)[1][:, -1]
    v = np.rint(v * np.sign(v[np.argmax(np.abs(v))]) * UNITS)
    along = x @ v
    order = np.lexsort((hashes, along))
    cut = len(x) * low // shards
    first, rest = order[:cut], order[cut:]
    return v, along[rest[0]], hashes[rest[0]], low, grow(x[first], hashes[first], low), grow(x[rest], hashes[rest], shards - low)


def descend(tree, x: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The shard of each tail."""
    out = np.zeros(len(x), np.int64)
    if tree is None or not len(x):
        return out
    v, at, mark, low, left, right = tree
    along = x @ v
    high = (along > at) | (along == at) & (hashes >= mark)
    out[~high] = descend(left, x[~high], hashes[~high])
    out[high] = low + descend(right, x[high], hashes[high])
    return out


def pack_shard(docs: list[np.ndarray], window: int, k1: float = K1, b: float = B, stats: Stats | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (place, start, length) that hold each id of each document once."""
    index, n = Bm25(docs, k1, b, stats), len(docs)
    free, start = np.array([len(d) > 0 for d in docs], bool), np.zeros(n, np.int64)
    size = np.array([len(d) for d in docs], np.int64)
    sequences, begun, nxt = [], -1, 0
    while True:
        if begun < 0:
            while nxt < n and not free[nxt]:
                nxt += 1
            if nxt == n:
                break
            begun = nxt
        seed, begun, room, row = begun, -1, window, []

        def put(d: int, most: int, row=row) -> int:
            length = int(min(size[d] - start[d], most))
            row.append((d, int(start[d]), length))
            start[d] += length
            free[d] = start[d] < size[d]
            return length

        room -= put(seed, room)
        late = -1
        if room:
            found = index.neighbours(seed, free)
            left, at = size[found] - start[found], 0
            while room and at < len(found):  # the next one that fits
                fits = left[at:] <= room
                j = at + int(fits.argmax()) if fits.any() else len(found)
                if j > at and late < 0:
                    late = int(found[at])
                if j < len(found):
                    room -= put(int(found[j]), room)
                at = j + 1
        scan = nxt
        while room:
            if late < 0:
                while scan < n and not free[scan]:
                    scan += 1
                if scan == n:
                    break
                late = scan
            room -= put(late, room)
            begun, late = (late if free[late] else -1), -1
        sequences.append(row)
    last = sequences[-1] if sequences else []
    filled = sum(length for *_, length in last)
    if filled not in (0, window):
        sequences[-1:] = _powers(last, filled)
    return sequences


def _powers(row: list[tuple[int, int, int]], filled: int) -> list[list[tuple[int, int, int]]]:
    """A part-filled sequence cut into sequences of powers of two, longest first."""
    out, rest = [], list(row)
    for bit in reversed(range(filled.bit_length())):
        if not filled >> bit & 1:
            continue
        room, part = 1 << bit, []
        while room:
            d, s, n = rest[0]
            take = min(n, room)
            part.append((d, s, take))
            room -= take
            rest[0:1] = [(d, s + take, n - take)] if take < n else []
        out.append(part)
    return out


def _numbered(mark: int, seen: Counter) -> int:
    """A row's hash; for rows that repeat one of the same task, mixed with the task and how often it came before, so that rows
    that are equal in all, however many, are dealt to all shards as others are."""
    seen[mark] += 1
    if len(seen) > 1_000_000:
        seen.clear()
    if seen[mark] < 2:
        return mark
    own = f"{mark} {TaskContext.get().partitionId()} {seen[mark]}"
    return int.from_bytes(hashlib.blake2b(own.encode(), digest_size=8).digest(), "little", signed=True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", window: int = 4096, end_id: int = 2, docs_per_shard: int = 2048) -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer_path(vocabulary)
    kind = docs.schema[id_col].dataType
    n_ids = max(_tokenizer(path)[0].get_vocab_size(), end_id + 1)
    narrow = "<u2" if n_ids <= 1 << 16 else "<u4"
    field = lambda n, t: T.StructField(n, t)
    cut_schema = T.StructType([field("_hash", T.LongType()), field("_id", kind), field("_start", T.LongType()), field("_n", T.LongType()), field("_tokens", T.LongType()), field("_crc", T.LongType()), field("_ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full windows, done, and the tail of each document with its ids. At the end, without a hash, in how many tails of the task
        each term stands, how many they are and how long together."""
        hold("packing", _tokenizer.cache_clear)
        end = np.array([end_id], "<u4")
        seen: Counter = Counter()
        kind_, df, n_tails, length = None, np.zeros(n_ids, np.int64), 0, 0
        for b in batches:
            kind_ = b.column(1).type
            marks = [_numbered(m, seen) for m in b.column(0).to_pylist()]
            rows: list[tuple] = []
            encoded = (ids for part in _slices(b.column(2)) for ids in token_ids(part, path))
            for at, (mark, ids) in enumerate(zip(marks, encoded, strict=True)):
                ids = np.concatenate([ids, end])
                whole = len(ids) - len(ids) % window
                rows += [(mark, at, s, window, len(ids), _crc(ids[s : s + window]), None) for s in range(0, whole, window)]
                if whole < len(ids):
                    df[np.unique(ids[whole:])] += 1
                    n_tails, length = n_tails + 1, length + len(ids) - whole
                    rows.append((mark, at, whole, len(ids) - whole, len(ids), None, ids[whole:].astype(narrow).tobytes()))
            mark, at, s, n, total, crc, tail = zip(*rows, strict=True) if rows else [()] * 7
            cols = [pa.array(mark, pa.int64()), b.column(1).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (s, n, total, crc)), pa.array(tail, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=cut_schema.names)
        if n_tails:
            counts = np.concatenate([df, [n_tails, length]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kind_), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([zlib.compress(counts, 1)], pa.binary())], names=cut_schema.names)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The summed counts of tasks."""
        total = np.zeros(n_ids + 2, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(x), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["_ids"])

    def vectors(b: pa.RecordBatch, ids: int) -> np.ndarray:
        found = [project(np.frombuffer(x, narrow), stats) for x in b.column(ids).to_pylist()]
        return np.stack(found).astype(np.float64) if found else np.zeros((0, DIMS))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<i2").tobytes() for x in vectors(b, 1)], pa.binary())], names=["_hash", "x"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tails to the shards of their likely neighbours; full windows, which need none, evenly."""
        for b in batches:
            marks = b.column(0).to_numpy()
            shard = (marks % shards + b.column(2).to_numpy() // window) % shards
            tail = np.flatnonzero(b.column(6).is_valid().to_numpy(zero_copy_only=False))
            if shards > 1 and len(tail):
                shard[tail] = descend(tree, vectors(b.take(pa.array(tail)), 6), marks[tail])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *b.columns[1:]], names=["_shard", *cut_schema.names[1:]])

    def fill(t: pa.Table) -> pa.Table:
        """All pieces of a shard."""
        t = t.combine_chunks().sort_by([("_id", "ascending"), ("_start", "ascending"), ("_ids", "ascending")])
        shard = t["_shard"][0].as_py() if len(t) else 0
        first, n, total, crc, tails = (t[c].to_pylist() for c in ("_start", "_n", "_tokens", "_crc", "_ids"))
        done = [i for i, x in enumerate(tails) if x is None]
        open_ = [i for i, x in enumerate(tails) if x is not None]
        docs_ = [np.frombuffer(tails[i], narrow) for i in open_]
        out = [(i, first[i], n[i], crc[i], total[i], q, 0) for q, i in enumerate(done)]
        for q, row in enumerate(pack_shard(docs_, window, stats=stats), len(done)):
            offset = 0
            for d, s, length in row:
                i = open_[d]
                out.append((i, first[i] + s, length, _crc(docs_[d][s : s + length]), total[i], q, offset))
                offset += length
        at, s, length, crcs, totals, q, offset = zip(*out, strict=True) if out else [()] * 7
        longs = [pa.array(x, pa.int64()) for x in (s, length, crcs, totals, [(shard << 32) + x for x in q], offset)]
        return pa.Table.from_arrays([t["_id"].combine_chunks().take(pa.array(at, pa.int64())), *longs], names=out_schema.names)

    out_schema = T.StructType([field(id_col, kind)] + [field(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.xxhash64(F.col(id_col), text).alias("_hash"), F.col(id_col).alias("_id"), text.alias("_text"))
    cuts = checkpointed(given.mapInArrow(cut, cut_schema))
    pieces = cuts.filter(F.col("_hash").isNotNull())
    tails = pieces.filter(F.col("_ids").isNotNull())
    counted = np.zeros(n_ids + 2, np.int64)
    by_task = cuts.filter(F.col("_hash").isNull()).select("_ids")
    for r in by_task.repartition(TALLIES, F.xxhash64("_ids")).mapInArrow(tally, "_ids binary").collect():  # TALLIES rows of the vocabulary's length
        counted += np.frombuffer(zlib.decompress(r[0]), "<i8")
    df, n_tails, length = counted[:-2], int(counted[-2]), int(counted[-1])
    stats = Stats(n_tails, length / max(1, n_tails), df)
    shards, tree = max(1, -(-n_tails // docs_per_shard)), None
    if shards > 1:
        some = tails.filter(F.pmod(F.xxhash64("_hash"), F.lit(-(-n_tails // SAMPLE))) == 0).select("_hash", "_ids").mapInArrow(sampled, "_hash long, x binary").toArrow()
        x = np.frombuffer(b"".join(some["x"].to_pylist()), "<i2").reshape(-1, DIMS).astype(np.float64)
        marks = some["_hash"].to_numpy()
        order = np.lexsort((*x.T, marks))
        tree = grow(x[order], marks[order], shards)
    shard_schema = T.StructType([field("_shard", T.LongType()), *cut_schema.fields[1:]])
    return pieces.mapInArrow(deal, shard_schema).groupBy("_shard").applyInArrow(fill, out_schema)
