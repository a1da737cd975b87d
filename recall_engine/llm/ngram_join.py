"""Near-duplicate groups: an exact n-gram Jaccard join with a count-vector R-tree.

Two documents link when the Jaccard similarity of their sets of word shingles is at least num / den. The result is one
row a document with the least id that links reach; no link between different sets is lost, and none is spelled out
for copies, which share one node.

1. One scan gives each document's set size and set digest, and a count table of shingles (fixed size, summed over all
   documents by way of the shuffle). Rare shingles, by this table, come first in one global order.
2. A second scan sends, for each distinct set, signatures of its first shingles in that order: two sets that link share one
   of them. A signature is a pair of shingles that follow each other in the order of the set, of the first half of it; so sets
   that have single shingles in common by chance, as ever more have in a larger corpus, don't meet. (Below a similarity of
   3/4 sets that link needn't share a pair; there a signature is one of the first n - ceil(t n) + 1 shingles.) They travel as
   packed arrays to buckets by signature. Signatures that only one prefix has bound the size that a partner can have; the
   connected components of the sets that share a signature and may link by size are the candidate groups.
3. The texts of each candidate group come together once. Shingles are hashed into 64 to 1024 groups; the counts of a set are
   a point, and an R-tree over the points bounds the overlap of a set with all sets below a node by the sum of the
   coordinate minima. Pairs that survive are verified on the shingle sets, unless links found before join them already.
4. A candidate group of more than CELL sets, or of sets of more than CELL_SHINGLES shingles in all, never comes together. Its sets
   are first held, row by row, against one of them, the head: what links to it is settled. The others, the open ones, are
   dealt to cells of sets of like sizes, each with an R-tree. All open sets, and by the triangle inequality only those
   settled ones that lie far enough out to reach an open one, stream past the cells of their own and the next sizes, in
   parts of bounded length, and ask their trees: first with their points, and only those that some bound lets through with
   their texts. So a task holds a cell and a batch, however large the group.

Words are runs of characters other than blanks, with A-Z in lower case; a document with fewer than ``width`` words but
at least one has its whole sequence as its only shingle. Shingles are 64-bit hashes, sets are told apart by digests of 126
bits, which travel as decimals.

Defined results: null and empty texts, and texts of blanks, have no shingles, link with nothing and are their own
component; rows with equal or null ids each count; a component of null ids alone has a null id; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.common import checkpointed, hold, release, restored, set_aside

#: The most sets, and shingles of sets, that one task gathers; rows that stream past a cell in one task.
CELL, CELL_SHINGLES, PART = 2048, 1 << 22, 1 << 16
#: The most bytes, counted beforehand, that are broadcast.
SMALL = 1 << 25
#: Nodes of more edges than this, and than a fixed share of all edges, are looked up by broadcast.
HUB, MOST_HUBS = 1_000, 100_000
#: The most edges of a graph that one task settles; a graph of more goes in rounds.
LOCAL_EDGES = 1 << 18
#: Counters of the count table, and how many travel in one row.
COUNTERS, CHUNK = 1 << 20, 1 << 10
#: Parts that the rows of one key are dealt to (a power of two).
SALTS = 8
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    n_words = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), n_words
    size = ends - starts
    power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(int(size.max()) - 1, _BASE)]))
    letters = np.flatnonzero(~blank)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    total = np.add.reduceat(_BYTE[data[letters]] * power[place], np.cumsum(size) - size)
    return _mix(total + size.astype(np.uint64)), n_words


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, n_words = _words([t.lower() for t in texts])
    first = np.cumsum(n_words) - n_words
    run = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        run = _mix(run * _BASE + words[i : i + len(run)] + _U(i))
    out = []
    for a, n in zip(first.tolist(), n_words.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(run[a : a + n - width + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for w in words[a : a + n]:
                h = _mix(h * _BASE + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


NODE = T.DecimalType(38, 0)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _digests(found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Digests as pairs of 64-bit numbers, low one first, whose 126 bits are a decimal; and which are none."""
    none = np.array([f is None for f in found], bool)
    d = np.frombuffer(b"".join(f or bytes(16) for f in found), np.int64).reshape(-1, 2).copy()
    d[:, 1] >>= 2
    return d, none


def _decimals(d: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """Pairs of numbers as a column of decimals, without a copy a value."""
    valid = None if none is None else pa.array(~none).buffers()[1]
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(d), [valid, pa.py_buffer(np.ascontiguousarray(d, np.int64).tobytes())])


def _names(low: np.ndarray) -> np.ndarray:
    """Low halves of digests as numbers of their own, of which ``_decimals`` makes decimals."""
    return np.stack([low, np.zeros_like(low)], axis=1)


def _dense(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests as places among the distinct ones, and these."""
    order = np.argsort(d[:, 0], kind="stable")
    s = d[order]
    if (s[1:, 1] != s[:-1, 1])[s[1:, 0] == s[:-1, 0]].any():  # equal in one half only
        order = np.lexsort((d[:, 1], d[:, 0]))
        s = d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, s[new]


def _slices(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    run, size, at = [], 0, 0
    for i, t in enumerate(texts):
        run.append((t or "").encode())
        size += len(run[-1])
        if size >= most:
            yield at, run
            run, size, at = [], 0, i + 1
    if run:
        yield at, run


def _links(a: int, b: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


class CountTree:
    """An R-tree over count vectors, in one order of rows; a node is a range of them with the largest count of each
    group and the least and largest set size."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = 32):
        self.leaf = leaf
        self.order = np.arange(len(sizes))
        self.counts, self.sizes = counts, sizes
        self.root = self._split(0, len(sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]

    def _split(self, a: int, b: int):
        rows = self.order[a:b]
        top = self.counts[rows].max(axis=0)
        node = [a, b, top, int(self.sizes[rows].min()), int(self.sizes[rows].max()), None, None]
        if b - a > self.leaf:
            spread = np.append(self.counts[rows].std(axis=0), self.sizes[rows].std() / 8)
            axis = int(spread.argmax())
            key = self.sizes[rows] if axis == self.counts.shape[1] else self.counts[rows, axis]
            self.order[a:b] = rows[np.argsort(key, kind="stable")]
            mid = (a + b) // 2
            node[5], node[6] = self._split(a, mid), self._split(mid, b)
        return node

    def asked(self, q: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Rows, in the tree's order, whose overlap with a set of counts q and size n may be enough."""
        stack, found = [self.root], []
        while stack:
            a, b, top, least, most, left, right = stack.pop()
            if most * den < n * num or least * num > n * den or (den + num) * int(np.minimum(q, top).sum()) < num * (n + least):
                continue
            if left is not None:
                stack += [right, left]
                continue
            bounds = np.minimum(q, self.counts[a:b]).sum(axis=1, dtype=np.int64)
            found.append(np.flatnonzero((den + num) * bounds >= num * (n + self.sizes[a:b])) + a)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def candidates(self, i: int, group: np.ndarray, num: int, den: int) -> Iterator[int]:
        """Rows after i, in the tree's order, of other groups, whose overlap with i may be enough. group changes
        while the caller joins groups."""
        q, n = self.counts[i], int(self.sizes[i])
        stack = [self.root]
        while stack:
            a, b, top, least, most, left, right = stack.pop()
            if b <= i + 1 or most * den < n * num or least * num > n * den or (group[max(a, i + 1) : b] == group[i]).all():
                continue
            bound = int(np.minimum(q, top).sum())
            if (den + num) * bound < num * (n + least):
                continue
            if left is not None:
                stack += [right, left]
                continue
            rows = np.arange(max(a, i + 1), b)
            bounds = np.minimum(q, self.counts[rows]).sum(axis=1, dtype=np.int64)
            for j in rows[((den + num) * bounds >= num * (n + self.sizes[rows])) & (group[rows] != group[i])]:
                if group[j] != group[i]:
                    yield int(j)


def _counts(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """The shingles of each set by group."""
    k = len(sets)
    key = np.repeat(np.arange(k), [len(s) for s in sets]) << bits | (_mix(np.concatenate(sets)) >> _U(64 - bits)).astype(np.int64)
    return np.bincount(key, minlength=k << bits).reshape(k, -1).astype(np.int32)


def _bits(sizes: np.ndarray) -> int:
    return min(10, max(6, int(np.median(sizes)).bit_length() - 3))  # an eighth of the usual size, 64 to 1024


def join_group(sets: list[np.ndarray], num: int = 3, den: int = 4) -> np.ndarray:
    """The components of the links among sets: for each its component, as a place."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    counts = _counts(sets, _bits(sizes))
    tree = CountTree(counts, sizes)
    group = np.arange(k)
    for i in range(k):
        own = sets[tree.order[i]]
        for j in tree.candidates(i, group, num, den):
            other = sets[tree.order[j]]
            if _links(len(own), len(other), overlap(own, other), num, den):
                group[group == group[j]] = group[i]
    out = np.empty(k, np.int64)
    out[tree.order] = tree.order[group]
    return out


class Cell:
    """Open sets that others stream past. Links among them, and to the settled component, are remembered, so that no set is
    verified against what it is known to be joined with."""

    def __init__(self, nodes: list, sets: list[np.ndarray], num: int, den: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        self.bits = _bits(sizes)
        self.tree = CountTree(_counts(sets, self.bits), sizes)
        self.nodes = [nodes[i] for i in self.tree.order]
        self.sets = [sets[i] for i in self.tree.order]
        self.place = {n: i for i, n in enumerate(self.nodes)}
        self.group = np.arange(len(sets) + 1)  # the last one is the settled component
        self.num, self.den = num, den

    def meet(self, node, s: np.ndarray, settled: bool) -> Iterator:
        """Nodes of the cell that a set links with, as many as it takes to join all that it joins."""
        own = len(self.sets) if settled else self.place.get(node, -1)
        for j in self.tree.asked(_counts([s], self.bits)[0], len(s), self.num, self.den).tolist():
            if own >= 0 and self.group[j] == self.group[own]:
                continue
            if _links(len(s), len(self.sets[j]), overlap(s, self.sets[j]), self.num, self.den):
                if own < 0:
                    own = j
                else:
                    self.group[self.group == self.group[j]] = self.group[own]
                yield self.nodes[j]


def _scan(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows of documents (id, text hash, set size, digest, name of the set) and rows of the count table (chunk, counts)."""
    fields = [T.StructField("_id", docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("_th", "_n")] + [T.StructField("_set", NODE), T.StructField("_name", NODE), T.StructField("_chunk", T.IntegerType()), T.StructField("_counts", T.BinaryType())]
    schema = T.StructType(fields)
    kind = pa.null()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ngram_join")
        seen, id_type = np.zeros(COUNTERS, np.int64), kind
        for b in batches:
            id_type = b.column(0).type
            n, digest = [], []
            for _, part in _slices(b.column(2).to_pylist()):
                sets = shingle_sets(part, width)
                seen += np.bincount((np.concatenate(sets) & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                n += [len(s) for s in sets]
                digest += [set_digest(s) if len(s) else None for s in sets]
            k, (d, none) = len(n), _digests(digest)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), _decimals(d, none), _decimals(_names(d[:, 0]), none), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=schema.names)
        if seen.any():
            chunks = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in seen.reshape(-1, CHUNK)]
            k = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0))), pa.array(range(k), pa.int32()), pa.array(chunks, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.col(text_col)).mapInArrow(run, schema)


def _count_table(scanned: DataFrame) -> np.ndarray:
    """The summed counters: COUNTERS numbers, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
                total[c] = total[c] + x if c in total else x
        yield pa.RecordBatch.from_pydict({"_chunk": pa.array(list(total), pa.int32()), "_counts": pa.array([np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())})

    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint32)
    for r in scanned.filter("_chunk IS NOT NULL").select("_chunk", "_counts").repartition("_chunk").mapInArrow(add, "_chunk int, _counts binary").collect():
        out[r[0]] = np.frombuffer(r[1], "<u4")
    return out.reshape(-1)


def _paired(num: int, den: int) -> bool:
    """Whether sets that link share two shingles that follow each other in both. They have at least num / (den - num) shingles in common for
    each one that only one of them has; with three for one, some two must be neighbours, with fewer each could stand alone."""
    return num >= 3 * (den - num)


def n_signatures(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many signatures sets of n shingles send. Of pairs: until two common shingles are neighbours, one that only one set has follows each
    common one. A set with x shingles of its own and n - x in common has at most e = (n - x) (den - num) / num such ones on both sides,
    so e + x of its shingles stand before those two, which is most for the largest x that e allows. None if the set can link with none but itself."""
    n = np.asarray(n, np.int64)
    if not _paired(num, den):
        return n + (-(n * num) // den) + 1
    own = n * (den - num) // den
    either = (n - own) * (den - num) // num
    return np.where(either > 0, np.minimum(either + own + 1, n - 1), 0)


def signatures(s: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of which a linked set must have one, told from the rarest shingles of a set."""
    keep = int(n_signatures(len(s), num, den))
    first = s[np.lexsort((s, counts[(s & _U(COUNTERS - 1)).astype(np.int64)]))[: keep + 1]]
    return _mix(_mix(first[:-1]) * _BASE + first[1:]) if _paired(num, den) else _mix(first[:keep])


def _largest(n: np.ndarray, unmet: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest set that may link with one of n shingles whose prefix ends first and of whose signatures the other lacks so many. A shingle of
    its own costs it two pairs at most, one of the other's costs it one: common <= (2 n + other - unmet) / 3."""
    if _paired(num, den):
        return ((2 * den - num) * n - (num + den) * unmet) // (2 * num - den)
    return ((num + den) * (n - unmet)) // num - n


_ENTRY = (("_h", np.uint32), ("_d", np.int64), ("_n", np.uint32), ("_u", np.uint32))


def _packed(columns: dict[str, np.ndarray], bucket: np.ndarray, name: str, **fixed: int) -> pa.RecordBatch:
    """Rows of a bucket and its entries, each column packed into one value."""
    order = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at, len(bucket)).tolist()
    spans = list(zip(ends[: len(ids)], ends[1:], strict=False))
    cols = {name: pa.array(ids, pa.int64())} | {k: pa.array([v] * len(ids), pa.int64()) for k, v in fixed.items()}
    for k, v in columns.items():
        own = v[order]
        cols[k] = pa.array([own[i:j].tobytes() for i, j in spans], pa.binary())
    return pa.RecordBatch.from_pydict(cols)


def _unpacked(t: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    kinds = dict(_ENTRY)
    return [np.concatenate([np.frombuffer(x, kinds[n]) for x in t[n].to_pylist()]) for n in names]


def _meetings(docs: DataFrame, text_col: str, counts: np.ndarray, buckets: int, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets, named by the low halves of their digests: a forest over the sets that share a signature and may link.

    Entries of signature, set and set size go to buckets by signature. Those that met another set there go on to buckets by
    set, where each set learns how many of its signatures no other set has, and back. Of two sets, let x be the one whose
    prefix ends first in the common order: signatures that only x has can't be in the other set at all, so the more there are,
    the smaller the other one must be, and that leaves few. Sets of one name would be one candidate, which loses no link.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers of four bytes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owner: list[bytes] = []
        size: list[np.ndarray] = []
        known: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            bucket = ((h >> _U(32)) % _U(buckets)).astype(np.int64)
            d = np.repeat(_digests(owner)[0][:, 0], [len(x) for x in held])
            out = _packed({"_h": h.astype(np.uint32), "_d": d, "_n": np.concatenate(size)}, bucket, "_bucket")
            held.clear()
            owner.clear()
            size.clear()
            return out

        for b in batches:
            for _, part in _slices(b.column(0).to_pylist()):
                for s in shingle_sets(part, width):
                    if len(s) and (digest := set_digest(s)) not in known and n_signatures(len(s), num, den):
                        known.add(digest)
                        held.append(signatures(s, shared.value, num, den))
                        owner.append(digest)
                        size.append(np.full(len(held[-1]), len(s), np.uint32))
                if sum(map(len, held)) > 2_000_000:
                    yield flush()
            if len(known) > 1_000_000:
                known.clear()
        if held:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        """Entries whose signature another set has too, once each."""
        h, d, n = _unpacked(t, ("_h", "_d", "_n"))
        _, at = np.unique(h.astype(np.uint64) << _U(32) | np.unique(d, return_inverse=True)[1].astype(np.uint64), return_index=True)
        h, d, n = h[at], d[at], n[at]
        same = h[1:] == h[:-1]
        met = np.append(same, False) | np.append(False, same)
        h, d, n = h[met], d[met], n[met]
        return pa.Table.from_batches([_packed({"_h": h, "_d": d, "_n": n}, d % buckets, "_to", _bucket=t["_bucket"][0].as_py())])

    def tally(t: pa.Table) -> pa.Table:
        """The same entries with the number of the set's signatures that none but it has."""
        h, d, n = _unpacked(t, ("_h", "_d", "_n"))
        bucket = np.repeat(t["_bucket"].to_numpy(), [len(x) // 4 for x in t["_h"].to_pylist()])
        which = np.unique(d, return_inverse=True)[1]
        unmet = n_signatures(n, num, den) - (np.bincount(which)[which] if len(which) else 0)
        return pa.Table.from_batches([_packed({"_h": h, "_d": d, "_n": n, "_u": np.maximum(unmet, 0).astype(np.uint32)}, bucket, "_bucket")])

    def link(t: pa.Table) -> pa.Table:
        """A forest over the sets of each signature, by the sizes that each may link with. Members lie in order of size, so
        whom a set may link with is a run of them, and joining neighbours in the run joins it all."""
        h, d, n, u = _unpacked(t, ("_h", "_d", "_n", "_u"))
        names, d = np.unique(d, return_inverse=True)
        names = _names(names)
        order = np.lexsort((d, n, h))
        h, d, n, u = h[order], d[order], n[order].astype(np.int64), u[order].astype(np.int64)
        block = np.cumsum(np.append(0, h[1:] != h[:-1])) << 33
        least = -(-n * num // den)
        most = np.maximum(np.minimum(n * den // num, _largest(n, u, num, den)), 0)
        lo, hi = np.searchsorted(block + n, block + least, "left"), np.searchsorted(block + n, block + most, "right")
        may = hi > lo
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, lo[may], 1)
        np.add.at(cover, hi[may] - 1, -1)
        side = np.flatnonzero(np.cumsum(cover)[: len(h)] > 0)
        own = np.flatnonzero(may)
        pairs = np.concatenate([np.stack([d[side], d[side + 1]], axis=1), np.stack([d[own], d[lo[own]]], axis=1)])
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        nodes, ends = np.unique(pairs, return_inverse=True)
        a, b = _forest(len(nodes), ends.reshape(-1, 2))
        return pa.Table.from_arrays([_decimals(names[nodes[a]]), _decimals(names[nodes[b]])], schema=pa.schema([("a", pa.decimal128(38, 0)), ("b", pa.decimal128(38, 0))]))

    entries = docs.select(F.col(text_col)).mapInArrow(send, "_bucket long, _h binary, _d binary, _n binary")
    met = entries.groupBy("_bucket").applyInArrow(meet, "_to long, _bucket long, _h binary, _d binary, _n binary")
    told = met.groupBy("_to").applyInArrow(tally, "_bucket long, _h binary, _d binary, _n binary, _u binary")
    return told.groupBy("_bucket").applyInArrow(link, "a decimal(38,0), b decimal(38,0)").distinct()


def _forest(n: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that has a pair, but the least of its component, with that least one."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    least = np.array([find(x) for x in range(n)], np.int64)
    moved = np.flatnonzero(least != np.arange(n))
    return moved, least[moved]


def _looked_up(edges: DataFrame, nodes: DataFrame, hub: int) -> DataFrame:
    """(b, m) of edges (a, b) with the m of node a. nodes: a, m, k edges. Few nodes have more than ``hub`` edges; these are broadcast."""
    hubs = F.broadcast(nodes.filter(F.col("k") > hub).select("a", "m"))
    rest = edges.join(hubs.select("a"), "a", "left_anti").join(nodes.filter(F.col("k") <= hub).select("a", "m"), "a")
    return rest.unionByName(edges.join(hubs, "a")).select("b", "m")


def _settled_locally(edges: DataFrame) -> DataFrame:
    """What ``components`` gives, of few edges between digests, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.concatenate([np.frombuffer(b.column(i).buffers()[1], np.int64).reshape(-1, 2)[b.column(i).offset :][: b.num_rows] for i in range(2)]) for b in batches if b.num_rows]
        if not ends:
            return
        sizes = [len(x) // 2 for x in ends]
        both = np.concatenate([x[:n] for x, n in zip(ends, sizes, strict=True)] + [x[n:] for x, n in zip(ends, sizes, strict=True)])
        place, nodes = _dense(both)
        # digests are positive numbers, whose high half decides; the least of a component is its root
        rank = np.empty(len(nodes), np.int64)
        order = np.lexsort((nodes[:, 0].view(np.uint64), nodes[:, 1]))
        rank[order] = np.arange(len(nodes))
        a, b = _forest(len(nodes), rank[place].reshape(2, -1).T)
        root = np.arange(len(nodes))
        root[a] = b
        nodes = nodes[order]
        yield pa.RecordBatch.from_arrays([_decimals(nodes), _decimals(nodes[root])], names=["node", "root"])

    return checkpointed(edges.select("a", "b").coalesce(1).mapInArrow(run, "node decimal(38,0), root decimal(38,0)"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph given as pairs (a, b), the root being the least node.

    Alternating stars: each round links every node to the least neighbour it knows of, in two joins; the rounds end
    when nothing changes, after about the logarithm of the longest path. No component is gathered. Nodes with very many
    neighbours, of which there are at most MOST_HUBS, are looked up by broadcast. A graph of at most LOCAL_EDGES edges, which are
    counted first, is settled by one task instead, where rounds would cost more than the work.
    """
    e = checkpointed(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    signed = lambda: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    sign, k = None, F.count(F.lit(1)).alias("k")
    del pairs
    release(e.sparkSession)
    now = signed()
    if now[0] <= LOCAL_EDGES and isinstance(e.schema["a"].dataType, T.DecimalType):
        return _settled_locally(e)
    while now != sign:
        sign, hub = now, max(HUB, 2 * now[0] // MOST_HUBS)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), k).select("a", F.least("a", "m").alias("m"), "k")
        large = _looked_up(both.filter("b > a"), least, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), k)
        small = _looked_up(large, low, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = signed()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


_SETS = "root decimal(38,0), node decimal(38,0)"
_PAIR = pa.schema([("a", pa.decimal128(38, 0)), ("b", pa.decimal128(38, 0))])


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.decimal128(38, 0)), pa.array([x for _, x in found], pa.decimal128(38, 0))], schema=_PAIR)


def _numbers(n: Column) -> Column:
    """0 to n - 1, one row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _beside(left: DataFrame, right: DataFrame, on: list[str], size: int) -> DataFrame:
    """An inner join whose right side is broadcast where its size in bytes, which was counted, is small."""
    return left.join(F.broadcast(right) if size <= SMALL else right, on)


def _against_head(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Sets of large groups (root, node, _n, _parts, _text) held against the set whose digest is the root: root, node, _n, _parts,
    linked, far (Jaccard distance), _point (the counts of its shingles by group, of as many groups as half the head's shingles).
    Where the heads are too many to be broadcast, a group's rows are dealt to its number of
    parts, and the head goes to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict = {}
        for b in batches:
            roots, texts, head_texts = (b.column(i).to_pylist() for i in (0, 4, 5))
            linked, far, points = [], [], []
            for at, part in _slices(texts):
                for i, s in enumerate(shingle_sets(part, width), at):
                    if roots[i] not in heads:
                        if len(heads) > 64:
                            heads.clear()
                        heads[roots[i]] = shingle_sets([head_texts[i].encode()], width)[0]
                    h = heads[roots[i]]
                    both = overlap(s, h)
                    linked.append(_links(len(s), len(h), both, num, den))
                    far.append(1 - both / (len(s) + len(h) - both))
                    points.append(zlib.compress(_counts([s], min(12, max(6, len(h).bit_length() - 1))).astype("<u4").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(linked, pa.bool_()), pa.array(far, pa.float64()), pa.array(points, pa.binary())], names=["root", "node", "_n", "_parts", "linked", "far", "_point"])

    heads = rows.filter("root = node")
    size = heads.agg(F.sum(F.octet_length("_text") + 64)).first()[0]
    parted = (size or 0) > SMALL
    part = F.pmod(F.xxhash64("node"), "_parts") if parted else F.lit(0).cast("long")
    heads = heads.select("root", (_numbers(F.col("_parts")) if parted else part).alias("_part"), F.col("_text").alias("_head"))
    beside = _beside(rows.withColumn("_part", part), heads, ["root", "_part"], size or 0)
    return beside.select("root", "node", "_n", "_parts", "_text", "_head").mapInArrow(run, _SETS + ", _n long, _parts long, linked boolean, far double, _point binary")


def _resolve(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components within each candidate group of one cell; rows: root, node, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, nodes, sets = None, [], []

        def settle() -> list[tuple]:
            if len(nodes) < 2:
                return []
            return [(nodes[i], nodes[g]) for i, g in enumerate(join_group(sets, num, den).tolist()) if i != g]

        for b in batches:
            out: list[tuple] = []
            roots, own = (b.column(i).to_pylist() for i in range(2))
            for at, part in _slices(b.column(2).to_pylist()):
                for i, s in enumerate(shingle_sets(part, width), at):
                    if roots[i] != root:
                        out += settle()
                        root, nodes, sets = roots[i], [], []
                    nodes.append(own[i])
                    sets.append(s)
            yield _pairs(out)
        yield _pairs(settle())

    return rows.repartition("root").sortWithinPartitions("root").select("root", "node", "_text").mapInArrow(run, "a decimal(38,0), b decimal(38,0)")


def _meet_cells(large: DataFrame, held: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join open sets with each other and with the settled ones of their groups.

    large: node, _text; held: root, node, _n, _parts, linked, far."""
    reach, runs = 1 - num / den + 1e-9, F.ceil(F.col("_parts") * CELL / PART).cast("long")
    # Bands of sizes, a little wider than the ratio of sizes that may link: these are of one band or of neighbouring ones.
    band = F.floor(F.log(F.col("_n").cast("double")) / F.lit(float(np.log(1.005 * den / num)))).cast("int")
    rows = held.withColumn("_band", band)
    # By band of a group: how many cells, and how far from the head the open sets lie. A group has a few dozens of bands.
    open_ = rows.filter(~F.col("linked"))
    bands = open_.groupBy("root", "_band", "_parts").agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_w"), F.min("far").alias("near"), F.max("far").alias("far"))
    bands = bands.select("root", "_parts", F.struct(F.col("_band").alias("band"), F.greatest(F.ceil(F.col("_k") / CELL), F.ceil(F.col("_w") / CELL_SHINGLES)).cast("long").alias("cells"), "near", "far").alias("_b"))
    cells = bands.groupBy("root", "_parts").agg(F.collect_list("_b").alias("_bands")).select("root", _numbers(F.col("_parts")).alias("_part"), "_bands")
    # What goes where, without texts: an open set to a cell of its own band, in each run of those who ask, and all sets near enough
    # to the cells of the three bands, to ask.
    placed = rows.withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts"))).join(cells, ["root", "_part"])
    placed = placed.select("root", "node", "_band", "linked", "far", "_n", "_point", runs.alias("_runs"), F.explode("_bands").alias("_b"))
    own = placed.filter((F.col("_b.band") == F.col("_band")) & ~F.col("linked"))
    own = own.select("root", F.col("_b.band").alias("_band"), F.pmod(F.xxhash64(F.lit(1), "node"), "_b.cells").alias("_cell"), _numbers(F.col("_runs")).alias("_at"), F.lit(0).alias("_asks"), "node", "linked", "_n", "_point")
    asks = placed.filter((F.abs(F.col("_b.band") - F.col("_band")) <= 1) & (F.col("far") >= F.col("_b.near") - reach) & (F.col("far") <= F.col("_b.far") + reach))
    asks = asks.select("root", F.col("_b.band").alias("_band"), _numbers(F.col("_b.cells")).alias("_cell"), F.pmod(F.xxhash64(F.lit(2), "node"), "_runs").alias("_at"), F.lit(1).alias("_asks"), "node", "linked", "_n", "_point")
    by = ["root", "_band", "_cell", "_at"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By their points alone: who asks and could link to a set of the cell, and which sets of it could be meant."""
        key, nodes, held_, cell, meant = None, [], [], None, set()
        for b in batches:
            take: list[int] = []
            extra: list[tuple] = []
            keys = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            kinds, own_, sizes, points = (b.column(i).to_pylist() for i in (4, 5, 7, 8))
            for i, (kind, point) in enumerate(zip(kinds, points, strict=True)):
                q = np.frombuffer(zlib.decompress(point), "<u4").astype(np.int32)
                if keys[i] != key:
                    key, nodes, held_, cell, meant = keys[i], [], [], None, set()
                if not kind:
                    nodes.append(own_[i])
                    held_.append((q, sizes[i]))
                    continue
                if cell is None and not held_:  # no open set was dealt here
                    continue
                if cell is None:
                    cell = CountTree(np.stack([q for q, _ in held_]), np.array([n for _, n in held_], np.int64))
                    held_ = []
                other = [nodes[cell.order[j]] for j in cell.asked(q, sizes[i], num, den).tolist()]
                other = [o for o in other if o != own_[i]]
                if other:
                    take.append(i)
                    new = [o for o in other if o not in meant]
                    meant.update(new)
                    extra += [(key, o) for o in new]
            found = [(*keys[i], 1, own_[i], b.column(6)[i].as_py()) for i in take] + [(*k, 0, o, False) for k, o in extra]
            root, band_, cell_, at, asks_, node, linked = zip(*found, strict=True) if found else [()] * 7
            cols = [pa.array(root, pa.decimal128(38, 0)), pa.array(band_, pa.int32()), pa.array(cell_, pa.int64()), pa.array(at, pa.int64()), pa.array(asks_, pa.int32()), pa.array(node, pa.decimal128(38, 0)), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*by, "_asks", "node", "linked"])

    sorted_ = own.unionByName(asks).repartition(*by).sortWithinPartitions(*by, "_asks").select(*by, "_asks", "node", "linked", "_n", "_point")
    to = checkpointed(sorted_.mapInArrow(near, "root decimal(38,0), _band int, _cell long, _at long, _asks int, node decimal(38,0), linked boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, cell = None, [], [], None
        for b in batches:
            out: list[tuple] = []
            keys = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            kinds, own_, linked = (b.column(i).to_pylist() for i in (4, 5, 6))
            for at, part in _slices(b.column(7).to_pylist()):
                for i, s in enumerate(shingle_sets(part, width), at):
                    if keys[i] != key:
                        key, nodes, sets, cell = keys[i], [], [], None
                    if not kinds[i]:
                        nodes.append(own_[i])
                        sets.append(s)
                        continue
                    if cell is None and nodes:
                        cell = Cell(nodes, sets, num, den)
                        nodes, sets = [], []
                    if cell is not None:
                        out += [(key[0] if linked[i] else own_[i], other) for other in cell.meet(own_[i], s, linked[i])]
            yield _pairs(out)

    texts = _beside(large.select("node", "_text"), to, ["node"], 100 * to.count())
    dealt = texts.repartition(*by).sortWithinPartitions(*by, "_asks")
    return dealt.select(*by, "_asks", "node", "linked", "_text").mapInArrow(run, "a decimal(38,0), b decimal(38,0)")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 3, den: int = 4, docs_per_bucket: int = 4096, text_hash: bool = False) -> DataFrame:
    """One row a document: id_col, n_shingles, component_id (the least id that links reach, its own included), and
    with text_hash the xxhash64 of the text (null as empty) in _th, which tells rows of one id apart."""
    scanned = checkpointed(_scan(docs, id_col, text_col, width))
    rows = scanned.filter("_chunk IS NULL").select("_id", "_th", "_n", "_set", "_name")
    counts = _count_table(scanned)
    buckets = max(12, -(-rows.count() // docs_per_bucket))
    met = components(_meetings(docs, text_col, counts, buckets, width, num, den))

    # One text for each set that met another: the one of the least id and text hash. Its group's number of parts goes along
    # where the group is more than a cell; rows of one group are dealt to SALTS parts for that.
    key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_key")
    chosen = rows.filter("_set IS NOT NULL").groupBy("_set").agg(F.min(F.struct("_id", "_th")).alias("_at"), F.min("_n").alias("_n"), F.min("_name").alias("_name"))
    wanted = checkpointed(met.join(chosen, met["node"] == chosen["_name"]).select("root", F.col("_set").alias("node"), "_n", key(F.col("_at._id")), F.col("_at._th").alias("_th")))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("_n") / CELL_SHINGLES)).cast("long")
    sizes = checkpointed(wanted.groupBy("root").agg(F.min("node").alias("_head"), parts.alias("_parts")).filter("_parts > 1"))
    # Rows that repeat both id and text are made one before the shuffle, and what joins lies as it must; texts travel once.
    texts = docs.select(key(F.col(id_col)), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"), F.col(text_col).alias("_text"))
    texts = texts.groupBy("_key", "_th").agg(F.first("_text").alias("_text"))
    if sizes.isEmpty():
        groups = wanted.join(texts, ["_key", "_th"]).select("root", "node", "_text")
        links = checkpointed(_resolve(groups, width, num, den))
        final = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("_salt")
        marked = wanted.withColumn("_salt", F.xxhash64("node").bitwiseAND(F.lit(SALTS - 1))).join(sizes.select("root", "_head", "_parts", salts), ["root", "_salt"], "left")
        marked = marked.withColumn("root", F.coalesce("_head", "root"))  # of a large group the digest of a set, its head
        groups = checkpointed(marked.join(texts, ["_key", "_th"]).select("root", "node", "_n", "_parts", "_text"))
        release(docs.sparkSession)
        large = groups.filter("_parts IS NOT NULL")
        held = checkpointed(_against_head(large, width, num, den))
        links = _resolve(groups.filter("_parts IS NULL"), width, num, den).unionByName(_meet_cells(large, held, width, num, den))
        final = components(links.unionByName(held.filter("linked AND root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))))

    # Documents by component; those of a very common component are dealt to SALTS parts.
    placed = rows.join(final.withColumnRenamed("node", "_set"), "_set", "left").withColumn("_comp", F.coalesce("root", "_set"))
    placed = placed.select("_id", "_th", "_n", "_comp", F.xxhash64("_id", "_th").bitwiseAND(F.lit(SALTS - 1)).alias("_salt"))
    least = placed.filter("_comp IS NOT NULL").groupBy("_comp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_k")).filter("_k > 1")
    least = least.select("_comp", "_least", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("_salt"))
    found = placed.join(least, ["_comp", "_salt"], "left")
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_least", "_id").alias("component_id"), *(["_th"] if text_hash else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents, all columns, of which each component keeps the row of its least id. Rows that repeat both
    id and text are one document: they stay or go together; rows with null ids stay."""
    inner, (own_id, own_text) = set_aside(docs, id_col, text_col)
    found = near_duplicates(inner, own_id, own_text, text_hash=True, **params)
    stay = found.filter(F.col(own_id).eqNullSafe(F.col("component_id"))).select(F.col(own_id).alias("_stay"), F.col("_th").alias("_stay_th"))
    own = F.xxhash64(F.coalesce(F.col(own_text), F.lit("")))
    return restored(inner.join(stay, F.col(own_id).eqNullSafe(F.col("_stay")) & (own == F.col("_stay_th")), "left_semi"), docs)
