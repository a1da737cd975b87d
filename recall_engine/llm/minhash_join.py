"""Near-duplicate groups: a multi-index Hamming join of b-bit MinHash signatures, confirmed on the full sets.

Two documents link when the Jaccard similarity of their sets of word shingles is at least num / den. A signature has
``symbols`` places of ``bits`` bits, each the hash of the set's least shingle under one of as many orders; two sets differ in a
place with a chance of one less their similarity, so few places differ for sets that link.

1. One scan gives each document's set size, set digest and signature. Equal sets are one node from here on.
2. The signature is cut into chunks. If two signatures differ in at most ``distance`` places, then by the pigeonhole principle some
   chunk i has at most its own allowance of errors, where allowances and ones add up to distance + 1. All ways to leave
   out so many places of a chunk are enumerated, and what is left is a key: such two signatures share one, always. Sets that
   share a key, and whose signatures are within the distance, are candidates; a forest over them goes on.
3. The connected components of the candidates are the groups in which links lie. The texts of a group come together once;
   pairs within the distance, nearest first, are verified on their full sets, unless links found before join them already. Groups that are
   larger than a task may hold never come together: they are settled in cells that others stream past (``ngram_join``).

A key that very many sets have is a large group of near copies. What a task sends of it is joined before the shuffle, and only
one of its sets travels; where more than ``run`` sets meet they are one group without comparing pairs, which is a coarser group and
loses no candidate. So no task holds a key's sets, and no pairs are made within a group.

What may be lost: a pair whose signatures are further apart than the distance. With 64 places and a distance of 31 that
is 32 or more of 64 places that differ, each with a chance of at most 0.2 for sets that link at 0.8: about eight pairs
in a hundred million at just 0.8, and far fewer above. Everything else is exact.

Words are runs of characters other than blanks, with A-Z in lower case; a document with fewer than ``width`` words but at least
one has its whole sequence as its only shingle. Defined results: null and empty texts, and texts of blanks, have no shingles,
link with nothing and are their own component; rows with equal or null ids each count; a component of null ids alone has a
null id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm import ngram_join as nj
from recall_engine.llm.common import checkpointed, hold, release, restored, set_aside

_U = np.uint64
_ODD = np.random.default_rng(20240607).integers(1, 1 << 63, 4096, np.uint64) * _U(2) + _U(1)


@dataclass(frozen=True)
class Scheme:
    """How signatures are made and met: places, bits of a place, chunks, and the distance up to which all pairs are found; how many
    sets that share a key are compared by their signatures, where more are one group; sets whose keys a task looks at together."""

    symbols: int = 64
    bits: int = 16
    chunks: int = 16
    distance: int = 31
    run: int = 32
    batch: int = 8192

    def __post_init__(self) -> None:
        if self.symbols % (4 * self.chunks) or not 4 <= self.bits <= 16 or self.symbols > len(_ODD):
            raise ValueError("symbols must be a multiple of four times the chunks, bits from 4 to 16")
        if not 0 <= self.distance or max(self.allowed) >= self.symbols // self.chunks:
            raise ValueError("the distance lets a chunk differ in all places")

    @property
    def allowed(self) -> list[int]:
        """The errors that each chunk may have; -1 for one that need not be asked. With one more for each chunk they are distance + 1."""
        each, more = divmod(self.distance + 1, self.chunks)
        return [each - 1 + (i < more) for i in range(self.chunks)]

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """(set, place) of sets that aren't empty."""
        out = np.empty((len(sets), self.symbols), np.uint16)
        if not sets:
            return out
        every = np.concatenate(sets)
        at = np.cumsum([0, *map(len, sets[:-1])])
        for k in range(self.symbols):
            out[:, k] = nj._mix(np.minimum.reduceat(every * _ODD[k], at)) & _U((1 << self.bits) - 1)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(set, key): hashes of what is left of each chunk when so many of its places are left out as it may have errors."""
        width = self.symbols // self.chunks
        out = []
        for c, errors in enumerate(self.allowed):
            if errors < 0:
                continue
            own = signatures[:, c * width : (c + 1) * width].astype(np.uint64)
            for left in itertools.combinations(range(width), width - errors):
                h = np.full(len(own), c << 32, np.uint64)
                for i in left:
                    h = nj._mix(h * nj._BASE + (own[:, i] << _U(8) | _U(i + 1)))
                out.append(h)
        return np.stack(out, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of places that differ, row by row."""
    return np.count_nonzero(a != b, axis=1)


#: How many of a byte's four pairs of bits aren't zero.
_PAIRS = np.array([sum(x >> k & 3 != 0 for k in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def _low_bits(signatures: np.ndarray) -> np.ndarray:
    """The low two bits of each place, four places a byte: what differs in them differs in the signature."""
    low = (signatures & 3).astype(np.uint8)
    return low[:, 0::4] << 6 | low[:, 1::4] << 4 | low[:, 2::4] << 2 | low[:, 3::4]


def _low_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most the number of places that differ; for sets that have nothing in common about three quarters of them."""
    return _PAIRS[a ^ b].sum(axis=1, dtype=np.int64)


def _scan(docs: DataFrame, id_col: str, text_col: str, width: int, scheme: Scheme) -> DataFrame:
    """Rows of documents: id, text hash, set size, digest and signature."""
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("_th", "_n")), T.StructField("_set", nj.NODE), T.StructField("_sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash_join")
        for b in batches:
            n, digest, sig = [], [], []
            for _, part in nj._slices(b.column(2).to_pylist()):
                sets = nj.shingle_sets(part, width)
                n += [len(s) for s in sets]
                digest += [nj.set_digest(s) if len(s) else None for s in sets]
                made = iter(scheme.signatures([s for s in sets if len(s)]))
                sig += [next(made).astype("<u2").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), nj._decimals(*nj._digests(digest)), pa.array(sig, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.col(text_col).cast("string")).mapInArrow(run, schema)


#: An entry as bytes: kind, digest, and the signature's low bits, or for an edge the other digest.
SET, MANY, EDGE = 0, 1, 2


def _entries(kind: int | np.ndarray, digests: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = np.zeros((len(digests), 17 + rest.shape[1]), np.uint8)
    out[:, 0] = kind
    out[:, 1:17] = np.ascontiguousarray(digests, np.int64).view(np.uint8).reshape(-1, 16)
    out[:, 17:] = rest
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a column of binary values, without a copy a value."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _digest_of(entries: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(entries[:, 1:17]).view(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin in a sorted array, and their lengths."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def _sent(digests: np.ndarray, signatures: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(keys, entries) of a batch of sets. A key that more than ``run`` of them have sends one of them, marked, and edges that
    join the others to it; over all such keys of the batch a set has one edge at most."""
    keys = scheme.keys(signatures)
    own = np.repeat(np.arange(len(keys)), keys.shape[1])
    keys = keys.reshape(-1)
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], own[order]
    first, size = _runs(keys)
    many = size > scheme.run
    at = np.repeat(many, size)
    lead = np.repeat(own[first], size)
    pairs = np.unique(np.stack([own[at], lead[at]], axis=1), axis=0)
    a, b = nj._forest(len(digests), pairs[pairs[:, 0] != pairs[:, 1]])
    low = _low_bits(signatures)
    low = np.pad(low, ((0, 0), (0, max(0, 16 - low.shape[1]))))  # an edge's other digest has sixteen bytes
    keep = ~at
    keep[first[many]] = True
    kind = np.where(at, MANY, SET)[keep]
    rest = np.zeros((len(a), low.shape[1]), np.uint8)
    rest[:, :16] = np.ascontiguousarray(digests[b], np.int64).view(np.uint8).reshape(-1, 16)
    entries = np.concatenate([_entries(kind, digests[own[keep]], low[own[keep]]), _entries(EDGE, digests[a], rest)])
    return np.concatenate([keys[keep].view(np.int64), digests[a][:, 0]]), entries


def _met(keys: np.ndarray, entries: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Pairs of places: sets of each key whose signatures are within the distance, or that are too many to compare."""
    first, size = _runs(keys)
    coarse = (size > scheme.run) | np.logical_or.reduceat(entries[:, 0] == MANY, first)
    lead, rough = np.repeat(first, size), np.repeat(coarse, size)
    found = [np.stack([np.flatnonzero(rough), lead[rough]], axis=1)]
    fine = np.flatnonzero(~rough & (np.repeat(size, size) > 1))
    keys, low = keys[fine], entries[fine, 17:]
    for d in range(1, scheme.run):
        at = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(at):
            break
        near = at[_low_distances(low[at], low[at + d]) <= scheme.distance]
        found.append(np.stack([fine[near], fine[near + d]], axis=1))
    return np.concatenate(found)


def candidates(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) of digests: a forest, key by key, over the sets that may link. nodes: _set, _sig."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            raw = t.column(0).combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            digests = np.frombuffer(raw.buffers()[1], np.int64).reshape(-1, 2)[raw.offset : raw.offset + len(raw)]
            sig = np.frombuffer(b"".join(t.column(1).to_pylist()), "<u2").reshape(-1, scheme.symbols)
            keys, entries = _sent(digests, sig, scheme)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _binary(entries)], names=["_key", "_item"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= scheme.batch:
                yield flush()
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, over = np.zeros(0, np.int64), None

        def joined(keys: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
            digests = _digest_of(entries)
            pairs = _met(keys, entries, scheme)
            place, distinct = nj._dense(digests)
            pairs = np.unique(np.sort(place[pairs], axis=1), axis=0)
            nodes_, ends = np.unique(pairs, return_inverse=True)
            a, b = nj._forest(len(nodes_), ends.reshape(-1, 2)[pairs[:, 0] != pairs[:, 1]]) if len(pairs) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([nj._decimals(distinct[nodes_[a]]), nj._decimals(distinct[nodes_[b]])], schema=nj._PAIR)

        for batch in batches:
            if not batch.num_rows:
                continue
            entries = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys = batch.column(0).to_numpy()
            edge = entries[:, 0] == EDGE
            if edge.any():
                own, other = _digest_of(entries[edge]), np.ascontiguousarray(entries[edge, 17:33]).view(np.int64)
                yield pa.RecordBatch.from_arrays([nj._decimals(own), nj._decimals(other)], schema=nj._PAIR)
                keys, entries = keys[~edge], entries[~edge]
            if over is not None:
                keys, entries = np.concatenate([last, keys]), np.concatenate([over, entries])
            if not len(keys):
                continue
            # The last key may go on in the next batch; of one with many sets only the first is kept, marked.
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if len(keys) - cut > scheme.run or (entries[cut:, 0] == MANY).any():
                yield joined(keys, entries)
                last, over = keys[cut : cut + 1], entries[cut : cut + 1].copy()
                over[:, 0] = MANY
            else:
                last, over = keys[cut:], entries[cut:]
                if cut:
                    yield joined(keys[:cut], entries[:cut])
        if over is not None:
            yield joined(last, over)

    entries = nodes.select("_set", "_sig").mapInArrow(send, "_key long, _item binary")
    dealt = entries.repartition("_key").sortWithinPartitions("_key")
    return dealt.mapInArrow(meet, "a decimal(38,0), b decimal(38,0)").distinct()


def join_group(sets: list[np.ndarray], signatures: np.ndarray, num: int, den: int, distance: int) -> np.ndarray:
    """The components of the links among sets: for each its component. Pairs whose signatures are within the distance are
    verified, a set's nearest first, unless they are joined already."""
    group = np.arange(len(sets))
    for i in range(len(sets) - 1):
        far = np.count_nonzero(signatures[i + 1 :] != signatures[i], axis=1)
        near = np.flatnonzero((far <= distance) & (group[i + 1 :] != group[i]))
        for j in (near[np.argsort(far[near], kind="stable")] + i + 1).tolist():
            if group[j] != group[i] and nj._links(len(sets[i]), len(sets[j]), nj.overlap(sets[i], sets[j]), num, den):
                group[group == group[j]] = group[i]
    return group


def _confirmed(rows: DataFrame, width: int, num: int, den: int, scheme: Scheme) -> DataFrame:
    """Links (a, b) that join the components within each group of candidates; rows: root, node, _sig, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, nodes, sets, sigs = None, [], [], []

        def settle() -> list[tuple]:
            if len(nodes) < 2:
                return []
            found = join_group(sets, np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1), num, den, scheme.distance)
            return [(nodes[i], nodes[g]) for i, g in enumerate(found.tolist()) if i != g]

        for b in batches:
            out: list[tuple] = []
            roots, own, sig = (b.column(i).to_pylist() for i in range(3))
            for at, part in nj._slices(b.column(3).to_pylist()):
                for i, s in enumerate(nj.shingle_sets(part, width), at):
                    if roots[i] != root:
                        out += settle()
                        root, nodes, sets, sigs = roots[i], [], [], []
                    nodes.append(own[i])
                    sets.append(s)
                    sigs.append(sig[i])
            yield nj._pairs(out)
        yield nj._pairs(settle())

    return rows.repartition("root").sortWithinPartitions("root").select("root", "node", "_sig", "_text").mapInArrow(run, "a decimal(38,0), b decimal(38,0)")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, num: int = 4, den: int = 5, scheme: Scheme = Scheme(), text_hash: bool = False) -> DataFrame:
    """One row a document: id_col, n_shingles, component_id (the least id that links reach, its own included), kept (it is
    that one), and with text_hash the xxhash64 of the text (null as empty) in _th, which tells rows of one id apart."""
    rows = checkpointed(_scan(docs, id_col, text_col, width, scheme))
    nodes = rows.filter("_set IS NOT NULL").groupBy("_set").agg(F.min(F.struct("_id", "_th")).alias("_at"), F.min("_n").alias("_n"), F.min("_sig").alias("_sig"))
    nodes = checkpointed(nodes)
    met = nj.components(candidates(nodes, scheme))

    # One text for each candidate: that of the least id and text hash. Rows that repeat both are made one before the shuffle.
    key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("_key")
    wanted = checkpointed(met.join(nodes, met["node"] == nodes["_set"]).select("root", "node", "_n", "_sig", key(F.col("_at._id")), F.col("_at._th").alias("_th")))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / nj.CELL), F.ceil(F.sum("_n") / nj.CELL_SHINGLES)).cast("long")
    sizes = checkpointed(wanted.groupBy("root").agg(parts.alias("_parts")).filter("_parts > 1"))
    texts = docs.select(key(F.col(id_col)), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"), F.col(text_col).alias("_text"))
    texts = texts.groupBy("_key", "_th").agg(F.first("_text").alias("_text"))
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(nj.SALTS)])).alias("_salt")
    if sizes.isEmpty():
        # each link leads to the one set that stands for its component
        links = checkpointed(_confirmed(wanted.join(texts, ["_key", "_th"]), width, num, den, scheme))
        final = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        marked = wanted.withColumn("_salt", F.xxhash64("node").bitwiseAND(F.lit(nj.SALTS - 1))).join(sizes.select("root", "_parts", salts), ["root", "_salt"], "left")
        groups = checkpointed(marked.join(texts, ["_key", "_th"]).select("root", "node", "_n", "_parts", "_sig", "_text"))
        release(docs.sparkSession)
        large = groups.filter("_parts IS NOT NULL").drop("_sig")
        held = checkpointed(nj._against_head(large, width, num, den))
        links = _confirmed(groups.filter("_parts IS NULL"), width, num, den, scheme).unionByName(nj._meet_cells(large, held, width, num, den))
        final = nj.components(links.unionByName(held.filter("linked AND root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))))

    # Documents by component; those of a very common component are dealt to SALTS parts.
    placed = rows.join(final.withColumnRenamed("node", "_set"), "_set", "left").withColumn("_comp", F.coalesce("root", "_set"))
    placed = placed.select("_id", "_th", "_n", "_comp", F.xxhash64("_id", "_th").bitwiseAND(F.lit(nj.SALTS - 1)).alias("_salt"))
    least = placed.filter("_comp IS NOT NULL").groupBy("_comp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_comp", "_least", salts)
    found = placed.join(least, ["_comp", "_salt"], "left")
    component = F.coalesce("_least", "_id")
    return found.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"), *(["_th"] if text_hash else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents, all columns, of which each component keeps the row of its least id. Rows that repeat both
    id and text are one document: they stay or go together; rows with null ids stay."""
    inner, (own_id, own_text) = set_aside(docs, id_col, text_col)
    stay = near_duplicates(inner, own_id, own_text, text_hash=True, **params).filter("kept").select(F.col(own_id).alias("_stay"), F.col("_th").alias("_stay_th"))
    own = F.xxhash64(F.coalesce(F.col(own_text), F.lit("")))
    return restored(inner.join(stay, F.col(own_id).eqNullSafe(F.col("_stay")) & (own == F.col("_stay_th")), "left_semi"), docs)
