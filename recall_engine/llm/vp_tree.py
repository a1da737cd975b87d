"""Nearest neighbours by largest inner product with vantage-point trees.

Vectors are dealt to shards of bounded size; each shard builds a vantage-point tree and streams queries through it, and the
best of all shards are merged for each query. Inner products are not a metric, so a tree holds its vectors
with one more coordinate that gives all of them the same norm: then the nearest point by distance is the one with the
largest inner product, and the triangle inequality may prune. ``factor`` divides the radius used for pruning: with
one the search is exact, above one it visits fewer nodes and may miss some. Vectors that occur more than once are
one point with several ids, so copies, however many, don't deepen a tree.

Scores are sums in double precision, in the order of the components. Defined results: vectors that are null, zero
or hold null or non-finite components take no part; vectors of different lengths are never compared; ties go to
the smaller id; a row whose id equals the query's is not its candidate; where query ids repeat, the least vector
is the query; rows with a null id are candidates last among equals but never queries; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that are scored at once.
PAIRS = 1 << 15


def usable(v: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


class VpTree:
    """A vantage-point tree over the rows of x, which are distinct, with points in leaves of at most ``leaf``. Of points with the
    same score, those of smaller ``rank`` are nearer (by default, the place in x)."""

    def __init__(self, x: np.ndarray, leaf: int = 256, seed: int = 7, rank: np.ndarray | None = None):
        norms = np.einsum("ij,ij->i", x, x)
        self.points = x
        self.top = float(norms.max(initial=0.0))
        self.x = np.hstack([x, np.sqrt(np.maximum(0.0, self.top - norms))[:, None]])
        self.rank = np.arange(len(x)) if rank is None else rank
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.visited = 0
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = rows[self.rng.integers(len(rows))]
        d = np.linalg.norm(self.x[rows] - self.x[vantage], axis=1)
        radius = float(np.median(d))
        near = d <= radius
        if near.all():  # many at one distance: halve them, both halves are within the radius
            half = len(rows) // 2
            near = np.zeros(len(rows), bool)
            near[np.argsort(d, kind="stable")[:half]] = True
        return vantage, float(d[near].max()), float(d[~near].min()), self._build(rows[near]), self._build(rows[~near])

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k nearest points of each query, nearest first, and their inner products; row -1 where none."""
        if factor < 1:
            raise ValueError("factor must be at least 1")
        self.q = np.hstack([queries, np.zeros((len(queries), 1))])
        self.norm = np.einsum("ij,ij->i", self.q, self.q)
        # What rounding may do to a score, and to a squared distance: far more than it does.
        eps = np.finfo(np.float64).eps * (16 + self.q.shape[1])
        self.slack = eps * np.sqrt(self.norm * self.top) * 4
        self.slack2 = eps * (self.norm + self.top) * 4
        self.rows = np.full((len(queries), k), -1, np.int64)
        self.best = np.full((len(queries), k), -np.inf)
        self.factor = factor
        self._visit(self.root, np.arange(len(queries)))
        return self.rows, self.best

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """The distance to the k-th point so far, over the factor."""
        worst = self.best[q, -1]
        return np.sqrt(np.maximum(0.0, self.norm[q] + self.top - 2 * worst) + self.slack2[q]) / self.factor

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._scan(node, q)
            return
        vantage, inner, outer, near, far = node
        d2 = np.maximum(0.0, self.norm[q] + self.top - 2 * (self.q[q] @ self.x[vantage]))
        first = np.sqrt(d2) <= (inner + outer) / 2
        self._visit(near, q[first])
        self._visit(far, q[~first])
        reach, wide = self._reach(q), 1 + 1e-9
        self._visit(far, q[first & ((np.sqrt(d2 + self.slack2[q]) + reach) * wide >= outer)])
        self._visit(near, q[~first & (np.sqrt(np.maximum(0.0, d2 - self.slack2[q])) - reach <= inner * wide)])

    def _scan(self, rows: np.ndarray, q: np.ndarray) -> None:
        """Holds a leaf's points against queries. The matrix product says which points may be among the nearest; these are scored
        in the order of the components and ordered by score and rank, so ties are exact however many there are."""
        self.visited += len(rows) * len(q)
        rough = self.q[q] @ self.x[rows].T
        k = self.rows.shape[1]
        if rough.shape[1] > k:  # the k best of the leaf, and what may tie with them, are enough
            least = np.partition(rough, -k, axis=1)[:, -k]
        else:
            least = np.full(len(q), -np.inf)
        may = rough >= (np.maximum(self.best[q, -1], least) - 2 * self.slack[q])[:, None]
        at, col = np.nonzero(may)
        if not len(at):
            return
        who = np.unique(at)
        own = q[who]
        asked, point = q[at], rows[col]
        score = np.concatenate([inner_products(self.q[asked[i : i + PAIRS], :-1], self.points[point[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)])
        place = np.concatenate([np.repeat(np.arange(len(own)), k), np.searchsorted(who, at)])
        both = np.concatenate([self.best[own].ravel(), score])
        ids = np.concatenate([self.rows[own].ravel(), rows[col]])
        order = np.lexsort((self.rank[ids], -both, place))
        counts = np.bincount(place, minlength=len(own))
        keep = order[(np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)) < k]
        self.best[own] = both[keep].reshape(-1, k)
        self.rows[own] = ids[keep].reshape(-1, k)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components, so equal vectors score alike wherever they stand."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


class Shard:
    """Vectors of a shard: a tree over the distinct ones, each with its ids in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 256):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        self.points, first, which, self.n = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
        self.by_point = np.argsort(which.reshape(-1), kind="stable")
        self.at = np.append(0, np.cumsum(self.n))
        self.tree = VpTree(self.points, leaf, rank=first)  # ties by the least id of a point

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        """(query place, candidate id, score) of each query's k nearest in the shard, own ids left out."""
        rows, best = self.tree.search(queries, min(k + 1, len(self.points)), factor)
        place, point, score = np.nonzero(rows >= 0)[0], rows[rows >= 0], best[rows >= 0]
        take = np.minimum(self.n[point], k + 1)  # a point's smallest ids are enough: one of them may be the query's own
        owner = np.repeat(np.arange(len(point)), take)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take)
        found = self.ids[self.by_point[self.at[point[owner]] + within]]
        place, score = place[owner], score[owner]
        other = found != query_ids[place]
        place, found, score = place[other], found[other], score[other]
        order = np.lexsort((found, -score, place))
        place, found, score = place[order], found[order], score[order]
        counts = np.bincount(place, minlength=len(queries))
        rank = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
        return place[rank < k], found[rank < k], score[rank < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 16_384, block_rows: int = 262_144) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by inner product.

    A task gathers a shard's vectors, at most about shard_rows, builds its tree, and streams a block of at most about
    block_rows queries through it, a batch at a time. A tree is built again only for a further block, which costs far less than
    searching it that often.
    """
    given = lambda df: df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    # Of rows that share id and vector no more than k + 1 can be among anyone's nearest.
    known = given(vectors.filter(usable(F.col(vec_col)))).groupBy("_id", "_v").agg(F.count(F.lit(1)).alias("_n"))
    copies = F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(k + 1)).cast("int")))
    asked = given(queries.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull())).groupBy("_id").agg(F.min("_v").alias("_v"))
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.select("_id", "_v", copies.alias("_copy")).select("_id", "_v", F.pmod(F.xxhash64("_id", "_v", "_copy"), F.lit(shards)).cast("int").alias("_shard"), numbers(blocks).alias("_block"), F.lit(False).alias("_asks"))
    right = asked.select("_id", "_v", numbers(shards).alias("_shard"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_block"), F.lit(True).alias("_asks"))
    none = np.iinfo(np.int64).max

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of dimension, shard and block, the vectors of each before its queries."""
        key, shard, held = None, None, []
        for b in batches:
            heads = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            ids = b.column(4).fill_null(none).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(heads, axis=0) != 0).any(axis=1)) + 1).tolist(), len(heads)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                *own, asks = heads[i].tolist()
                if own != key:
                    key, shard, held = own, None, []
                x = _matrix(b.column(5).slice(i, j - i), own[0])
                if not asks:
                    held.append((ids[i:j], x))
                    continue
                if shard is None and held:
                    shard, held = Shard(np.concatenate([a for a, _ in held]), np.concatenate([v for _, v in held])), []
                if shard is None:
                    continue
                place, found, score = shard.search(ids[i:j], x, k, factor)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][place], pa.int64()), pa.array(found, pa.int64(), mask=found == none), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["_dim", "_shard", "_block", "_asks"]
    dealt = left.unionByName(right).withColumn("_dim", F.size("_v")).repartition(*keys[:3]).sortWithinPartitions(*keys)
    found = dealt.select(*keys, "_id", "_v").mapInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
