"""Offline calibration of ranking weights, and metrics of retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_engine.operators.lexical import checked_broadcast
from recall_engine.operators.order import numbered, running
from recall_engine.operators.ranking import TERMS
from recall_engine.params import PARAMS, Params


#: So many places, 0 included, are counted in one array.
_NEAR = 33


def episodes(outcomes: DataFrame, explanations: DataFrame) -> DataFrame:
    """(episode, task_id, found, message_id, terms) from found outcomes and what was explained of their retrieval.
    explanations: interaction_id, message_id and a column for each term."""
    found = outcomes.filter(F.col("outcome") == "found").select("interaction_id", "task_id", F.col("outcome_message_id").alias("found"))
    return found.join(explanations, "interaction_id").select(F.col("interaction_id").alias("episode"), "task_id", "found", "message_id", *TERMS)


def simplex(spark: SparkSession, step: float, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """All weight vectors of multiples of step that sum to one: grid_id and a column w_x for each term x; terms not named
    weigh nothing."""
    units = int(1 / step + 0.5)
    grid = spark.range(1).select()
    for t in terms[:-1]:
        grid = grid.crossJoin(spark.range(units + 1).select(F.col("id").alias(f"_{t}")))
        grid = grid.filter(sum((F.col(f"_{x}") for x in terms[: terms.index(t) + 1]), F.lit(0)) <= units)
    rest = F.lit(units) - sum((F.col(f"_{x}") for x in terms[:-1]), F.lit(0))
    units_of = {x: F.col(f"_{x}") for x in terms[:-1]} | {terms[-1]: rest}
    w = [(units_of[x] / units if x in units_of else F.lit(0.0)).alias(f"w_{x}") for x in TERMS]
    key = sum((units_of[x].cast("long") * (units + 1) ** (len(terms) - 1 - i) for i, x in enumerate(terms)), F.lit(0).cast("long"))
    return grid.select((-key).alias("grid_id"), *w)


def holdout(eps: DataFrame, every: int = PARAMS.holdout_every) -> DataFrame:
    """Episodes with holdout: every n-th task in sorted order. Only the distinct tasks are put in order, by ranges."""
    tasks = numbered(eps.select("task_id").distinct(), ["task_id"], name="_nth").select("task_id", (F.col("_nth") % every == 0).alias("holdout"))
    marked = eps.join(tasks.withColumnRenamed("task_id", "_task"), F.col("task_id").eqNullSafe(F.col("_task")))
    return marked.drop("_task")


def found_ranks(eps: DataFrame, grid: DataFrame) -> DataFrame:
    """(grid_id, episode, place): the rank of what was found under each weight vector, 0 where it isn't listed.

    The place is one more than the number of candidates that come before; nothing is sorted. The grid has a fixed
    size, whatever the number of episodes.
    """
    value = F.col("r") * F.col("w_r")
    for t in TERMS[1:]:
        value = value + F.col(t) * F.col(f"w_{t}")
    scored = eps.crossJoin(checked_broadcast(grid)).withColumn("_s", value)
    own = F.when(F.col("message_id") == F.col("found"), F.struct("_s", "message_id"))
    best = scored.withColumn("_f", F.max(own).over(Window.partitionBy("grid_id", "episode")))
    before = (F.col("_s") > F.col("_f._s")) | ((F.col("_s") == F.col("_f._s")) & (F.col("message_id") < F.col("_f.message_id")))
    return best.groupBy("grid_id", "episode").agg(F.when(F.max("_f").isNull(), 0).otherwise(F.count_if(before) + 1).alias("place"))


def place_counts(eps: DataFrame, grid: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(grid_id, by, place, n): in how many episodes each place comes up, as ``found_ranks`` has them. An episode's candidates
    meet all weight vectors in one task, so only counts are shuffled; the grid has a fixed size.

    How far each candidate is ahead of what was found is one product of matrices in single precision. Where that is nearer to zero
    than rounding may account for, the vector's scores are made again in double precision, term by term, as ``found_ranks`` makes them."""
    held = grid.select("grid_id", *[f"w_{t}" for t in TERMS]).toPandas()
    ids, w = held["grid_id"].to_numpy(np.int64), held[[f"w_{t}" for t in TERMS]].to_numpy(np.float64).T
    own = F.coalesce(F.col("message_id") == F.col("found"), F.lit(False)).alias("own")
    # place of a candidate's id among the episode's, so ids of any type compare alike
    listed = eps.groupBy("episode", *by).agg(F.array_sort(F.collect_list(F.struct("message_id", own, *TERMS))).alias("c"))
    flag = F.col(by[0]) if by else F.lit(False)
    part = F.col("c").getField
    listed = listed.select(flag.alias("_by"), F.transform(part("message_id"), lambda x: F.array_position(part("message_id"), x)).alias("order"), part("own").alias("own"), *[part(t).alias(t) for t in TERMS])

    weighed = w.any(1)  # terms that weigh nothing in any vector
    single, most_weight = np.ascontiguousarray(w[weighed], np.float32), float(np.abs(w).sum(0).max(initial=0.0))

    def scores(x: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        out = x[0][:, None] * w[0][at]
        for i in range(1, len(TERMS)):
            out += x[i][:, None] * w[i][at]
        return out

    def places(x: np.ndarray, own: np.ndarray, order: np.ndarray) -> np.ndarray:
        """x: a row for each term. One more than the number of candidates before the found one, 0 without it; nulls are nan."""
        first = np.flatnonzero(own)
        if not len(first):
            return np.zeros(len(ids), np.int64)
        size = np.abs(x).max() * most_weight
        if len(first) == 1 and 1e-30 < size < 1e30:
            ahead = (np.delete(x, first, 1) - x[:, first])[weighed].T.astype(np.float32) @ single
            slack = np.float32(size * 1e-5)
            least = np.add.reduce((ahead > slack).view(np.int8), 0, np.int64 if len(own) > 100 else np.int8)
            most = np.add.reduce((ahead >= -slack).view(np.int8), 0, least.dtype)
            at = np.flatnonzero(least != most)
            place = least + least.dtype.type(1)
        else:
            at, place = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        if len(at):
            score = scores(x, at)
            f = score[own].max(0)
            before = (score > f) | (score == f) & (order < order[first[0]])[:, None]
            place[at] = before.sum(0) + 1
        return place

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[bool, np.ndarray] = {}  # by flag: a row for each of the first places, 0 included
        far: dict[tuple[bool, int], np.ndarray] = {}
        column = np.arange(len(ids))
        for b in batches:
            parts = [b.column(i) for i in range(b.num_columns)]
            lengths = np.asarray(pc.list_value_length(parts[1]), np.int64)
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in parts[1:]]
            orders, owns, x = flat[0], flat[1].astype(bool), np.array(flat[2:], np.float64)
            for flag, to, n in zip(parts[0].to_pylist(), np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
                own = slice(to - n, to)
                place = places(x[:, own], owns[own], orders[own])
                if flag not in near:
                    near[flag] = np.zeros((_NEAR, len(ids)), np.int64)
                held = near[flag]
                if n < _NEAR:
                    held.reshape(-1)[place * np.int64(len(ids)) + column] += 1
                    continue
                for k in np.unique(place).tolist():
                    at = held[k] if k < _NEAR else far.setdefault((flag, k), np.zeros(len(ids), np.int64))
                    at += place == k
        every = [(flag, k, n) for flag, held in near.items() for k, n in enumerate(held)] + [(flag, k, n) for (flag, k), n in far.items()]
        for flag, k, n in every:
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array([flag] * len(has), pa.bool_()), pa.array([k] * len(has), pa.int64()), pa.array(n[has])], names=["grid_id", "_by", "place", "n"])

    counted = listed.mapInArrow(count, "grid_id long, _by boolean, place long, n long").groupBy("grid_id", "_by", "place").agg(F.sum("n").alias("n"))
    return counted.withColumnRenamed("_by", by[0]) if by else counted.drop("_by")


def _figures(listed: str, prefix: str = "") -> list[Column]:
    """success_at_5, mrr and the number of episodes, from an array of (place, n); null if it is empty."""
    n = F.aggregate(listed, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    hit = F.aggregate(F.filter(listed, lambda x: x["place"].between(1, 5)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    gain = F.aggregate(F.filter(listed, lambda x: x["place"] > 0), F.lit(0.0), lambda a, x: a + x["n"] / x["place"])
    some = F.size(listed) > 0
    return [F.when(some, hit / n).alias(f"{prefix}success_at_5"), F.when(some, gain / n).alias(f"{prefix}mrr"), n.alias(f"{prefix}episodes")]


def evaluate_counts(counts: DataFrame) -> DataFrame:
    """What ``evaluate`` gives, from counts of places, summed in order of place, so that equal counts tie."""
    return counts.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("_c")).select("grid_id", *_figures("_c"))


def calibrate_fine(eps: DataFrame, grid: DataFrame, every: int = PARAMS.holdout_every) -> DataFrame:
    """What ``calibrate`` gives, for grids of thousands of vectors. Places are counted once for training and held-out episodes."""
    each = F.struct("place", "n")
    both = place_counts(holdout(eps, every), grid, ("holdout",)).groupBy("grid_id").agg(*[F.array_sort(F.collect_list(F.when(which, each))).alias(c) for c, which in (("_c", ~F.col("holdout")), ("_h", F.col("holdout")))])
    best = both.filter(F.size("_c") > 0).select("grid_id", *_figures("_c"), *_figures("_h", "holdout_")).drop("holdout_episodes").orderBy(F.desc("success_at_5"), F.desc("mrr"), "grid_id").limit(1)
    enough = eps.agg(F.count_distinct("episode").alias("_n")).filter("_n >= 8")
    return best.join(grid, "grid_id").crossJoin(enough)


def evaluate(ranks: DataFrame, by: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """(success_at_5, mrr): found among the first five, and the mean reciprocal rank; what isn't found counts as none."""
    hit = F.when(F.col("place").between(1, 5), 1.0).otherwise(0.0)
    return ranks.groupBy(*by).agg(F.avg(hit).alias("success_at_5"), F.avg(F.when(F.col("place") > 0, 1.0 / F.col("place")).otherwise(0.0)).alias("mrr"), F.count(F.lit(1)).alias("episodes"))


def calibrate(eps: DataFrame, grid: DataFrame, every: int = PARAMS.holdout_every) -> DataFrame:
    """One row: the best weights on the training episodes (success at 5, then reciprocal rank, then the first vector), with
    its figures there and on the held-out episodes. Fewer than eight episodes are refused: no row."""
    split = holdout(eps, every).select("episode", "holdout").distinct()
    ranks = found_ranks(eps, grid).join(split, "episode")
    best = evaluate(ranks.filter(~F.col("holdout"))).orderBy(F.desc("success_at_5"), F.desc("mrr"), "grid_id").limit(1)
    held = evaluate(ranks.filter("holdout")).select("grid_id", F.col("success_at_5").alias("holdout_success_at_5"), F.col("mrr").alias("holdout_mrr"))
    enough = eps.agg(F.count_distinct("episode").alias("_n")).filter("_n >= 8")
    return best.join(held, "grid_id", "left").join(grid, "grid_id").crossJoin(enough)


def rank_stats(explained: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(term, n, least, median, most, mean) of weight times value; the median is the element at half the count. Equal
    values are counted before the shuffle, and the distinct ones placed by ranges."""
    each = F.array(*[F.struct(F.lit(t).alias("term"), (F.col(t) * float(weights.get(t, 0.0))).alias("x")) for t in TERMS])
    counted = explained.select(F.explode(each).alias("_t")).select("_t.*").groupBy("term", "x").agg(F.count(F.lit(1)).alias("_c"))
    placed = running(counted, "_c", ["x"], ["term"], "_to", "_n")
    middle = (F.expr("_n div 2") < F.col("_to")) & (F.expr("_n div 2") >= F.col("_to") - F.col("_c"))
    return placed.groupBy("term").agg(
        F.max("_n").cast("long").alias("n"), F.min("x").alias("least"), F.max(F.when(middle, F.col("x"))).alias("median"), F.max("x").alias("most"), (F.sum(F.col("x") * F.col("_c")) / F.sum("_c")).alias("mean")
    )


def success_at_5(outcomes: DataFrame, explanations: DataFrame) -> DataFrame:
    """(outcomes, at_5): found outcomes whose message was explained at rank five or better."""
    done = outcomes.filter(F.col("outcome").isin("found", "not_found", "workaround"))
    good = explanations.filter(F.col("final_rank") <= 5).select("interaction_id", F.col("message_id").alias("outcome_message_id"), F.lit(True).alias("_hit")).distinct()
    found = done.join(good, ["interaction_id", "outcome_message_id"], "left")
    return found.agg(F.count(F.lit(1)).alias("outcomes"), F.count_if(F.col("_hit") & (F.col("outcome") == "found")).alias("at_5"))
