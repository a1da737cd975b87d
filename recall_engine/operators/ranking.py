"""Additive, explainable ranking: rank fusion, percentiles, profiles, final order, quota and budget.

Every operator works on many queries at once; ``query_id`` partitions all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions.values import effective_priority, freshness
from recall_engine.params import PARAMS, Params, Weights

TERMS = ("r", "s", "f", "p", "i", "n")


def rrf(lists: dict[str, DataFrame], k: int = PARAMS.rrf_k) -> DataFrame:
    """(query_id, message_id, one rank for each list, rrf): the full outer union of ranked lists, with the sum of
    1 / (k + rank)."""
    out = None
    for name, ranked in lists.items():
        one = ranked.select("query_id", "message_id", F.col("rank").alias(name))
        out = one if out is None else out.join(one, ["query_id", "message_id"], "full_outer")
    total = sum((F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(n)), F.lit(0.0)) for n in lists), F.lit(0.0))
    return out.withColumn("rrf", total)


def percentile(value: Column, by: str = "query_id") -> Column:
    """The share of the others that are strictly smaller; 1 for one alone."""
    alone = F.count(F.lit(1)).over(Window.partitionBy(by)) == 1
    return F.when(alone, F.lit(1.0)).otherwise(F.percent_rank().over(Window.partitionBy(by).orderBy(value)))


def intent(pinned: Column, confirmed: Column, p: Params = PARAMS) -> Column:
    return F.when(pinned, p.intent_pin).when(confirmed, p.intent_confirm).otherwise(0.0)


def score(w: Weights) -> Column:
    """The weighted sum, term by term in a fixed order, so that it can be recomputed exactly."""
    return F.col("r") * w.r + F.col("s") * w.s + F.col("f") * w.f + F.col("p") * w.p + F.col("i") * w.i + F.col("n") * w.n


def mandatory_class(c: Column) -> Column:
    return F.when(c == "recipient", 0).when(c == "pin", 1).when(c == "subscription", 2).otherwise(3)


def rank(candidates: DataFrame, weights: Weights, now: Column, half: float, uniform: bool = False, p: Params = PARAMS) -> DataFrame:
    """The candidates with r, s, f, p, i, n, score and final_rank.

    candidates: query_id, message_id, event_id, created_at, priority, rrf, pinned, confirmed, mandatory, and salience
    and novelty (zero where null). uniform: relevance is 1 for all, for requests without a query.
    """
    scored = candidates.withColumns(
        {
            "r": F.lit(1.0) if uniform else percentile(F.col("rrf")),
            "s": F.coalesce("salience", F.lit(0.0)),
            "f": freshness(F.col("created_at"), now, half),
            "p": effective_priority(F.col("priority"), F.col("created_at"), now, F.col("pinned") | F.col("confirmed"), p),
            "i": intent(F.col("pinned"), F.col("confirmed"), p),
            "n": F.coalesce("novelty", F.lit(0.0)),
        }
    ).withColumn("score", score(weights))
    order = Window.partitionBy("query_id").orderBy(mandatory_class(F.col("mandatory")), F.desc("score"), F.desc("created_at"), "event_id")
    return scored.withColumn("final_rank", F.row_number().over(order))


def exploration_quota(ranked: DataFrame, k: int, impressions: Column, p: Params = PARAMS) -> DataFrame:
    """The k rows of each query that stay: the best k - q by rank, then up to q that few have seen, then the next best.
    q is a tenth of k, rounded down; the order by rank stays."""
    quota = int(k * p.exploration + 1e-9)
    if quota < 1:
        return ranked.filter(F.col("final_rank") <= k)
    by = Window.partitionBy("query_id")
    merit = F.col("final_rank") <= k - quota
    fresh = ~merit & (F.coalesce(impressions, F.lit(0)) < p.new_impressions)
    marked = ranked.withColumn("_fresh", fresh).withColumn("_nth", F.sum(F.col("_fresh").cast("int")).over(by.orderBy("final_rank")))
    marked = marked.withColumn("_tier", F.when(merit, 0).when(F.col("_fresh") & (F.col("_nth") <= quota), 1).otherwise(2))
    placed = marked.withColumn("_place", F.row_number().over(by.orderBy("_tier", "final_rank")))
    return placed.filter(F.col("_place") <= k).drop("_fresh", "_nth", "_tier", "_place")


def within_budget(items: DataFrame, budget: int, rendered: str = "rendered", order: str = "final_rank", header_chars: int = 0, marker: str = "TRUNCATED\n") -> DataFrame:
    """The items with running_chars and included: the longest prefix whose rendered text fits, with the header and,
    unless the item is the last, the marker. The first item that doesn't fit ends it."""
    by = Window.partitionBy("query_id")
    run = by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.char_length(rendered)).over(run) + F.lit(header_chars)
    last = F.col(order) == F.max(order).over(by)
    fits = (F.col("running_chars") + F.when(last, 0).otherwise(len(marker))) <= budget
    sized = items.withColumn("running_chars", total.cast("long")).withColumn("_fits", fits.cast("int"))
    return sized.withColumn("included", (F.min("_fits").over(run) == 1) & F.lit(header_chars <= budget)).drop("_fits")


def payload(budgeted: DataFrame, budget: int, header: str = "", rendered: str = "rendered", order: str = "final_rank", marker: str = "TRUNCATED\n") -> DataFrame:
    """(query_id, included, omitted, payload): what is delivered, with the marker where items were left out and it
    still fits."""
    own = budgeted.groupBy("query_id").agg(
        F.count_if("included").alias("included"),
        F.count_if(~F.col("included")).alias("omitted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("included"), F.struct(F.col(order).alias("o"), F.col(rendered).alias("t"))))), lambda x: x["t"]), "").alias("_body"),
    )
    text = F.concat(F.lit(header), F.col("_body"))
    full = F.when((F.col("omitted") > 0) & (F.char_length(text) + len(marker) <= budget), F.concat(text, F.lit(marker))).otherwise(text)
    return own.select("query_id", "included", "omitted", F.when(F.lit(len(header) <= budget), full).otherwise(F.lit("")).alias("payload"))


def explanation(weights: Weights) -> Column:
    """What made a score, as JSON; numbers as their shortest decimal text, so that they come back exactly."""
    dec = lambda c: c.cast("double").cast("string")
    w = F.struct(*[F.lit(float(getattr(weights, t))).cast("string").alias(t) for t in TERMS])
    return F.to_json(F.struct(*[dec(F.col(t)).alias(t) for t in TERMS], dec(F.col("score")).alias("score"), w.alias("weights")))


def recompute(explained: DataFrame, col: str = "components") -> DataFrame:
    """The explained rows with stored (the score they say), recomputed (from terms and weights) and exact."""
    ddl = "struct<" + ",".join(f"{t}:string" for t in (*TERMS, "score")) + ",weights:struct<" + ",".join(f"{t}:string" for t in TERMS) + ">>"
    parsed = explained.withColumn("_c", F.from_json(col, ddl))
    num = lambda t: F.col(f"_c.{t}").cast("double") * F.col(f"_c.weights.{t}").cast("double")
    total = num("r")
    for t in TERMS[1:]:
        total = total + num(t)
    return parsed.withColumn("stored", F.col("_c.score").cast("double")).withColumn("recomputed", total).withColumn("exact", F.col("stored") == F.col("recomputed")).drop("_c")


def why_ranked(explained: DataFrame, col: str = "components") -> DataFrame:
    """One row a term: value, weight and product, with the keys of the explained row."""
    ddl = "struct<" + ",".join(f"{t}:string" for t in (*TERMS, "score")) + ",weights:struct<" + ",".join(f"{t}:string" for t in TERMS) + ">>"
    keys = [c for c in explained.columns if c != col]
    parsed = explained.withColumn("_c", F.from_json(col, ddl))
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_c.{t}").cast("double").alias("value"), F.col(f"_c.weights.{t}").cast("double").alias("weight")) for t in TERMS])
    return parsed.select(*keys, F.explode(rows).alias("_t")).select(*keys, "_t.term", "_t.value", "_t.weight", (F.col("_t.value") * F.col("_t.weight")).alias("product"))
