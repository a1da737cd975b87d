"""Salience: demand, references and signals of a message, and its novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions.values import age_hours, clamp, decay, saturate, utc_day
from recall_engine.params import PARAMS, Params


def demand_posterior(fetches: Column, impressions: Column, p: Params = PARAMS) -> Column:
    """(fetches + 1) / (impressions + 5), with a floor while few have seen it."""
    raw = (fetches + 1) / (impressions + 5)
    return clamp(F.when((impressions < p.new_impressions) & (raw < p.demand_floor), F.lit(p.demand_floor)).otherwise(raw))


def novelty(impressions: Column, p: Params = PARAMS) -> Column:
    return decay(impressions.cast("double"), p.half_novelty)


def demand(impressions: DataFrame, fetches: DataFrame) -> DataFrame:
    """(message_id, impressions, fetches): how often shown, and in how many distinct tasks fetched; where a fetch has no
    task its principal counts, and where it has neither, the fetch itself."""
    seen = impressions.groupBy("message_id").agg(F.count(F.lit(1)).alias("impressions"))
    cluster = F.coalesce(F.expr("nullif(task_id, '')"), F.expr("nullif(principal, '')"), F.col("interaction_id").cast("string"))
    got = fetches.groupBy("message_id").agg(F.count_distinct(cluster).alias("fetches"))
    both = seen.join(got, "message_id", "full_outer")
    return both.select("message_id", F.coalesce("impressions", F.lit(0)).alias("impressions"), F.coalesce("fetches", F.lit(0)).alias("fetches"))


def effective_signals(signals: DataFrame, now: Column, p: Params = PARAMS) -> DataFrame:
    """(message_id, weight): repeated signals of one principal, message and kind count once, the youngest; weight times
    trust times decay; scaled down where a principal's day is over the cap; summed, whatever the kind."""
    age = age_hours(F.col("created_at"), now)
    newest = Window.partitionBy("principal", "message_id", "kind").orderBy("_age", F.desc("weight"))
    once = signals.withColumn("_age", age).withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1")
    weight = F.when(F.col("weight") <= 0, 1).otherwise(F.least(F.col("weight"), F.lit(p.most_weight)))
    trust = F.lit(p.trust_other)
    for who, much in p.trust.items():
        trust = F.when(F.col("principal").cast("string") == who, F.lit(much)).otherwise(trust)
    valued = once.select("principal", "message_id", utc_day(F.col("created_at")).alias("_day"), (weight * trust * decay(F.col("_age"), p.half_signal_age)).alias("_w"))
    total = F.sum("_w").over(Window.partitionBy("principal", "_day"))
    scaled = valued.withColumn("_total", total).withColumn("_w", F.when(F.col("_total") > p.day_cap, F.col("_w") * p.day_cap / F.col("_total")).otherwise(F.col("_w")))
    return scaled.groupBy("message_id").agg(F.sum("_w").alias("weight"))


def signal_sums(signals: DataFrame) -> DataFrame:
    """(message_id, weight): plain sums, 1 where a signal has no weight."""
    return signals.groupBy("message_id").agg(F.sum(F.coalesce("weight", F.lit(1))).cast("long").alias("weight"))


def reference_in_degree(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """(message_id, refs): replies to a message, and messages that attach again what it attached first."""
    replies = messages.filter(F.col("reply_to").isNotNull()).groupBy(F.col("reply_to").alias("message_id")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("object_hash").orderBy("created_at", "message_id")
    placed = attachments.join(messages.select("message_id", "created_at"), "message_id").select("object_hash", "message_id", F.first("message_id").over(first).alias("_first"))
    onward = placed.filter(F.col("message_id") != F.col("_first")).groupBy(F.col("_first").alias("message_id")).agg(F.count(F.lit(1)).alias("n"))
    return replies.unionByName(onward).groupBy("message_id").agg(F.sum("n").cast("long").alias("refs"))


def salience(demands: DataFrame, refs: DataFrame, signals: DataFrame, p: Params = PARAMS) -> DataFrame:
    """(message_id, salience, novelty) of every message with any demand, reference or signal. What has none is not here,
    and counts as zero for both where it is ranked."""
    every = demands.join(refs, "message_id", "full_outer").join(signals, "message_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    a, b, c = p.salience
    value = a * demand_posterior(zero("fetches"), zero("impressions"), p) + b * saturate(zero("refs"), p.half_reference) + c * saturate(F.coalesce("weight", F.lit(0.0)), p.half_signal)
    return every.select("message_id", clamp(value).alias("salience"), novelty(zero("impressions"), p).alias("novelty"))
