"""Health of a store: verdicts of gates, doctor checks, the status of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.functions.values import overdue
from recall_engine.operators import rollups
from recall_engine.operators.events import walk
from recall_engine.operators.order import element_at
from recall_engine.params import PARAMS, Params


def percentile_by_offset(samples: DataFrame, value: str, percent: int, by: list[str]) -> DataFrame:
    """(by, n, picked): the element at n * percent / 100 of the sorted values, without interpolation.

    Equal values are counted before the shuffle, and the distinct ones are placed by ranges, so no task holds a group.
    """
    at = F.expr(f"least(total * {percent} div 100, total - 1)")
    return element_at(samples, value, at, by).select(*by, F.col("total").cast("long").alias("n"), F.col(value).alias("picked"))


def gate_counters(interactions: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row: found, not_found, workaround, budgeted, violations, samples, p95_micros."""
    counts = interactions.agg(
        F.count_if(F.col("outcome") == "found").alias("found"),
        F.count_if(F.col("outcome") == "not_found").alias("not_found"),
        F.count_if(F.col("outcome") == "workaround").alias("workaround"),
        F.count_if(F.col("budget") > 0).alias("budgeted"),
        F.count_if((F.col("budget") > 0) & (F.col("payload_chars") > F.col("budget"))).alias("violations"),
    )
    p95 = percentile_by_offset(latencies.withColumn("_one", F.lit(1)), "micros", 95, ["_one"]).select(F.col("n").alias("samples"), F.col("picked").alias("p95_micros"))
    empty = counts.sparkSession.range(1).select(F.lit(1).alias("_k"))
    return counts.crossJoin(empty.join(p95, F.lit(True), "left").select(F.coalesce("samples", F.lit(0)).alias("samples"), "p95_micros"))


def gate_verdicts(counters: DataFrame, success: DataFrame, p: Params = PARAMS) -> DataFrame:
    """(gate, verdict, measured): PASS, FAIL or INCONCLUSIVE where samples are too few. success: outcomes, at_5."""
    both = counters.crossJoin(success)
    total = F.col("found") + F.col("not_found") + F.col("workaround")
    pct = lambda n: F.when(total > 0, F.floor(n * 100 / total)).otherwise(F.lit(0))
    few = total < p.outcomes_least
    verdict = lambda bad, unsure: F.when(unsure, "INCONCLUSIVE").when(bad, "FAIL").otherwise("PASS")
    row = lambda name, v, m: F.struct(F.lit(name).alias("gate"), v.alias("verdict"), m.cast("long").alias("measured"))
    rows = F.array(
        row("budget compliance", F.when(F.col("violations") > 0, "FAIL").otherwise("PASS"), F.col("violations")),
        row("visible within the limit", verdict(F.col("p95_micros") >= p.latency_gate_micros, F.col("samples") < p.latency_least), F.coalesce("p95_micros", F.lit(0))),
        row("success at 5", verdict(pct(F.col("at_5")) < p.success_at_5_pct, few), pct(F.col("at_5"))),
        row("workarounds", verdict(pct(F.col("workaround")) > p.workaround_pct, few), pct(F.col("workaround"))),
    )
    return both.select(F.explode(rows).alias("_r")).select("_r.*")


def doctor(events: DataFrame, tables: dict[str, DataFrame], objects: DataFrame, now: Column, p: Params = PARAMS, deep: bool = False) -> DataFrame:
    """(severity, check, detail): gaps, forks, drift, parks past their grace, attached objects that aren't held. deep also computes
    every event's id anew and follows the chain by names, and hashes the objects held, if they come with their data."""
    origin = ["device_id", "generation"]
    say = lambda df, severity, name, text: df.select(F.lit(severity).alias("severity"), F.lit(name).alias("check"), text.alias("detail"))
    at = F.concat_ws("/", "device_id", F.col("generation").cast("string"))
    gaps = say(rollups.chain_gaps(events, origin, "sequence"), "problem", "gap", F.concat_ws(" ", at, F.col("last"), F.col("next")))
    forks = say(rollups.forks(events, [*origin, "sequence"], F.col("event_id")), "problem", "fork", F.concat_ws(" ", at, F.col("sequence")))
    heads = events.groupBy(*origin).agg(F.max("sequence").alias("head"))
    behind = say(rollups.drift(tables["checkpoint"], heads, origin), "problem", "drift", F.concat_ws(" ", at, F.col("behind")))
    stamps = tables["parked_events"].join(events.select("event_id", "wall_time"), "event_id").dropDuplicates(["event_id"])
    late = overdue(F.col("wall_time"), now, p.park_grace)
    parks = stamps.select(F.when(late | ~F.col("retryable"), "problem").otherwise("info").alias("severity"), F.lit("parked").alias("check"), F.col("event_id").alias("detail"))
    lost = say(rollups.missing_objects(tables["attachments"], objects), "info", "missing object", F.col("object_hash"))
    out = gaps.unionByName(forks).unionByName(behind).unionByName(parks).unionByName(lost)
    if deep:
        broken = walk(events).filter("defect <> 'gap'")
        out = out.unionByName(say(broken, "problem", "chain", F.concat_ws(" ", at, F.col("sequence"), "defect")))
        if "data" in objects.columns:
            spoilt = objects.filter(~F.col("object_hash").eqNullSafe(F.sha2("data", 256)))
            out = out.unionByName(say(spoilt, "problem", "object", F.col("object_hash")))
    return out


def fetch_states(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects with ok: the bytes hash to the name they are stored under."""
    return wanted.join(objects, "object_hash").withColumn("ok", F.sha2("data", 256) == F.col("object_hash"))
