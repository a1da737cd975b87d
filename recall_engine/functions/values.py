"""Scalar functions over numbers, times, hashes, JSON and policies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recall_engine.params import PARAMS, Params


def age_hours(at: Column, now: Column) -> Column:
    """Hours since, not below zero."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(3.6e9))


def decay(hours: Column, half: float) -> Column:
    return F.pow(F.lit(2.0), -hours / F.lit(half))


def saturate(x: Column, half: float) -> Column:
    """1 - 2^(-x / half), zero for nothing."""
    return F.lit(1.0) - F.pow(F.lit(2.0), -F.greatest(x.cast("double"), F.lit(0.0)) / F.lit(half))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def utc_day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def overdue(stamp: Column, now: Column, hours: float = PARAMS.park_grace) -> Column:
    """True for stamps older than the grace, and for those that can't be read."""
    at = F.try_to_timestamp(stamp)
    return at.isNull() | (age_hours(at, now) > hours)


def ttl_hours(spec: Column) -> Column:
    """Hours of 7d, 36h, 90m or 30s; null for anything else."""
    n = F.regexp_extract(spec, r"\A(\d+(?:\.\d+)?)([dhms])\z", 1)
    unit = F.regexp_extract(spec, r"\A(\d+(?:\.\d+)?)([dhms])\z", 2)
    hours = F.when(unit == "d", 24.0).when(unit == "h", 1.0).when(unit == "m", 1 / 60).when(unit == "s", 1 / 3600)
    return F.when(n != "", n.cast("double")) * hours


def in_holdout(salt: Column, key: Column, share: int = PARAMS.split_share) -> Column:
    """True for about share / 65536 of all keys, by the first two bytes of a hash."""
    return F.conv(F.left(F.sha2(F.concat(salt, key), 256), F.lit(4)), 16, 10).cast("int") < share


def degradation(backlog: Column, free_bytes: Column, p: Params = PARAMS) -> Column:
    """0 to 7: levels 1 to 4 by what still waits for enrichment, 5 to 7 by how little disk is free; the higher one counts."""
    waiting = sum((F.when(backlog >= s, 1).otherwise(0) for s in p.backlog_steps), F.lit(0))
    least, middle, most = sorted(p.free_steps)
    disk = F.when(free_bytes < least, 7).when(free_bytes < middle, 6).when(free_bytes < most, 5).otherwise(0)
    return F.greatest(waiting, disk)


def effective_class(declared: Column, body_len: Column, admitted: Column, override: Column, p: Params = PARAMS) -> Column:
    """The text class that a body gets: too large ones, canonical ones over their limit and those that the day's quota
    doesn't admit become ephemeral, unless an operator overrides it."""
    small = F.when(body_len > p.body_limit, False).when((declared == "canonical") & ((body_len > p.canonical_limit) | ~admitted), False).otherwise(True)
    return F.when(override | (declared == "ephemeral") | small, declared).otherwise("ephemeral")


def valid_view(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[a-z0-9][a-z0-9_-]{0,63}\z"), F.lit(False))


def valid_hash(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def valid_address(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9.\-]+:\d{1,5}\z"), F.lit(False))


def freshness(at: Column, now: Column, half: float) -> Column:
    return decay(age_hours(at, now), half)


def effective_priority(priority: Column, at: Column, now: Column, suspended: Column, p: Params = PARAMS) -> Column:
    """A third of the priority, halved as time goes by unless the decay is suspended."""
    base = priority.cast("double") / F.lit(3.0)
    return F.when(suspended, base).otherwise(base * decay(age_hours(at, now), p.half_priority))
