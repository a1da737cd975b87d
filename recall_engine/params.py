"""All constants of the engine, in one place. Times are hours unless a name says otherwise.

The numbers are fixed values of the definition: weights, half-lives, caps, limits and thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    """Weights of the ranking terms: relevance, salience, freshness, priority, intent, novelty."""

    r: float = 0.0
    s: float = 0.0
    f: float = 0.0
    p: float = 0.0
    i: float = 0.0
    n: float = 0.0


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6
    rrf_k: int = 60
    candidates: int = 100
    default_k: int = 10
    half_search: float = 90 * 24.0
    half_digest: float = 72.0
    half_priority: float = 60.0
    search_p0: Weights = Weights(r=0.90, f=0.07, p=0.03)
    digest_p0: Weights = Weights(r=0.60, f=0.30, p=0.10)
    search_p2: Weights = Weights(r=0.75, s=0.08, f=0.04, i=0.10, n=0.03)
    digest_p2: Weights = Weights(r=0.45, s=0.15, f=0.20, i=0.15, n=0.05)
    intent_pin: float = 1.0
    intent_confirm: float = 0.6
    exploration: float = 0.10
    new_impressions: int = 5
    demand_floor: float = 0.2
    half_reference: float = 3.0
    half_signal: float = 5.0
    half_novelty: float = 8.0
    salience: tuple[float, float, float] = (0.5, 0.3, 0.2)
    trust: dict = field(default_factory=lambda: {"operator": 1.0})
    trust_other: float = 0.3
    half_signal_age: float = 30 * 24.0
    most_weight: int = 3
    day_cap: float = 5.0
    snippet: int = 200
    ttl_ephemeral: float = 7 * 24.0
    park_grace: float = 24.0
    latency_gate_micros: int = 200_000
    latency_least: int = 20
    outcomes_least: int = 30
    success_at_5_pct: int = 70
    workaround_pct: int = 25
    margin: float = 0.15
    history: int = 1000
    late_accept_s: int = 300
    late_offer_s: int = 60
    holdout_every: int = 4
    split_share: int = 19660
    map_top: int = 20
    index_buckets: int = 64
    body_limit: int = 1 << 20
    canonical_limit: int = 1 << 20
    backlog_steps: tuple[int, ...] = (200, 1000, 5000, 20000)
    free_steps: tuple[int, ...] = (2 << 30, 512 << 20, 64 << 20)


PARAMS = Params()
