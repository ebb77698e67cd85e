"""Score parts and score models as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from outings.functions.rules import matching_tags


def round1(x: Column) -> Column:
    """One decimal, halves rounded up (also below zero)."""
    return F.floor(x * 10.0 + 0.5) / 10.0


def vibe_match(value: Column, preference: Column) -> Column:
    return 1.0 - F.abs(F.coalesce(value, F.lit(0.5)) - preference)


def tag_share(requested: Column, tags: Column) -> Column:
    """Share of the requested tags that are present; 0 when either side has none."""
    n = F.size(requested)
    hits = F.size(matching_tags(requested, tags))
    share = hits.cast("double") / F.nullif(n, F.lit(0))
    return F.coalesce(F.when(n > 0, share), F.lit(0.0))


def tag_score(requested: Column, tags: Column, weight: float = 30.0) -> Column:
    return tag_share(requested, tags) * weight


def time_bonus(best_times: Column, time_of_day: Column, weight: float = 20.0) -> Column:
    hit = F.coalesce(F.array_contains(best_times, time_of_day), F.lit(False))
    return F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))


def needed_minutes(walk: Column) -> Column:
    """Minutes for both ways and a stay; NULL without a walk (0 counts as none)."""
    return F.when(walk > 0, walk * 2 + 30)


def availability_bonus(walk: Column, available: Column, weight: float = 10.0) -> Column:
    """Comfortable fit: up to ``weight`` when at most 80% of the time is needed."""
    ratio = needed_minutes(walk).cast("double") / available
    return F.when(ratio <= 0.8, (1.0 - ratio) * float(weight)).otherwise(F.lit(0.0))


def low_energy_penalty(wanted: Column, low_energy: Column, weight: float = 15.0) -> Column:
    off = wanted & ~F.coalesce(low_energy, F.lit(False))
    return F.when(off, F.lit(-float(weight))).otherwise(F.lit(0.0))


def jitter(request_hash: Column, item_hash: Column, weight: float) -> Column:
    """Repeatable variety term in [0, weight) for one request and one candidate."""
    return F.pmod(request_hash.bitwiseXOR(item_hash), F.lit(10000)) / 10000.0 * float(weight)


@dataclass(frozen=True)
class Weights:
    """Points per part of a score; a part with weight 0 is left out."""

    quiet: float = 0.0
    active: float = 0.0
    inside: float = 0.0
    tags: float = 0.0
    semantic: float = 0.0
    time: float = 20.0
    fit: float = 0.0
    low_energy: float = 0.0
    spare: float = 0.0
    jitter: float = 0.0
    seed: int = 0


# Points of the score models. Jitter was 5, 10 and 10 points in
# the live service and is off unless asked for.
HYBRID = Weights(quiet=20.0, active=20.0, tags=30.0, semantic=30.0, fit=10.0)
VIBE = Weights(quiet=30.0, inside=30.0, fit=10.0, low_energy=15.0)
LOCAL = Weights(quiet=30.0, inside=30.0, low_energy=15.0, spare=0.1)
# Half of the 60 vibe points, 0.3 of the 30 semantic points, a tenth of the time bonus.
BLEND = Weights(quiet=15.0, inside=15.0, semantic=9.0, time=2.0)
