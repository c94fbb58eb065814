"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratamem.functions import fixed as V


def age_days(created: Column, now: Column) -> Column:
    """Whole periods of 24 hours, 0 at least; null for an unknown time."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    return F.when(micros < 0, F.lit(0)).otherwise(F.floor(micros / 86_400_000_000))


def recency(created: Column, now: Column, kind: Column, half_life: float = V.HALF_LIFE_DAYS) -> Column:
    """Exponential decay by age; unknown times are in the middle, persistent types have a floor."""
    decay = F.coalesce(F.exp(-V.DECAY * age_days(created, now) / half_life), F.lit(V.RECENCY_UNKNOWN))
    return F.when(kind.isin(*V.PERSISTENT_TYPES), F.greatest(decay, F.lit(V.RECENCY_FLOOR))).otherwise(decay)


def type_boost(kind: Column) -> Column:
    """The base importance of a memory type."""
    pairs = [F.lit(x) for kv in V.TYPE_BOOST.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(V.DEFAULT_BOOST))


def composite(similarity: Column, fresh: Column, importance: Column, access_count: Column, kind: Column) -> Column:
    """Weighted similarity, recency and importance, raised by access, to the power 1.5."""
    sum_ = V.W_SIMILARITY * similarity + V.W_RECENCY * fresh + V.W_IMPORTANCE * importance * type_boost(kind)
    lifted = sum_ * F.least(1 + 0.05 * access_count, F.lit(1.5))
    return F.pow(F.greatest(lifted, F.lit(0.0)), F.lit(1.5))


def boosted(score: Column, truth: Column, in_degree: Column) -> Column:
    """A fused score raised by a written truth, then by backlinks; the order matters."""
    full = F.length(F.regexp_replace(F.coalesce(truth, F.lit("")), r"^\s+|\s+$", "")) >= V.TRUTH_CHARS
    lifted = F.when(full, score * V.TRUTH_FACTOR).otherwise(score)
    return F.when(in_degree > 0, lifted + V.BACKLINK_WEIGHT * F.log1p(in_degree)).otherwise(lifted)
