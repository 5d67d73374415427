"""Numeric and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def relevance(a: Column, b: Column) -> Column:
    return F.greatest(cosine(a, b), F.lit(0.0))


def finite_vector(a: Column, size: int | None = None) -> Column:
    """Whether all components are finite numbers and their number is as asked."""
    ok = F.coalesce(F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return ok & (F.size(a) == size) if size else ok


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def adaptive_ratio(tokens: Column) -> Column:
    """Share of nodes to keep by the size of a text."""
    return F.when(tokens < 8_000, 0.8).when(tokens < 32_000, 0.5).when(tokens < 100_000, 0.2).otherwise(0.1)


def decay_score(importance: Column, age_seconds: Column, accesses: Column, half_life: float) -> Column:
    """Importance halved every half life, plus up to 0.2 for use."""
    bonus = F.least(F.lit(0.2), F.log1p(accesses.cast("double")) * 0.05)
    return clamp(importance * F.pow(F.lit(0.5), age_seconds / half_life) + bonus)


def section_ratio(rel: Column, total: Column, base: Column, n: Column) -> Column:
    """A section's keep ratio: its share of relevance of the whole budget, within 0.05 and 1."""
    share = F.when(total > 0, rel / total * base * n).otherwise(base)
    return clamp(share, 0.05, 1.0)


def budget_status(used: Column, limit: Column) -> Column:
    share = F.when(limit > 0, used / limit * 100).otherwise(100.0)
    return F.when(share >= 75, "critical").when(share >= 60, "urgent").when(share >= 40, "warning").otherwise("ok")


def alert_level(share: Column) -> Column:
    return F.when(share >= 0.9, "critical").when(share >= 0.75, "warning").when(share >= 0.5, "notice").otherwise("none")


def urgency(score: Column) -> Column:
    return F.when(score >= 0.6, "critical").when(score >= 0.4, "high").when(score >= 0.25, "medium").otherwise("low")


def cost(tokens: Column, dollars_per_million: Column) -> Column:
    return F.round(tokens * dollars_per_million / 1_000_000, 6)


def savings_percent(original: Column, kept: Column) -> Column:
    return F.when(original > 0, (original - kept) / original * 100).otherwise(0.0)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


#: Five rate levels.
RATE_LEVELS = (0.10, 0.15, 0.20, 0.25, 0.30)


def rate_level(complexity: Column, availability: Column, priority: Column) -> Column:
    """The level nearest to the mean of three shares; halves go to the even level."""
    at = F.bround(clamp((complexity + availability + priority) / 3) * (len(RATE_LEVELS) - 1), 0).cast("int")
    return F.get(F.array(*[F.lit(x) for x in RATE_LEVELS]), at)


def nth_percentile(values: Column, q: float) -> Column:
    """The element at int(n * q) of the sorted values, not an interpolation."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.least(F.floor(F.size(values) * F.lit(q)).cast("int"), F.size(values) - 1))
