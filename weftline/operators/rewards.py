"""Component scores of a compression, their weights over training phases, and the weakest one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights of the components in each phase of training.
PHASES = [
    {"schema": 0.40, "semantic": 0.20, "fidelity": 0.15, "composition": 0.15, "memory": 0.10},
    {"schema": 0.25, "semantic": 0.30, "fidelity": 0.20, "composition": 0.15, "memory": 0.10},
    {"schema": 0.15, "semantic": 0.35, "fidelity": 0.20, "composition": 0.15, "memory": 0.15},
    {"schema": 0.10, "semantic": 0.30, "fidelity": 0.25, "composition": 0.15, "memory": 0.20},
]
COMPONENTS = list(PHASES[0])


def _flag(value: Column, otherwise: float = 0.0) -> Column:
    return F.when(value, 1.0).otherwise(otherwise)


def schema_score(input_valid: Column, output_valid: Column) -> Column:
    return (_flag(input_valid) + _flag(output_valid)) / 2


def semantic_score(ssim: Column, embedding: Column, structure: Column, keywords: Column) -> Column:
    return ssim * 0.35 + embedding * 0.30 + structure * 0.20 + keywords * 0.15


def ratio_score(achieved: Column, target: Column) -> Column:
    return F.when(target == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(achieved - target) / target))


def fidelity_score(achieved: Column, target: Column, within_budget: Column) -> Column:
    return (ratio_score(achieved, target) + _flag(within_budget, 0.5)) / 2


def composition_score(nodes: Column, edges: Column, ids: Column, connected: Column, orphans: Column) -> Column:
    """Mean of five parts; an unconnected graph gets half, each orphan costs a tenth."""
    return (_flag(nodes) + _flag(edges) + _flag(ids) + _flag(connected, 0.5) + F.greatest(F.lit(0.0), 1 - orphans * 0.1)) / 5


def memory_score(growth: Column, eviction: Column, peak: Column, budget: Column) -> Column:
    """Growth of half the context or more scores nothing, as does use of the whole budget; four fifths of it cost nothing."""
    grown = F.greatest(F.lit(0.0), 1 - growth * 2)
    used = F.when(budget == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), peak / budget - 0.8) * 5))
    return grown * 0.4 + eviction * 0.3 + used * 0.3


def phase_reward(scores: dict[str, Column], phase: Column) -> Column:
    """The weighted sum of component scores under the weights of a phase; later phases than the last count as it."""
    at = F.least(phase, F.lit(len(PHASES) - 1))
    weights = {c: F.get(F.array(*[F.lit(p[c]) for p in PHASES]), at) for c in COMPONENTS}
    return sum((scores[c] * weights[c] for c in COMPONENTS[1:]), scores[COMPONENTS[0]] * weights[COMPONENTS[0]])


def weakest(scores: dict[str, Column]) -> Column:
    """(score, name) of the lowest component, the first of equals."""
    return F.array_min(F.array(*[F.struct(s.alias("score"), F.lit(k).alias("rank"), F.lit(c).alias("name")) for k, (c, s) in enumerate(scores.items())]))


def passes(reward: Column, least: float = 0.7) -> Column:
    return reward >= least
