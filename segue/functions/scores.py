"""Scores of pairs and of requests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Weights of the seven factors (they sum to 1.05, as stated), and of harmony and energy when these are off.
WEIGHTS = {"embedding": 0.25, "semantic": 0.20, "vibe": 0.15, "bpm": 0.15, "harmonic": 0.15, "energy": 0.10, "freshness": 0.05}
WEIGHT_OFF = 0.05


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 if a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector at length 1; one without length stays. Its length is bound to a name, else it would be worked out for each element."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))), F.lit(0))


def bpm_factor(a: Column, b: Column, tolerance: float = 8.0) -> Column:
    """1 if a tempo is unknown or 0, else falling to 0 at the tolerance."""
    unknown = a.isNull() | b.isNull() | (a == 0) | (b == 0)
    return F.when(unknown, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / tolerance))


def energy_flow(candidate: Column, context: Column, direction: Column) -> Column:
    """How an energy step (rounded to 6 places) suits a direction; unknown energies count as .5, a null direction as ``maintain``."""
    d = F.round(F.coalesce(candidate, F.lit(0.5)) - F.coalesce(context, F.lit(0.5)), 6)
    way = F.coalesce(direction, F.lit("maintain"))
    return (
        F.when(way.isin("build", "build_energy"), F.when(d.between(0.1, 0.3), 1.0).when(d > 0, 0.7).otherwise(0.2))
        .when(way == "breakdown", F.when(d.between(-0.4, -0.1), 1.0).when(d < 0, 0.7).otherwise(0.2))
        .when(way == "maintain", F.when(F.abs(d) <= 0.15, 1.0).otherwise(F.greatest(F.lit(0.1), 1 - 2 * F.abs(d))))
        .when(way == "bridge", F.when(F.abs(d) <= 0.2, 0.8).otherwise(0.5))
        .otherwise(0.5)
    )


def bpm_compat(bpm: Column, low: Column, high: Column, context: Column) -> Column:
    """1 inside the range and falling over 10 beats outside; without a range, falling over 20 beats from the context; .5 if nothing is known."""
    gap = F.greatest(low - bpm, bpm - high, F.lit(0.0))
    return (
        F.when(bpm.isNull(), 0.5)
        .when(low.isNotNull() & high.isNotNull(), F.greatest(F.lit(0.0), 1 - gap / 10))
        .when(context.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(bpm - context) / 20))
        .otherwise(0.5)
    )


def overlap(a: Column, b: Column) -> Column:
    """Share of ``b`` that ``a`` has; .5 if ``b`` is empty or null, 0 if only ``a`` is null."""
    return F.when(b.isNull() | (F.size(b) == 0), 0.5).otherwise(F.coalesce(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(b)), F.lit(0.0)))


def semantic_score(tags: Column, vibe: Column, energy: Column, want_tags: Column, want_vibe: Column, low: Column, high: Column) -> Column:
    """.4 of tag coverage, .3 of vibe coverage and .3 of energy nearness (energies from 0 to 1), 1 at most."""

    def covered(have: Column, want: Column) -> Column:
        return F.when(F.coalesce(F.size(want), F.lit(0)) > 0, F.coalesce(F.size(F.array_intersect(have, want)) / F.size(want), F.lit(0.0))).otherwise(0.0)

    near = F.coalesce(F.greatest(F.lit(0.0), 1 - 2 * F.abs(energy - (low + high) / 2)), F.lit(0.0))
    return F.least(F.lit(1.0), 0.4 * covered(tags, want_tags) + 0.3 * covered(vibe, want_vibe) + 0.3 * near)


def freshness(last_play: Column, as_of: Column) -> Column:
    """1 if never played, else the hours since, of 24."""
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_play.cast("timestamp"))) / 3_600_000_000
    return F.when(last_play.isNull(), 1.0).otherwise(F.least(F.lit(1.0), hours / 24))


def feature_nearness(energy: Column, want_energy: Column, bpm: Column, want_bpm: Column) -> Column:
    """.5 and up to .5 each for near energy and near tempo, 1 at most, three places."""
    e = F.coalesce(F.greatest(F.lit(0.0), 0.5 - F.abs(energy - want_energy)), F.lit(0.0))
    b = F.coalesce(F.greatest(F.lit(0.0), 0.5 - F.abs(bpm - want_bpm) / 30), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), 0.5 + e + b), 3)


def tempo_bin(bpm: Column) -> Column:
    return F.when(bpm < 110, "slow").when(bpm < 125, "medium").when(bpm < 140, "fast").when(bpm >= 140, "very fast")


def mix_bin(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").when(score.isNotNull(), "poor")


def match_bin(sim: Column) -> Column:
    return F.when(sim >= 0.80, "strong").when(sim >= 0.65, "good").when(sim >= 0.50, "fair").when(sim.isNotNull(), "weak")


def bar_bin(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "middle").when(score.isNotNull(), "low")
