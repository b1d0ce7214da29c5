"""Recommendation and how neighbours differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.functions import scores
from segue.functions.keys import harmonic


def with_total(df: DataFrame, weights: dict[str, float] = scores.WEIGHTS) -> DataFrame:
    """``total``: the factor columns by their weights, which are not rescaled."""
    return df.withColumn("total", F.round(reduce(Column.__add__, (F.col(c) * w for c, w in weights.items())), 9))


def recommend(candidates: DataFrame, use_harmony: bool = True, use_energy: bool = True, n: int = 20) -> DataFrame:
    """The seven factors of each ``seed``'s candidates and the ``n`` best.

    Columns with ``_a`` belong to the seed and with ``_b`` to the candidate: ``bpm, key, energy, tags, vibe``; ``sim`` is their
    cosine, ``last_play`` and ``as_of`` give freshness, ``direction`` the energy step. Energies are from 1 to 10.
    """
    f = candidates.select(
        "*",
        F.col("sim").alias("embedding"),
        scores.overlap(F.col("tags_b"), F.col("tags_a")).alias("semantic"),
        scores.overlap(F.col("vibe_b"), F.col("vibe_a")).alias("vibe"),
        scores.bpm_compat(F.col("bpm_b"), F.lit(None), F.lit(None), F.col("bpm_a")).alias("bpm"),
        harmonic(F.col("key_a"), F.col("key_b")).alias("harmonic"),
        scores.energy_flow(F.col("energy_b") / 10, F.col("energy_a") / 10, F.col("direction")).alias("energy"),
        scores.freshness(F.col("last_play"), F.col("as_of")).alias("freshness"),
    )
    weights = scores.WEIGHTS | {k: scores.WEIGHT_OFF for k, on in (("harmonic", use_harmony), ("energy", use_energy)) if not on}
    ranked = with_total(f, weights).withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("total"), "neighbour")))
    return ranked.where(F.col("rank") <= n).select("seed", "neighbour", *scores.WEIGHTS, "total", "rank")


def diversify(df: DataFrame, weight: float = 0.2) -> DataFrame:
    """Each further track of an artist in a list loses a share of its total; tracks without an artist are alone."""
    who = F.coalesce("artist", F.concat(F.lit("track "), F.col("neighbour").cast("string")))
    place = F.row_number().over(Window.partitionBy("seed", who).orderBy(F.desc("total"), "neighbour"))
    return df.withColumn("place", place).withColumn("diverse", F.round(F.col("total") * F.pow(F.lit(1 - weight), F.col("place") - 1), 9))


def reasons(df: DataFrame, least: float = 0.8) -> DataFrame:
    """``reasons``: the factors of ``least`` or more, by weighted score."""
    said = [F.when(F.col(c) >= least, F.struct(F.round(-F.col(c) * w, 6).alias("s"), F.lit(c).alias("c"))) for c, w in scores.WEIGHTS.items()]
    kept = F.array_sort(F.filter(F.array(*said), lambda x: x.isNotNull()))
    return df.withColumn("reasons", F.array_join(F.transform(kept, lambda x: x["c"]), ", "))


def latest_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def describe_direction(pairs: DataFrame) -> DataFrame:
    """``clue``: what changes from a seed to its neighbour; a ``more`` clue first, else any, else ``similar vibe``."""
    de, db = F.round((F.col("energy_b") - F.col("energy_a")) / 10, 6), F.round(F.col("bpm_b") - F.col("bpm_a"), 6)
    new = lambda a, b, said: F.when(F.size(F.array_except(b, a)) > 0, F.concat(F.lit(said), F.element_at(F.array_sort(F.array_except(b, a)), 1)))
    clue = F.coalesce(
        F.when(de > 0.15, "more energy"), F.when(F.coalesce(de >= -0.15, F.lit(True)) & (db > 5), "more tempo"), F.when(de < -0.15, "less energy"), F.when(db < -5, "slower"),
        new(F.col("tags_a"), F.col("tags_b"), "adds "), new(F.col("vibe_a"), F.col("vibe_b"), "turns "), F.lit("similar vibe"),
    )
    return pairs.withColumn("clue", clue)


def last_plays(crates: DataFrame, at: DataFrame) -> DataFrame:
    """``trackid, last_play``: the latest time of a session that holds a track; ``at`` is ``session_id, ts``."""
    return crates.join(at, "session_id").groupBy("trackid").agg(F.max("ts").alias("last_play"))
