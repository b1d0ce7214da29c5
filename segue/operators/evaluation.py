"""Quality measures of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from segue.functions.keys import harmonic


def _tagged(recs: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("trackid").alias("seed"), F.col("semantic_tags").alias("tags_a"))
    b = labels.select(F.col("trackid").alias("neighbour"), F.col("semantic_tags").alias("tags_b"))
    return recs.join(a, "seed").join(b, "neighbour", "left").where(F.size("tags_a") > 0)


def precision_at_k(recs: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Share of the first ``k`` that have a tag of the seed, per seed with tags."""
    hit = F.coalesce(F.arrays_overlap("tags_a", "tags_b"), F.lit(False))
    return _tagged(recs.where(F.col("rank") <= k), labels).groupBy("seed").agg(F.round(F.avg(hit.cast("double")), 6).alias("precision"))


def tag_coherence(recs: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean Jaccard likeness of the seed's and the recommended tags."""
    none = F.array().cast("array<string>")
    b = F.coalesce("tags_b", none)
    return _tagged(recs, labels).groupBy("seed").agg(F.round(F.avg(F.size(F.array_intersect("tags_a", b)) / F.size(F.array_union("tags_a", b))), 6).alias("coherence"))


def _met(recs: DataFrame, tracks: DataFrame) -> DataFrame:
    a = tracks.select(F.col("trackid").alias("seed"), F.col("bpm").alias("bpm_a"), F.col("key").alias("key_a"))
    b = tracks.select(F.col("trackid").alias("neighbour"), F.col("bpm").alias("bpm_b"), F.col("key").alias("key_b"))
    return recs.join(a, "seed").join(b, "neighbour")


def harmonic_accuracy(recs: DataFrame, tracks: DataFrame) -> DataFrame:
    return _met(recs, tracks).agg(F.round(F.avg(harmonic(F.col("key_a"), F.col("key_b"))), 6).alias("accuracy"), F.count("*").alias("n"))


def tempo_consistency(recs: DataFrame, tracks: DataFrame, width: float = 2.0) -> DataFrame:
    """Histogram of tempo differences by ``width``, with the mean and deviation of all."""
    steps = _met(recs, tracks).select(F.abs(F.col("bpm_b") - F.col("bpm_a")).alias("step")).where("step is not null").withColumn("step", F.round("step", 6))
    whole = steps.agg(F.round(F.avg("step"), 5).alias("mean_step"), F.round(F.stddev_pop("step"), 5).alias("sd_step"))
    return steps.groupBy(F.floor(F.col("step") / width).alias("bin")).agg(F.count("*").alias("n")).join(F.broadcast(whole))
