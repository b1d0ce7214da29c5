"""Playlists as sequences, and graphs of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.functions.keys import harmonic
from segue.operators.tables import upsert


def apply_order(crates: DataFrame) -> DataFrame:
    """``session_id, position, trackid`` from ``tracks`` and ``sequence_order``: place i holds the track at ``sequence_order[i]``; bad places go."""
    picked = crates.select("session_id", F.posexplode(F.transform("sequence_order", lambda i: F.get(F.col("tracks"), i))).alias("position", "trackid"))
    return picked.where("trackid is not null")


def transitions(crates: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each track of a session with the next one: tempos and keys of both, tempo step, harmony and their mean score; a missing tempo counts as 120 in the step."""
    joined = crates.join(tracks.select("trackid", "bpm", "key"), "trackid", "left")
    w = Window.partitionBy("session_id").orderBy("position")
    pairs = joined.select("session_id", "position", "trackid", "bpm", "key", F.lead("trackid").over(w).alias("next_track"), F.lead("bpm").over(w).alias("next_bpm"), F.lead("key").over(w).alias("next_key"), F.lead(F.lit(1)).over(w).alias("more")).where("more = 1")
    tempo = lambda c: F.coalesce(c, F.lit(120.0))
    step = pairs.withColumn("bpm_step", F.round(F.abs(tempo("next_bpm") - tempo("bpm")), 6)).withColumn("harmony", harmonic(F.col("key"), F.col("next_key")))
    score = F.round(0.5 * (1 - F.least(F.col("bpm_step") / 20, F.lit(1.0))) + 0.5 * F.col("harmony"), 6)
    return step.select("session_id", "position", "trackid", "next_track", "bpm", "next_bpm", "key", "next_key", "bpm_step", "harmony", score.alias("score"))


def _issues() -> Column:
    """A transition's issues, as an array of ``type, position, severity, details``."""
    said = lambda what, a, b: F.concat(F.lit(what), F.coalesce(F.col(a).cast("string"), F.lit("None")), F.lit(" → "), F.coalesce(F.col(b).cast("string"), F.lit("None"))).alias("details")
    at = F.col("position").cast("int").alias("position")
    tempo = F.when(F.col("bpm_step") > 10, F.struct(F.lit("bpm_incompatibility").alias("type"), at, F.when(F.col("bpm_step") > 15, "high").otherwise("medium").alias("severity"), said("BPM jump: ", "bpm", "next_bpm")))
    keys = F.when(F.col("harmony") < 0.3, F.struct(F.lit("harmonic_clash").alias("type"), at, F.lit("medium").alias("severity"), said("Key clash: ", "key", "next_key")))
    return F.filter(F.array(tempo, keys), lambda x: x.isNotNull())


def sequence_issues(steps: DataFrame) -> DataFrame:
    """``session_id, type, position, severity, details``: tempo jumps above 10 (high above 15) and clashing keys below .3."""
    return steps.select("session_id", F.inline(_issues()))


def validate_sequence(crates: DataFrame, tracks: DataFrame) -> DataFrame:
    """One report per session: ``issues`` and ``transition_scores`` in order, their mean (0 below two tracks), and whether no issue is high."""
    steps = transitions(crates, tracks).withColumn("found", _issues())
    report = steps.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "score", "found"))).alias("steps"))
    sizes = crates.groupBy("session_id").agg(F.count("*").alias("n"))
    found = sizes.join(report, "session_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast(report.schema["steps"].dataType)))
    scores = F.transform("steps", lambda x: x["score"])
    mean = F.when(F.size("steps") > 0, F.round(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size("steps"), 9)).otherwise(0.0)
    issues = F.flatten(F.transform("steps", lambda x: x["found"]))
    return found.select("session_id", "n", issues.alias("issues"), scores.alias("transition_scores"), mean.alias("overall_score"), (~F.exists(issues, lambda x: x["severity"] == "high")).alias("is_mixable"))


def badges(steps: DataFrame) -> DataFrame:
    """``high``, ``medium``, ``good`` (above .7) or nothing for each transition."""
    badge = F.when(F.col("bpm_step") > 15, "high").when((F.col("bpm_step") > 10) | (F.col("harmony") < 0.3), "medium").when(F.col("score") > 0.7, "good").otherwise("none")
    return steps.withColumn("badge", badge)


def without_repeats(crates: DataFrame) -> DataFrame:
    """The first place of each track in a session, places numbered anew."""
    first = crates.withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "trackid").orderBy("position"))).where("_n = 1")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("position")) - 1).drop("_n")


def remove_tracks(crates: DataFrame, gone: DataFrame) -> DataFrame:
    """Sessions without the given tracks, places numbered anew."""
    rest = crates.join(gone.select("trackid").distinct(), "trackid", "left_anti")
    return rest.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("position")) - 1)


def move_track(crates: DataFrame, source: int, target: int) -> DataFrame:
    """In each session the track at ``source`` moved to ``target``."""
    p = F.col("position")
    between = (p > source) & (p <= target) if source < target else (p >= target) & (p < source)
    return crates.withColumn("position", F.when(p == source, target).when(between, p + (-1 if source < target else 1)).otherwise(p))


def recent_crates(crates: DataFrame, now: str) -> DataFrame:
    return crates.where(F.col("modified") > F.to_timestamp(F.lit(now)) - F.expr("interval 24 hours"))


def crate_stats(crates: DataFrame, tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per session: tracks, minutes (four each), rounded mean tempo, energies and the histograms of keys and tags as ``name=count`` lists."""
    one = crates.join(tracks.select("trackid", F.when(F.coalesce("bpm", F.lit(0.0)) == 0, 120.0).otherwise(F.col("bpm")).alias("bpm"), F.coalesce("key", F.lit("Unknown")).alias("key")), "trackid").join(labels.select("trackid", F.coalesce("energy", F.lit(0.5)).alias("energy"), "semantic_tags"), "trackid", "left").withColumn("energy", F.coalesce("energy", F.lit(0.5)))
    basic = one.groupBy("session_id").agg(F.count("*").alias("n"), (F.count("*") * 4).alias("minutes"), F.round(F.round(F.avg("bpm"), 6), 0).cast("long").alias("mean_bpm"), F.round(F.avg("energy"), 6).alias("mean_energy"), F.min("energy").alias("low_energy"), F.max("energy").alias("high_energy"))

    def histogram(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy("session_id", "v").agg(F.count("*").alias("c"))
        return counted.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "v", F.col("c").cast("string")))), ";").alias(name))

    keys = histogram(one.select("session_id", F.col("key").alias("v")), "keys")
    tags = histogram(one.select("session_id", F.explode("semantic_tags").alias("v")), "tags")
    return basic.join(keys, "session_id", "left").join(tags, "session_id", "left")


def save_crates(saved: DataFrame, reports: DataFrame) -> DataFrame:
    """Saved reports with newer ones of the same session in their place; both have ``session_id`` and ``saved_at``."""
    return upsert(saved, reports, ["session_id"], [F.desc("saved_at")])


def artist_edges(tracks: DataFrame, span: int = 1_000_000) -> DataFrame:
    """Consecutive tracks of an artist, by id; tracks without one are chained as ``Unknown``.

    Chains are made within ranges of ``span`` ids, so an artist with very many tracks is no single task, and the last track of a
    range is then chained to the first of the artist's next one.
    """
    ranged = tracks.select(F.coalesce("artist", F.lit("Unknown")).alias("artist"), F.floor(F.col("trackid") / span).alias("range"), "trackid")
    inside = ranged.select(F.col("trackid").alias("source"), F.lead("trackid").over(Window.partitionBy("artist", "range").orderBy("trackid")).alias("target"))
    ends = ranged.groupBy("artist", "range").agg(F.min("trackid").alias("first"), F.max("trackid").alias("last"))
    across = ends.select(F.col("last").alias("source"), F.lead("first").over(Window.partitionBy("artist").orderBy("range")).alias("target"))
    return inside.unionByName(across).where("target is not null").withColumn("type", F.lit("artist"))


def graph_edges(knn: DataFrame, tracks: DataFrame) -> DataFrame:
    similar = knn.select(F.col("seed").alias("source"), F.col("neighbour").alias("target"), F.lit("similarity").alias("type"))
    return similar.unionByName(artist_edges(tracks))
