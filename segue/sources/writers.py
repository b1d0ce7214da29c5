"""Exports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def m3u(crates: DataFrame, tracks: DataFrame) -> DataFrame:
    """``session_id, m3u``: each session's playlist; a missing duration counts as 240 seconds."""
    one = crates.join(tracks, "trackid")
    duration = F.coalesce(F.col("duration"), F.lit(240)) if "duration" in tracks.columns else F.lit(240)
    line = F.concat(F.lit("#EXTINF:"), duration.cast("string"), F.lit(","), F.coalesce("artist", F.lit("Unknown Artist")), F.lit(" - "), F.coalesce("title", F.lit("Unknown Title")), F.lit("\n"), F.coalesce("filepath", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return one.groupBy("session_id").agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("m3u"))


def crate_json(crates: DataFrame, tracks: DataFrame) -> DataFrame:
    """``session_id, json``: each session with its tracks in order and simple statistics."""
    one = crates.join(tracks.select("trackid", "title", "artist", "bpm", "key"), "trackid")
    ordered = F.array_sort(F.collect_list(F.struct("position", "trackid", "title", "artist", "bpm", "key")))
    grouped = one.groupBy("session_id").agg(ordered.alias("tracks"), F.struct(F.count("*").alias("track_count"), (F.count("*") * 4).alias("minutes"), F.round(F.round(F.avg("bpm"), 6)).alias("mean_bpm")).alias("stats"))
    return grouped.select("session_id", F.to_json(F.struct("session_id", "tracks", "stats")).alias("json"))


def export_json(crates: DataFrame, tracks: DataFrame, path: str) -> None:
    """One JSON line per session."""
    crate_json(crates, tracks).select(F.col("json").alias("value")).write.text(path)


def log_operation(spark: SparkSession, operation: str, sources: list[str], target: str, affected: int) -> DataFrame:
    """One row for the log of tag operations, to append."""
    schema = "operation_type STRING, payload STRUCT<source_tags: ARRAY<STRING>, target_tag: STRING, affected_tracks: LONG>"
    return spark.createDataFrame([(operation, (sources, target, affected))], schema)


def ingest_stats(df: DataFrame) -> DataFrame:
    """Totals by ``status``."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("uploaded", "skipped", "failed")))
