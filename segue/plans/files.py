"""Files written from the given tables and read back by the readers of music-library formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.plans.base import Tables, query
from segue.plans.basics import CRATE_ROWS
from segue.plans.streams import work_dir
from segue.sources import readers, writers


@query("sc2_tracks_csv", "SELECT trackid, filepath, title, artist, album, bpm, key FROM tracks")
def _(t: Tables):
    at = work_dir(t.spark)
    t.tracks.drop("embedding").write.csv(at, header=True, escape='"')
    return readers.read_tracks_csv(t.spark, at)


@query("sc3_vectors_csv", "SELECT len(embedding) AS width, count(*) AS n FROM embeddings GROUP BY 1")
def _(t: Tables):
    at = work_dir(t.spark)
    t.embeddings.select(F.concat_ws(",", F.col("embedding").cast("array<string>")).alias("value")).write.text(at)
    return readers.read_vectors_csv(t.spark, at).groupBy(F.size("embedding").cast("long").alias("width")).agg(F.count("*").alias("n"))


@query("sc4_analysis_json", "SELECT filepath, title, artist, bpm, key FROM tracks")
def _(t: Tables):
    at = work_dir(t.spark)
    track = F.struct("filepath", "title", "artist", "bpm", "key")
    reports = t.tracks.groupBy("album").agg(F.collect_list(track).alias("tracks"), F.struct(F.count("*").alias("total")).alias("stats"))
    reports.select("stats", "tracks").repartition(4).write.option("maxRecordsPerFile", 1).json(at)
    return readers.read_analysis_json(t.spark, at).select("filepath", "title", "artist", "bpm", "key")


@query("sc5_library_xml", "SELECT title AS name, artist, key AS tonality, CAST(bpm AS VARCHAR) AS bpm FROM tracks WHERE coalesce(title, artist, key, CAST(bpm AS VARCHAR)) IS NOT NULL")
def _(t: Tables):
    at = work_dir(t.spark)
    named = t.tracks.select(F.col("title").alias("_Name"), F.col("artist").alias("_Artist"), F.col("key").alias("_Tonality"), F.col("bpm").cast("string").alias("_AverageBpm"), F.lit("x").alias("note"))
    named.write.format("xml").option("rowTag", "TRACK").option("rootTag", "COLLECTION").save(at)
    return readers.read_library_xml(t.spark, at)


@query("sn7_export_json", CRATE_ROWS)
def _(t: Tables):
    at = work_dir(t.spark)
    writers.export_json(t.crates, t.tracks, at)
    track = "STRUCT<position: LONG, trackid: LONG, title: STRING, artist: STRING, bpm: DOUBLE, key: STRING>"
    back = t.spark.read.schema(f"session_id LONG, tracks ARRAY<{track}>, stats STRUCT<track_count: LONG, minutes: LONG, mean_bpm: DOUBLE>").json(at)
    return back.select("session_id", "stats.*", F.inline("tracks"))
