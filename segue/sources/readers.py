"""Readers of music-library files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TRACK_CSV = "trackid LONG, filepath STRING, title STRING, artist STRING, album STRING, bpm DOUBLE, key STRING"
ANALYSIS = "stats STRUCT<total: LONG, analyzed: LONG, failed: LONG>, tracks ARRAY<STRUCT<filepath: STRING, filename: STRING, file_hash: STRING, title: STRING, artist: STRING, bpm: DOUBLE, key: STRING, key_strength: DOUBLE>>"
#: Extensions of audio files.
AUDIO = ("mp3", "wav", "flac", "m4a", "aac", "ogg")


def read_tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Track metadata with a header; a byte-order mark before it does no harm, as columns are taken by place."""
    return spark.read.schema(TRACK_CSV).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)


def read_vectors_csv(spark: SparkSession, path: str) -> DataFrame:
    """One vector per line, without a header."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split("value", ",").cast("array<float>").alias("embedding"))


def with_position_id(df: DataFrame) -> DataFrame:
    """``trackid`` from 1 on, in the order of rows: the number of rows in the partitions before, and the place in the partition.

    The rows are read twice and must come in the same order both times, as those of a file or a sorted table do. Partitions are
    counted, one row each; nothing else is shuffled.
    """
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + inside + 1).alias("trackid"))


def read_analysis_json(spark: SparkSession, path: str) -> DataFrame:
    """The tracks of analysis reports ``{stats, tracks}``."""
    return spark.read.schema(ANALYSIS).json(path, multiLine=True).select(F.inline("tracks"))


def read_library_xml(spark: SparkSession, path: str) -> DataFrame:
    """``name, artist, tonality, bpm`` of a library's TRACK elements that have any of them."""
    schema = "_Name STRING, _Artist STRING, _Tonality STRING, _AverageBpm STRING"
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(schema).load(path)
    named = raw.select(*(F.nullif(F.col(c), F.lit("")).alias(n) for c, n in (("_Name", "name"), ("_Artist", "artist"), ("_Tonality", "tonality"), ("_AverageBpm", "bpm"))))
    return named.where(F.coalesce("name", "artist", "tonality", "bpm").isNotNull())


def audio_only(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*AUDIO))


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """Audio files under a folder, at any depth."""
    return audio_only(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))


def file_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of each file, and how many files share it."""
    hashed = files.select("path", F.sha2("content", 256).alias("file_hash"))
    return hashed.join(hashed.groupBy("file_hash").agg(F.count("*").alias("copies")), "file_hash")
