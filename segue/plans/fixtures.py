"""Tracks, labels, votes, crates and requests, derived by Spark from the given tables, and the same views in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The words that make up ``feat``, one dimension each, in alphabetical order.
WORDS = ("anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring", "rod", "small", "widget")

TRACKS = """
SELECT p.p_partkey AS trackid,
  concat('/library/', lower(p.p_type), '/', CAST(p.p_partkey AS {string}), ' - ', p.p_name, CASE WHEN p.p_partkey % 3 = 0 THEN '.mp3' WHEN p.p_partkey % 3 = 1 THEN '.flac' ELSE '.txt' END) AS filepath,
  CASE WHEN p.p_partkey % 29 = 0 THEN NULL ELSE p.p_name END AS title,
  CASE WHEN p.p_partkey % 31 = 0 THEN NULL ELSE p.p_brand END AS artist,
  p.p_type AS album,
  CASE WHEN p.p_partkey % 17 = 0 THEN NULL WHEN p.p_partkey % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) + p.p_size * CAST(0.9 AS DOUBLE), 1) END AS bpm,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL WHEN p.p_partkey % 11 = 3 THEN 'Am' WHEN p.p_partkey % 11 = 5 THEN 'C major' WHEN p.p_partkey % 19 = 4 THEN 'F#m' WHEN p.p_partkey % 19 = 7 THEN 'Eb minor' WHEN p.p_partkey % 23 = 6 THEN 'H' ELSE concat(CAST(1 + p.p_partkey % 12 AS {string}), CASE WHEN p.p_partkey % 24 < 12 THEN 'A' ELSE 'B' END) END AS key,
  e.embedding AS embedding
FROM part p LEFT JOIN embeddings e ON e.vec_id = p.p_partkey"""
LABELS = """
SELECT p.p_partkey AS trackid, CASE WHEN p.p_partkey % 5 = 1 THEN NULL ELSE {tags} END AS semantic_tags,
  CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE CAST(1 + p.p_partkey % 10 AS DOUBLE) END AS energy, {vibe} AS vibe
FROM part p WHERE p.p_partkey % 5 <> 0"""
VOTES = """
SELECT event_id, user_id AS trackid, concat('Brand#', CAST(1 + event_id % 25 AS {string})) AS tag,
  CAST(CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'click' THEN 1.0 ELSE -1.5 END AS DOUBLE) AS weight_delta, ts
FROM events WHERE event_type IN ('purchase', 'click', 'error')"""
CRATES = """
SELECT l_orderkey AS session_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS position,
  l_partkey AS trackid FROM lineitem"""
REQUESTS = """
SELECT p_partkey AS request_id, concat('give me ', CAST(1 + p_size % 9 AS {string}), ' ', CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END, ' tracks, ',
  CASE p_type WHEN 'ECONOMY' THEN 'chill' WHEN 'PROMO' THEN 'peak' WHEN 'SMALL' THEN 'groovy' ELSE 'anything' END) AS text
FROM part"""
_LIST = ", ".join(f"'{w}'" for w in WORDS)
FEAT = """
SELECT t.trackid, {each} AS feat FROM tracks t JOIN part p ON p.p_partkey = t.trackid WHERE t.embedding IS NOT NULL"""

_SPARK = {
    "tracks": TRACKS.format(string="STRING"),
    "track_labels": LABELS.format(tags="array_distinct(flatten(array(split(p.p_name, ' '), array(p.p_name, p.p_brand))))", vibe="array(lower(p.p_type))"),
    "votes": VOTES.format(string="STRING"),
    "crates": CRATES,
    "requests": REQUESTS.format(string="STRING"),
    "feat": FEAT.format(each=f"transform(array({_LIST}), (w, i) -> CASE WHEN array_contains(split(p.p_name, ' '), w) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(0.5 AS DOUBLE) * t.embedding[i])"),
}
_DUCK = {
    "tracks": TRACKS.format(string="VARCHAR"),
    "track_labels": LABELS.format(tags="list_distinct(list_concat(string_split(p.p_name, ' '), [p.p_name, p.p_brand]))", vibe="[lower(p.p_type)]"),
    "votes": VOTES.format(string="VARCHAR"),
    "crates": CRATES,
    "requests": REQUESTS.format(string="VARCHAR"),
    "feat": FEAT.format(each=f"list_transform([{_LIST}], lambda w, i: CASE WHEN list_contains(string_split(p.p_name, ' '), w) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(0.5 AS DOUBLE) * t.embedding[i])"),
}
_NEEDS = {"tracks": ("part", "embeddings"), "track_labels": ("part",), "votes": ("events",), "crates": ("lineitem",), "requests": ("part",), "feat": ("part", "embeddings")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables; nothing is registered in the session's catalog."""
    return _derived(spark, sf_dir, name, {})


def _derived(spark: SparkSession, sf_dir: str, name: str, hints: dict[str, str]) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _NEEDS[name]}
    if name == "feat":
        # Both joins are of tables that grow, and a column of keys is a small file: neither may be broadcast, as several would meet in the driver.
        frames["tracks"] = _derived(spark, sf_dir, "tracks", {"embeddings": "merge"}).hint("merge")
    frames |= {t: frames[t].hint(h) for t, h in hints.items()}
    text = re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", _SPARK[name])
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """The SQL with the derived tables that it names in front."""
    names = [n for n in _DUCK if n in sql]
    if "feat" in names and "tracks" not in names:
        names.append("tracks")
    names.sort(key=list(_DUCK).index)
    ctes = ", ".join(f"{n} AS ({_DUCK[n]})" for n in names)
    body = sql.strip()
    if not names:
        return body
    return f"WITH RECURSIVE {ctes}, {body[5:].removeprefix('RECURSIVE ').strip()}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
