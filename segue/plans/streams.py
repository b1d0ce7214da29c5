"""Streams run to their end over a copy of the given tables, whose final tables equal the batch results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession, functions as F

from segue.plans.base import Tables, query
from segue.streaming import jobs


def work_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder, or a temporary one where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/streams-{uuid.uuid4().hex}"


@query("st1_ingest_tracks", "SELECT trackid, filepath FROM tracks WHERE filepath IS NOT NULL")
def _(t: Tables):
    """All tracks, delivered in two overlapping folders' worth of files."""
    at = work_dir(t.spark)
    rows = t.tracks.select("trackid", "filepath")
    rows.where("trackid % 3 < 2").repartition(3).write.parquet(f"{at}/in")
    rows.where("trackid % 3 > 0").repartition(3).write.mode("append").parquet(f"{at}/in")
    jobs.ingest_tracks(t.spark, f"{at}/in", "trackid LONG, filepath STRING", f"{at}/tracks", f"{at}/labels", f"{at}/log", f"{at}/state").awaitTermination()
    return t.spark.read.parquet(f"{at}/tracks").select("trackid", "filepath")


@query("st2_latest_votes", "SELECT event_id, trackid, tag, weight_delta FROM (SELECT *, row_number() OVER (PARTITION BY trackid, tag ORDER BY ts DESC, event_id DESC) AS n FROM votes) WHERE n = 1")
def _(t: Tables):
    """All votes, in four deliveries that are not in the order of time, each vote coming in two of them."""
    at = work_dir(t.spark)
    votes = t.votes.select("event_id", "trackid", "tag", "weight_delta", F.col("ts").cast("timestamp").alias("ts"))
    for i in range(4):  # by a hash of the event, so that early votes come after late ones
        turn = F.pmod(F.xxhash64("event_id"), F.lit(4))
        votes.where(turn.isNull() | turn.isin(i, (i + 1) % 4)).write.mode("append").parquet(f"{at}/in")
        jobs.ingest_votes(t.spark, f"{at}/in", f"{at}/votes", f"{at}/state").awaitTermination()
    return jobs.votes_table(t.spark, f"{at}/votes").select("event_id", "trackid", "tag", "weight_delta")
