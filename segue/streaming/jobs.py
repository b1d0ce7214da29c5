"""Incremental ingestion of tracks and votes as streams over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from segue.operators.tables import init_labels
from segue.streaming.merging import merge_batch, merged_table

VOTE = "event_id LONG, trackid LONG, tag STRING, weight_delta DOUBLE, ts TIMESTAMP"
VOTE_KEYS = ["trackid", "tag"]


def skip_existing(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """``files`` with ``status``: ``failed`` without a path, ``skipped`` if the path is known or came before in ``files``, else ``uploaded``.

    Of several rows with a path the first by its columns counts; each row without a path fails on its own.
    """
    known = tracks.select("filepath").where("filepath is not null").distinct().withColumn("known", F.lit(True))
    named, nameless = files.where("filepath is not null"), files.where("filepath is null").withColumn("status", F.lit("failed"))
    again = F.row_number().over(Window.partitionBy("filepath").orderBy(*(c for c in files.columns if c != "filepath"))) > 1
    status = F.when(F.col("known") | F.col("again"), "skipped").otherwise("uploaded")
    judged = named.withColumn("again", again).join(known, "filepath", "left").withColumn("status", status).drop("known", "again")
    return judged.select(*nameless.columns).unionByName(nameless)


def ingest_tracks(spark: SparkSession, source: str, schema: str, tracks_path: str, labels_path: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """New track rows from a folder of Parquet files: known paths are skipped, the rest is appended with empty labels.

    Each batch is written under its own number, by overwriting, so a batch that runs again after a failure changes nothing. Paths
    are compared with the table, so the stream itself keeps no state.
    """

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        pattern = session.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{tracks_path}/batch=*")
        there = pattern.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)  # the first batch finds no table
        before = session.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(tracks_path).where(F.col("batch") != number) if there else session.createDataFrame([], df.schema)
        judged = skip_existing(df, before)
        fresh = judged.where("status = 'uploaded'").select(df.columns)
        for out, path in ((fresh, tracks_path), (init_labels(fresh), labels_path), (judged.groupBy("status").count(), log_path)):
            out.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_votes(spark: SparkSession, source: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """The latest vote of each track and tag, kept by ``merging``: a batch writes its own votes and, now and then, a bucket.

    There is no watermark: a vote that comes late counts like any other, and repeated events change nothing in the merge.
    """

    def batch(df: DataFrame, number: int) -> None:
        merge_batch(df, number, table_path, VOTE_KEYS, _newest())

    stream = spark.readStream.schema(VOTE).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest() -> list[Column]:
    return [F.desc("ts"), F.desc("event_id")]


def votes_table(spark: SparkSession, table_path: str) -> DataFrame:
    """What ``ingest_votes`` holds now."""
    return merged_table(spark, table_path, spark.createDataFrame([], VOTE).schema, VOTE_KEYS, _newest())
