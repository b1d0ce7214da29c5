"""Votes that come late, in a delivery of their own, count."""

from datetime import datetime

from segue.streaming import jobs


def test_backfill(spark, tmp_path):
    def delivered(rows):
        spark.createDataFrame([(e, i, t, w, datetime(2026, 1, d)) for e, i, t, w, d in rows], jobs.VOTE).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.ingest_votes(spark, f"{tmp_path}/in", f"{tmp_path}/votes", f"{tmp_path}/state").awaitTermination()

    delivered([(1, 1, "a", 1.0, 20)])
    delivered([(2, 2, "a", 1.0, 21)])
    delivered([(3, 3, "b", 1.0, 2), (4, 1, "a", -1.0, 3), (1, 1, "a", 1.0, 20)])  # a backfill: weeks older, one event repeated
    delivered([(5, 3, "b", -1.0, 4)])
    assert sorted((r.event_id, r.trackid, r.tag) for r in jobs.votes_table(spark, f"{tmp_path}/votes").collect()) == [(1, 1, "a"), (2, 2, "a"), (5, 3, "b")]
