"""The merged table against a dictionary, through failures, and what a batch writes."""

import os
import random

from pyspark.sql import functions as F

from segue.streaming import merging

SCHEMA = "event_id long, trackid long, tag string, weight_delta double, ts long"
KEYS = ["trackid", "tag"]


def order():
    return [F.desc("ts"), F.desc("event_id")]


def held(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted((tuple(x) for x in merging.merged_table(spark, path, schema, KEYS, order()).collect()), key=lambda x: x[0])


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_batches_and_failures(spark, tmp_path, monkeypatch):
    path, r, want = f"{tmp_path}/t", random.Random(2), {}
    assert held(spark, path) == []
    event = 0
    for number in range(9):
        rows = []
        for _ in range(r.randint(0, 60)):
            event += 1
            rows.append((event, r.randint(0, 30), r.choice("abc"), float(r.randint(-2, 2)), r.randint(0, 50)))
        before = sorted(want.values(), key=lambda x: x[0])
        for row in rows:
            key = row[1:3]
            want[key] = max(want.get(key, row), row, key=lambda x: (x[4], x[0]))
        df = spark.createDataFrame(rows, SCHEMA).repartition(2)
        if number % 3 == 1:  # the writer is lost, after its first write or after all of them but before the batch is marked
            calls = []
            real = merging._write

            def failing(*args, last=number % 2):
                real(*args)
                calls.append(1)
                if len(calls) > last:
                    raise OSError("lost")

            monkeypatch.setattr(merging, "_write", failing)
            try:
                merging.merge_batch(df, number, path, KEYS, order(), buckets=4, changes=3)
            except OSError:
                assert held(spark, path) == before  # nothing of a batch shows before it is done
            monkeypatch.undo()
        merging.merge_batch(df, number, path, KEYS, order(), buckets=4, changes=3)
        assert held(spark, path) == sorted(want.values(), key=lambda x: x[0])
    merging.merge_batch(df, 8, path, KEYS, order(), buckets=4, changes=3)  # the last batch once more
    assert held(spark, path) == sorted(want.values(), key=lambda x: x[0])


def test_a_small_batch_writes_little(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(200_000).select(F.col("id").alias("event_id"), (F.col("id") % 50_000).alias("trackid"), F.lit("x").alias("tag"), F.rand(1).alias("weight_delta"), F.col("id").alias("ts"))
    merging.merge_batch(rows, 0, path, KEYS, order())
    whole = size(path)
    for number in range(1, 4):
        merging.merge_batch(rows.limit(20).withColumn("ts", F.col("ts") + 10**6 * number), number, path, KEYS, order())
    assert size(path) - whole < 0.1 * whole
    assert len(held(spark, path)) == 50_000


def test_keys_without_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None, None, None), (2, None, None, 1.0, 5), (3, 7, None, 1.0, None)], SCHEMA)
    merging.merge_batch(df.limit(0), 0, f"{tmp_path}/t", KEYS, order())
    merging.merge_batch(df, 1, f"{tmp_path}/t", KEYS, order())
    assert sorted(x[0] for x in held(spark, f"{tmp_path}/t")) == [2, 3]
