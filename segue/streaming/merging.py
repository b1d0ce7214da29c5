"""A table of the latest row of each key, kept as small changes by bucket of the key.

A batch writes only its own rows, as a change in each bucket that its keys fall into; a bucket with many changes, or whose changes have
outgrown it, is written anew. So what is written is in proportion to the batch, and now and then to a bucket. The latest row of a key is the
same however often it is merged: a batch that runs again after a failure writes the same folders again, readers see the batches that
are marked as done, and what a bucket no longer needs is deleted only when a later batch begins, as then the one before will not run again.

    table/bucket=3/batch=7/kind=change/...      the rows of batch 7 with keys in bucket 3
    table/bucket=3/batch=7/kind=whole/...       all rows of bucket 3 as of batch 7
    table/_done/7                               batch 7 is whole
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from segue.operators.tables import latest


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, path: str) -> dict[int, list[tuple[int, str, int]]]:
    """For each bucket its folders: batch, kind and bytes. A listing of names, of a few for each bucket."""
    jvm, root, fs = _fs(spark, path)
    out: dict[int, list[tuple[int, str, int]]] = defaultdict(list)
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/batch=*/kind=*")) or ():
        kind, batch, bucket = (p.getName().split("=")[1] for p in (found.getPath(), found.getPath().getParent(), found.getPath().getParent().getParent()))
        out[int(bucket)].append((int(batch), kind, fs.getContentSummary(found.getPath()).getLength()))
    return {b: sorted(x, key=lambda p: p[:2]) for b, x in out.items()}


def _last_done(spark: SparkSession, path: str) -> int:
    jvm, _, fs = _fs(spark, path)
    marks = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_done/*")) or ()
    return max((int(m.getPath().getName()) for m in marks), default=-1)


def _write(df: DataFrame, number: int, kind: str, path: str) -> None:
    out = df.withColumns({"batch": F.lit(number).cast("long"), "kind": F.lit(kind)}).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch", "kind").parquet(path)


def _read(spark: SparkSession, path: str, rows: StructType, folders: list[str]) -> DataFrame:
    schema = StructType([*rows.fields, StructField("bucket", IntegerType()), StructField("batch", LongType()), StructField("kind", StringType())])
    return spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_batch(df: DataFrame, number: int, path: str, keys: list[str], order: list[Column], buckets: int = 16, changes: int = 8) -> None:
    """Adds a batch's rows, of which the first of each key in the order counts. The number of ``buckets`` stays the same for a table;
    a bucket is written anew from ``changes`` changes on, or when these have more bytes than its last whole."""
    spark = df.sparkSession
    jvm, _, fs = _fs(spark, path)
    for bucket, parts in _parts(spark, path).items():  # the batch before is done for good: what its whole buckets replace can go
        since = max((b for b, kind, _ in parts if kind == "whole" and b < number), default=-1)
        for batch, kind, _ in parts:
            if batch < since or (batch == since and kind == "change"):
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}/batch={batch}/kind={kind}"), True)
    _write(latest(df, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), number, "change", path)
    full: list[str] = []
    for bucket, parts in _parts(spark, path).items():
        before = [p for p in parts if p[0] <= number and (p[0], p[1]) != (number, "whole")]
        size = sum(n for b, kind, n in before if kind == "whole")
        late = [n for b, kind, n in before if kind == "change"]
        if len(late) >= changes or (size and len(late) > 1 and sum(late) > size):
            full += [f"{path}/bucket={bucket}/batch={b}/kind={kind}" for b, kind, _ in before]
    if full:
        _write(latest(_read(spark, path, df.schema, full).drop("batch", "kind"), keys, order), number, "whole", path)
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/_done/{number}"), True).close()


def merged_table(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each key, of all batches that are done; ``schema`` is that of the rows. A table without batches is empty."""
    done = _last_done(spark, path)
    folders: list[str] = []
    for bucket, parts in _parts(spark, path).items():
        shown = [p for p in parts if p[0] <= done]
        since = max((b for b, kind, _ in shown if kind == "whole"), default=-1)
        folders += [f"{path}/bucket={bucket}/batch={b}/kind={kind}" for b, kind, _ in shown if b > since or (b == since and kind == "whole")]
    return latest(_read(spark, path, schema, folders).select(*schema.names), keys, order)
