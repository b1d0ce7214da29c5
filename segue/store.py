"""The shared scratch folder: tables that are written between stages, so that a lost executor costs one stage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset, the context's checkpoint folder serves; a session on one machine (``local`` master) that has neither gets
    a temporary folder as its checkpoint folder. On a cluster a machine's own folder would lose rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/segue-{uuid.uuid4().hex}"


#: The scratch folders of each open ``scratch`` block, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``written`` inside the block are deleted at its end, but for those to ``keep``; these belong to the block around it, if any."""
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in mine:
            removed(spark, path)


def written(df: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again: the lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    blocks = _OPEN.get()[: -1 if keep else None]
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that ``written`` made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
