"""What the training-data operators share: table reading, the shared scratch folder, Arrow helpers.

Conventions used by every operator here unless its docstring says otherwise: a null text counts as
the empty text, a null ``doc_id`` is carried through as a row of its own, only the columns an operator
names are read (so extra columns, clashing names included, are ignored), and an empty table gives an
empty result with the full schema.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from segue.store import removed, scratch, scratch_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from any store that Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text made empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is executed inside the block sends Python workers so many rows at once, for rows of many kilobytes; the session's setting comes back at its end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def hash_bound(most: int, n: int) -> int | None:
    """The greatest 64-bit hash below which some four times ``most`` of ``n`` rows fall; none if that is all of them."""
    return None if 4 * most >= n else -(2**63) + 2**64 * 4 * most // n


def sample(docs: DataFrame, most: int, n: int | None = None) -> DataFrame:
    """At most ``most`` rows, those with the least hashes of ``doc_id`` and ``text``: the same rows on every run, and never none of many.

    A bound on the hash, from the number of rows, leaves few rows to be put in order, whatever the size of the table.
    """
    at = F.xxhash64("doc_id", "text")
    bound = hash_bound(most, docs.count() if n is None else n)
    near = docs if bound is None else docs.where(at <= bound)
    return near.orderBy(at, "doc_id", "text").limit(most)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a partition, which gives the memory that it freed back to the machine at its end: workers live on between stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def mapped(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, batch: int = 512) -> DataFrame:
    """``mapInArrow`` over Python tuples: ``rows`` takes the partition's rows one by one and yields result tuples.

    Results leave in batches of ``batch`` rows or some eight megabytes, so that memory stays bounded by a few rows and not by the partition.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        size = 0
        for r in rows(source()):
            held.append(r)
            size += sum(len(v) for v in r if isinstance(v, str | bytes))
            if len(held) >= batch or size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    return df.mapInArrow(tidied(run), schema)
