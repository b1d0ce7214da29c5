"""Two tables without an equality to join on, met in pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from segue.store import written


def distinct(asking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows ``id, asked`` (and further columns) those that ask for different things, ``id, asked`` by their least id, and ``request_id, first`` (and further
    columns): whose answer each request has. Neither side of the join is broadcast, as a small file may hold very many rows."""
    keyed = asking.withColumn("key", F.xxhash64("asked"))  # what is asked is compared as well
    firsts = written(keyed.groupBy("key", "asked").agg(F.min("id").alias("id")))
    members = keyed.withColumnRenamed("id", "request_id").join(firsts.withColumnRenamed("id", "first").hint("merge"), ["key", "asked"])
    return firsts.select("id", "asked"), written(members.select("request_id", "first", *(c for c in asking.columns if c not in ("id", "asked"))))


def told(answers: DataFrame, members: DataFrame) -> DataFrame:
    """The answers to the first of equal requests, for each of them."""
    return members.hint("merge").join(answers.withColumnRenamed("request_id", "first"), "first").drop("first")


def sides(asking: DataFrame, own: DataFrame, most: tuple[int, int], least: int = 256, whole: bool = False) -> tuple[int, int, int]:
    """Blocks of each side, and tasks: blocks hold ``most`` rows at most, as few as keep all cores busy but not below ``least``, and the
    number of tasks follows the cores and the rows dealt, not the pairs of blocks. With ``whole`` those that ask are cut before the own rows are."""
    counts = [df.count() for df in (asking, own)]
    cores = asking.sparkSession.sparkContext.defaultParallelism
    left, right = (max(1, -(-n // m)) for n, m in zip(counts, most, strict=True))
    while left * right < 2 * cores and max(counts[0] // left, counts[1] // right) > least:
        if counts[0] // left >= counts[1] // right or (whole and counts[0] // left > least):
            left *= 2
        else:
            right *= 2
    dealt = counts[0] * right + counts[1] * left
    return left, right, min(left * right, max(4 * cores, dealt // 200_000))


def dealt(asking: DataFrame, own: DataFrame, most: tuple[int, int], whole: bool = False) -> DataFrame:
    """``a, b, asks, id, asked, own``: each block of ``asking`` (``id, asked``) with each block of ``own`` (``id, own``).

    A pair of blocks lies in one task, its own rows before those that ask; a task may hold several pairs, one after the other.
    """
    left, right, tasks = sides(asking, own, most, whole=whole)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lent = own.select(every(left).alias("a"), deal(right).alias("b"), F.lit(False).alias("asks"), "id", F.lit(None).alias("asked"), "own")
    asks = asking.select(deal(left).alias("a"), every(right).alias("b"), F.lit(True).alias("asks"), "id", "asked", F.lit(None).alias("own"))
    return lent.unionByName(asks).repartitionById(tasks, ((F.col("a") * right + F.col("b")) % tasks).cast("int")).sortWithinPartitions("a", "b", "asks", "id")


def pairs(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """From rows of ``dealt``: a block's own rows ``(id, own)``, the same list for all of a pair, and up to ``rows`` rows ``(id, asked)`` that ask."""
    place, held, asking = None, [], []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for *where, asks, id_, asked, own in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                if where != place:
                    if asking and held:
                        yield held, asking
                    place, held, asking = where, [], []
                if not asks:
                    held.append((id_, own))
                    continue
                asking.append((id_, asked))
                if len(asking) == rows:
                    if held:
                        yield held, asking
                    asking = []
    if asking and held:
        yield held, asking


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """From rows of ``dealt``: place, whether the rows ask, and the rows, up to ``rows`` at a time; they are not turned into objects."""
    for batch in batches:
        a, b, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ends = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (asks[1:] != asks[:-1])) + 1
        for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            for at in range(start, end, rows):
                yield (int(a[at]), int(b[at])), bool(asks[at]), batch.slice(at, min(rows, end - at))


def highest(score: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """The ``n`` highest of the scores (of those ``at`` some places), equal ones by place, in the order of places."""
    of = score if at is None else score[at]
    if len(of) <= n:
        return np.arange(len(of)) if at is None else at
    some = of[: 16 * n + 1024]
    least = np.partition(some, len(some) - n)[len(some) - n] if n < len(some) else -np.inf
    near = np.flatnonzero(of >= least)
    least = np.partition(of[near], len(near) - n)[len(near) - n]
    over, even = near[of[near] > least], near[of[near] == least]
    best = np.sort(np.concatenate([over, even[: n - len(over)]]))
    return best if at is None else at[best]


def cut(asking: int, own: int, cores: int, most: int, least: int = 256) -> tuple[int, int]:
    """Blocks of asking vectors and shares of the own ones for ``streamed``: two tasks for each core, if there are rows enough.

    The own side is left whole where the asking one gives tasks enough, as each share adds its own best to what leaves the tasks.
    """
    tasks = 2 * cores
    shares = max(1, round(tasks**0.5 / 5))
    left = max(1, -(-asking // most), min(-(-tasks // shares), -(-asking // least)))
    return left, max(1, min(max(shares if left >= cores else 1, -(-tasks // left)), -(-own // least)))


def streamed(asking: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """``a, b, lent, id, unit``: each block of ``asking`` (``id, unit``) with each share of ``own`` (``id, unit``) in one task, first the rows that ask, which a
    task can hold (``most``), then the own ones by id. The number of blocks follows the cores, not the rows, so what is dealt grows with the rows alone
    until a block is full. Each such pair is a partition of its own, so none waits for others that a hash has put beside it."""
    left, right = cut(asking.count(), own.count(), asking.sparkSession.sparkContext.defaultParallelism, most)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asking.select(deal(left).alias("a"), every(right).alias("b"), F.lit(False).alias("lent"), "id", "unit")
    lent = own.select(every(left).alias("a"), deal(right).alias("b"), F.lit(True).alias("lent"), "id", "unit")
    return asks.unionByName(lent).repartitionById(left * right, (F.col("a") * right + F.col("b")).cast("int")).sortWithinPartitions("a", "b", "lent", "id")


def vector_runs(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[tuple[tuple[int, int], bool, np.ndarray, np.ndarray]]:
    """From rows of ``streamed``: place, whether the rows are own ones, their ids and their matrix, up to ``rows`` rows at a time."""
    for batch in batches:
        a, b, lent = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ends = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (lent[1:] != lent[:-1])) + 1
        for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            for at in range(start, end, rows):
                n = min(rows, end - at)
                ids = batch.column(3).slice(at, n)
                ids = np.array(ids.to_pylist()) if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else ids.to_numpy(zero_copy_only=False)
                if n:
                    yield (int(a[at]), int(b[at])), bool(lent[at]), ids, batch.column(4).slice(at, n).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
