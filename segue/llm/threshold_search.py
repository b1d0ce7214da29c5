"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Vectors are rounded down to integers (``scale`` times each component), so scores are exact. Candidates are dealt into blocks,
queries into blocks of their own, and each pair of blocks meets in one task. There, each dimension's list is sorted; for a
query the lists are read from the end that its sign favours, further in each round, what appears is scored in full, and the
query stops once the kth score beats the bound that the next entries leave (strictly, as ties go to the smaller id).

Null vectors, vectors with a null or non-finite component and rows with a null id take no part; vectors of different widths
never meet. Scores must fit a 64-bit integer. Rows with the query's id are its own. Rows that share another id are candidates each. A table with fewer than
``k`` candidates gives all of them; an empty one gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F



def rounded(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v``: the vectors that take part, as integers."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class SortedLists:
    """One block of candidates with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, self.floats = ids, x, x.astype(np.float64)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.most = np.abs(x).max(initial=0)

    def top(self, query_id: int, q: np.ndarray, k: int, first_depth: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's ``k`` best in the block, best first."""
        n = len(self.x)
        exact = float(self.most) * float(np.abs(q).sum()) < 2**53
        x, weights = (self.floats, q.astype(np.float64)) if exact else (self.x, q)  # products of doubles are exact below 2**53
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        seen[self.ids == query_id] = True
        at = np.empty(0, np.int64)
        scores = np.empty(0, np.int64)
        depth, step = 0, first_depth
        while not seen.all():
            until = min(n, depth + step)
            new = np.zeros(n, bool)
            new[self.order[n - until : n - depth, up]] = True
            new[self.order[depth:until, down]] = True
            if until == n:
                new[:] = True
            new &= ~seen
            found = np.flatnonzero(new)
            seen |= new
            at = np.concatenate([at, found])
            scores = np.concatenate([scores, (x[found] @ weights).astype(np.int64)])
            if until == n:
                break
            if len(scores) >= k:
                bound = int(self.sorted[n - until, up] @ q[up]) + int(self.sorted[until - 1, down] @ q[down])
                if np.partition(scores, len(scores) - k)[len(scores) - k] > bound:
                    break
            depth, step = until, step * 4
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[best]], scores[best]


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, candidate_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each row whose id is divisible by ``every``, against all rows."""
    known = rounded(vectors, scale).withColumn("width", F.size("v"))
    asked = known.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    blocks = max(1, -(-known.count() // candidate_block))
    query_blocks = max(1, -(-asked.count() // query_block))
    own = known.select("width", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("asking"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asking = asked.select("width", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("asking"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = own.unionByName(asking).repartition(blocks * query_blocks, "width", "asking", "block").sortWithinPartitions("width", "asking", "block", "asks", "vec_id")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, rows, lists = None, [], [], None
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for *at, asks, vec_id, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != place:
                    place, ids, rows, lists = at, [], [], None
                if not asks:
                    ids.append(vec_id)
                    rows.append(v)
                    continue
                if lists is None:
                    lists = SortedLists(np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), -1)) if ids else None
                if lists is not None:
                    found, scores = lists.top(vec_id, np.array(v, np.int64), k)
                    out.append((np.full(len(found), vec_id), found, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(best, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
