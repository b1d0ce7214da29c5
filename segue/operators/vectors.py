"""Nearest neighbours and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from segue.functions.keys import compatible, harmonic
from segue.functions.scores import bpm_factor, norm, unit
from segue.operators import blocks


def unit_vectors(df: DataFrame, vector: str = "embedding", key: str = "trackid", raw: bool = False) -> DataFrame:
    """``key, unit`` of the usable vectors: present, finite and not all zero; with ``raw`` the vector as well."""
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(sound, F.lit(False))).where(norm(v) > 0).select(key, *([v.alias("raw")] if raw else []), unit(v).alias("unit"))


def knn(df: DataFrame, k: int, seeds: DataFrame | None = None, vector: str = "embedding", threshold: float | None = None, block: int = 65536) -> DataFrame:
    """``seed, neighbour, sim, rank``: the ``k`` most similar tracks of each seed (all tracks by default), itself left out."""
    units = unit_vectors(df, vector)
    asked = units if seeds is None else units.join(seeds.select("trackid").distinct(), "trackid", "left_semi")
    return nearest(asked.select(F.col("trackid").alias("seed"), "unit"), units.select(F.col("trackid").alias("neighbour"), "unit"), k, threshold, block)


def block_products(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Asking ids, a block's own ids and their cosines (six places), for up to ``rows`` asking ids at a time, from rows of ``blocks.dealt``."""
    held = None
    for own, asking in blocks.pairs(batches, rows):
        if own is not held:
            held, ids, matrix = own, np.array([i for i, _ in own]), np.array([v for _, v in own])
        yield [i for i, _ in asking], ids, np.round(np.array([v for _, v in asking]) @ matrix.T, 6) + 0.0


def _first(r: np.ndarray, s: np.ndarray, p: np.ndarray, k: int, ties: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows ``r`` with similarities ``s`` and places ``p`` the first ``k`` of each row (with ``ties`` all as near as the last of them), in order."""
    order = np.lexsort((p, -s, r))
    r, s, p = r[order], s[order], p[order]
    first = np.searchsorted(r, r)
    kept = s >= s[np.minimum(first + k, np.searchsorted(r, r, "right")) - 1] if ties else np.arange(len(r)) - first < k
    return r[kept], s[kept], p[kept]


def _places(marks: np.ndarray) -> np.ndarray:
    """Where the few true ones of many marks are; eight marks are looked at together."""
    flat = marks.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[some])
    return some[i] * 8 + j


class _Asking:
    """Asking vectors of a task and the best of the own ones that have passed so far: of all own vectors only those above a row's ``k``-th best are looked at.

    Products of single precision tell which these may be: those of unit vectors are at most ``slack`` from the exact ones, in whatever order
    they are summed. What they let pass is worked out in double precision, and waits until there is enough to be worth a sort.
    """

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int, threshold: float | None, same: bool, ties: bool) -> None:
        self.ids, self.units, self.k, self.threshold, self.same, self.ties = ids, units, k, threshold, same, ties
        self.short, self.slack = units.astype(np.float32), (units.shape[1] + 8) * 2.0**-24
        self.bar = np.full(len(ids), -np.inf if threshold is None else threshold - 1e-6)
        none = np.zeros(0, np.int64)
        self.waiting, self.passed = [(none, np.zeros(0), none)], 0

    @property
    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, similarities and places, in order."""
        self.settle()
        return self.waiting[0]

    def meet(self, ids: np.ndarray, units: np.ndarray, base: int, short: np.ndarray | None = None, room: np.ndarray | None = None) -> None:
        """Own vectors by id, all after those that came before; the first has the place ``base``. ``short`` are the same, and ``room`` has place for the products."""
        n, width = len(self.ids), len(ids)
        near = np.matmul(self.short, (units.astype(np.float32) if short is None else short).T, out=None if room is None else room[: n * width].reshape(n, width))
        if not self.same:
            low, high = np.searchsorted(ids, self.ids), np.searchsorted(ids, self.ids, "right")
            for i in np.flatnonzero(low < high).tolist():
                near[i, low[i] : high[i]] = -np.inf
        over = near > (self.bar - self.slack).astype(np.float32)[:, None]
        at = _places(over)
        if width > self.k and len(at) > 4 * self.k:
            many = np.flatnonzero(np.bincount(at // width, minlength=n) > 4 * self.k)
            if len(many):
                over[many] = self.nearer(many, near[many], units)
                at = _places(over)
        r, c = np.divmod(at, width)
        r, c = (x[near.ravel()[at] > -np.inf] for x in (r, c))
        if not len(r):
            return
        s = np.concatenate([np.einsum("ij,ij->i", self.units[r[i : i + 16384]], units[c[i : i + 16384]]) for i in range(0, len(r), 16384)])
        above, s = s > self.bar[r], np.round(s, 6) + 0.0
        sound = above & (s > (-np.inf if self.threshold is None else self.threshold))
        if sound.any():
            self.waiting.append((r[sound], s[sound], c[sound] + base))
            self.passed += np.count_nonzero(sound)
            if len(self.waiting[0][0]) == 0 or 2 * self.passed > self.k * n:
                self.settle()

    def nearer(self, rows: np.ndarray, near: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Of own vectors the ``k`` best of each of the rows, where single precision lets many pass: there are many as near, or nothing has come before."""
        sims = np.round(self.units[rows] @ units.T, 6) + 0.0
        sims[(near == -np.inf) | ~(sims > self.bar[rows][:, None])] = -np.inf
        last = np.partition(sims, -self.k, axis=1)[:, -self.k, None]
        if self.ties:
            return (sims >= last) & (sims > -np.inf)
        above, even = sims > last, sims == last
        return (above | (even & (np.cumsum(even, axis=1) <= self.k - above.sum(axis=1)[:, None]))) & (sims > -np.inf)

    def settle(self) -> None:
        """Sorts what waits into the best."""
        if len(self.waiting) == 1:
            return
        r, s, p = _first(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)), self.k, self.ties)
        self.waiting, self.passed = [(r, s, p)], 0
        ends = np.searchsorted(r, np.arange(len(self.ids))) + self.k - 1
        full = np.flatnonzero(np.bincount(r, minlength=len(self.ids)) >= self.k)
        # A later id must be nearer after rounding, or as near where ties stay.
        self.bar[full] = np.maximum(self.bar[full], s[ends[full]] + (-5e-7 if self.ties else 5e-7) - 1e-9)


def nearest(asked: DataFrame, own: DataFrame, k: int, threshold: float | None = None, block: int = 65536, same: bool = False, ties: bool = False) -> DataFrame:
    """``seed, neighbour, sim, rank``: the ``k`` most similar of ``own`` (``neighbour, unit``) for each of ``asked`` (``seed, unit``), equal ids left out but for ``same``.
    With ``ties`` all that are as near as the last of them.

    Cosines are rounded to six places and ties go to the smaller id; ids are numbers or strings. A task holds a block of asking vectors and
    their best so far, and the own ones pass by in tiles, each a matrix product. So only the best ``k`` of a row and share leave a task, and
    what is shuffled grows with the vectors, not with their pairs; all pairs are looked at, and no table is ever collected.
    """
    kinds = dict(asked.dtypes)["seed"], dict(own.dtypes)["neighbour"]
    kind = kinds[0] if kinds[0] == kinds[1] else "string"
    dealt = blocks.streamed(asked.select(F.col("seed").cast(kind).alias("id"), "unit"), own.select(F.col("neighbour").cast(kind).alias("id"), "unit"), max(1, min(block, 10_000_000 // k)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asking, passed, seen, room = None, [], [], 0, np.empty(256 * 2048, np.float32)

        def done() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(passed) if passed else None
            for x in asking:
                r, s, p = x.best
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(x.ids[r]), pa.array(every[p]), pa.array(s)], names=["seed", "neighbour", "sim"])

        for at, lent, ids, units in blocks.vector_runs(batches, 2048):
            if at != place:
                yield from done()
                place, asking, passed, seen = at, [], [], 0
            if not lent:
                asking += [_Asking(ids[i : i + 256], units[i : i + 256], k, threshold, same, ties) for i in range(0, len(ids), 256)]
            elif asking:
                short = units.astype(np.float32)
                for x in asking:
                    x.meet(ids, units, seen, short, room)
                passed.append(ids)
                seen += len(ids)
        yield from done()

    found = dealt.mapInArrow(best, f"seed {kind}, neighbour {kind}, sim double").select(F.col("seed").cast(kinds[0]).alias("seed"), F.col("neighbour").cast(kinds[1]).alias("neighbour"), "sim")
    ranked = found.withColumn("rank", F.rank().over(Window.partitionBy("seed").orderBy(F.desc("sim"))) if ties else F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("sim"), "neighbour")))
    return ranked.where(F.col("rank") <= k)


def all_cosines(asked: DataFrame, own: DataFrame, block: int = 2048) -> DataFrame:
    """``seed, neighbour, sim`` of every pair of ``asked`` (``seed, unit``, numbers) and ``own`` (``neighbour, unit``, strings), as blocks of matrix products."""
    dealt = blocks.dealt(asked.select(F.col("seed").cast("string").alias("id"), F.col("unit").alias("asked")), own.select(F.col("neighbour").alias("id"), F.col("unit").alias("own")), (block, block))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seeds, ids, sims in block_products(batches, 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(seeds), len(ids))), pa.array(np.tile(ids, len(seeds))), pa.array(sims.ravel())], names=["seed", "neighbour", "sim"])

    return dealt.mapInArrow(every, "seed string, neighbour string, sim double").select(F.col("seed").cast("long").alias("seed"), "neighbour", "sim")


def vector_search(tracks: DataFrame, seeds: DataFrame, limit: int, threshold: float = 0.7) -> DataFrame:
    """Neighbours above a threshold (strictly), with the tracks' metadata."""
    meta = tracks.select(F.col("trackid").alias("neighbour"), "title", "artist", "bpm", "key")
    return knn(tracks, limit, seeds, threshold=threshold).join(meta, "neighbour")


def neighbors(tracks: DataFrame, k: int = 8, threshold: float = 0.3) -> DataFrame:
    return knn(tracks, k, threshold=threshold)


def _pair_meta(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    a = tracks.select(F.col("trackid").alias("seed"), F.col("bpm").alias("bpm_a"), F.col("key").alias("key_a"))
    b = tracks.select(F.col("trackid").alias("neighbour"), F.col("bpm").alias("bpm_b"), F.col("key").alias("key_b"))
    return pairs.join(a, "seed").join(b, "neighbour")


def _confidence(df: DataFrame, tolerance: float) -> DataFrame:
    bpm = bpm_factor(F.col("bpm_a"), F.col("bpm_b"), tolerance)
    key = harmonic(F.col("key_a"), F.col("key_b"), "searcher")
    return df.withColumn("bpm_factor", bpm).withColumn("key_factor", key).withColumn("bonus", F.when(F.col("key_factor") > 0, 0.05).otherwise(0.0)).withColumn("confidence", F.round(0.7 * F.col("sim") * F.col("bpm_factor") * F.col("key_factor") + F.col("bonus"), 9))


def mix_confidence(tracks: DataFrame, k: int = 100, tolerance: float = 8.0, n: int = 5, vector: str = "embedding", vectors: DataFrame | None = None) -> DataFrame:
    """The ``n`` best to mix with among the ``k`` nearest: similarity by tempo and key factors, and a bonus if both keys are known."""
    pairs = knn(tracks if vectors is None else vectors, k, vector=vector)
    scored = _confidence(_pair_meta(pairs, tracks.select("trackid", "bpm", "key")), tolerance)
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("confidence"), "neighbour")))
    return ranked.where(F.col("place") <= n).select("seed", "neighbour", "sim", "confidence", "place")


def explain_pairs(pairs: DataFrame, tracks: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """The parts of each pair's confidence; ``shown_key_factor`` is on the scale of explanations."""
    scored = _confidence(_pair_meta(pairs, tracks.select("trackid", "bpm", "key")), tolerance)
    return scored.select(
        "seed", "neighbour", "sim", F.round(F.abs(F.col("bpm_a") - F.col("bpm_b")), 6).alias("bpm_diff"), F.round("bpm_factor", 6).alias("bpm_factor"),
        compatible(F.col("key_a"), F.col("key_b")).alias("key_compatible"), "key_factor", harmonic(F.col("key_a"), F.col("key_b"), "explain").alias("shown_key_factor"), "bonus", "confidence",
    )


def mean_vector(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, mean``: the mean of each group's vectors, dimension by dimension."""
    dims = df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))


def pool_frames(frames: DataFrame, group: str = "trackid", vector: str = "v") -> DataFrame:
    """Means and then population deviations of each dimension over a group's frames, one vector."""
    dims = frames.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m", "s")))
    return dims.groupBy(group).agg(ordered.alias("o")).select(group, F.concat(F.transform("o", lambda z: z["m"]), F.transform("o", lambda z: z["s"])).alias("pooled"))


def layout3d(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Three coordinates by principal components of unit vectors; the largest weight of each component is positive."""
    units = unit_vectors(df, vector).withColumn("features", array_to_vector("unit"))
    model = PCA(k=3, inputCol="features", outputCol="out").fit(units)
    pc = model.pc.toArray()
    sign = [1.0 if pc[np.abs(pc[:, i]).argmax(), i] >= 0 else -1.0 for i in range(3)]
    out = model.transform(units).withColumn("o", vector_to_array("out"))
    return out.select("trackid", *((F.col("o")[i] * sign[i]).alias(c) for i, c in enumerate(("x_coord", "y_coord", "z_coord"))))


def layout_coverage(df: DataFrame) -> DataFrame:
    """How many rows have all three coordinates, of how many."""
    placed = F.col("x_coord").isNotNull() & F.col("y_coord").isNotNull() & F.col("z_coord").isNotNull()
    return df.agg(F.count_if(placed).alias("placed"), F.count("*").alias("total"), F.round(F.count_if(placed) / F.count("*"), 6).alias("share"))
