"""Paths in graphs of tracks, for many sources and many targets at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from segue.store import scratch, scratch_dir, written


def _key(total: str = "total") -> list:
    return [F.round(-F.col(total), 6).alias("s"), F.col("path")]


def layers(edges: DataFrame, roots: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """``root, node, hop, path, total``: all nodes within ``depth`` steps of each root, once, at their least number of steps.

    ``path`` leads from the root to the node (to the root from the node if not ``forward``); of several paths of one length that with the
    greatest sum of similarities stays, then that with the smallest ids. A node that a root has reached leaves its frontier for good.
    """
    e = edges.select(F.col("seed").alias("a"), F.col("neighbour").alias("b"), "sim") if forward else edges.select(F.col("neighbour").alias("a"), F.col("seed").alias("b"), "sim")
    front = roots.select("root", F.col("root").alias("node"), F.array("root").alias("path"), F.lit(0.0).alias("total"))
    done = [front.withColumn("hop", F.lit(0))]
    for hop in range(1, depth + 1):
        path = F.concat("path", F.array("b")) if forward else F.concat(F.array("b"), "path")
        grown = front.join(e, front["node"] == e["a"]).select("root", F.col("b").alias("node"), path.alias("path"), (F.col("total") + F.col("sim")).alias("total"))
        best = grown.groupBy("root", "node").agg(F.min(F.struct(*_key(), "total")).alias("best"))
        seen = reduce(DataFrame.unionByName, (x.select("root", "node") for x in done))
        front = written(best.join(seen, ["root", "node"], "left_anti").select("root", "node", "best.path", "best.total"))
        done.append(front.withColumn("hop", F.lit(hop)))
    return reduce(DataFrame.unionByName, done)


def pathways(edges: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """``source, target, hops, mean_sim, path``: the best path of each pair that ``hops`` steps join: fewest, then the highest mean similarity, then the smallest ids.

    ``edges`` is ``seed, neighbour, sim``. Half of the steps are taken from the sources and half back from the targets, once for each, however
    many pairs it is in; the halves meet in the middle. A pair of a track with itself has no path.
    """
    path = scratch_dir(edges.sparkSession)
    with scratch(edges.sparkSession):
        e = written(edges.select("seed", "neighbour", "sim"))
        asked = written(pairs.select("source", "target").where("source != target").distinct())
        there = layers(e, asked.select(F.col("source").alias("root")).distinct(), -(-hops // 2))
        back = layers(e, asked.select(F.col("target").alias("root")).distinct(), hops // 2, forward=False)
        near = there.select(F.col("root").alias("source"), "node", F.col("hop").alias("i"), F.col("path").alias("head"), F.col("total").alias("there"))
        far = back.select(F.col("root").alias("target"), "node", F.col("hop").alias("j"), F.col("path").alias("tail"), F.col("total").alias("back"))
        met = asked.join(near, "source").join(far, ["target", "node"]).where("i - j in (0, 1)")  # of all ways to part a path the one in the middle
        whole = met.select("source", "target", (F.col("i") + F.col("j")).alias("hops"), F.concat("head", F.slice("tail", F.lit(2), F.size("tail"))).alias("path"), (F.col("there") + F.col("back")).alias("total"))
        best = whole.groupBy("source", "target").agg(F.min(F.struct("hops", *_key(), "total")).alias("best"))
        told = F.concat_ws(">", F.transform("best.path", lambda x: x.cast("string")))
        return written(best.select("source", "target", F.col("best.hops").alias("hops"), F.round(F.round(F.col("best.total"), 6) / F.col("best.hops"), 9).alias("mean_sim"), told.alias("path")), path, keep=True)


def pathway_data(recommended: DataFrame, tracks: DataFrame, layout: DataFrame) -> DataFrame:
    """``source, target, total, rank, title, artist, x, y, z`` of recommended tracks (``seed, neighbour, total, rank``); those without a place have nulls."""
    rows = recommended.select(F.col("seed").alias("source"), F.col("neighbour").alias("trackid"), "total", "rank")
    told = rows.join(tracks.select("trackid", "title", "artist"), "trackid", "left").join(layout.select("trackid", "x", "y", "z"), "trackid", "left")
    return told.select("source", F.col("trackid").alias("target"), "total", "rank", "title", "artist", "x", "y", "z")
