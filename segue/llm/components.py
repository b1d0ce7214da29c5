"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from segue.llm.common import mapped, removed, scratch, scratch_dir, written


def _forest(links: DataFrame, most: int) -> DataFrame:
    """``a, b``: what the links of each task connect, as stars around the least node; at most ``most`` nodes are held at once."""

    def made(source: Iterator[tuple]) -> Iterator[tuple]:
        of: dict[int, int] = {}

        def top(n: int) -> int:
            while (up := of.setdefault(n, n)) != n:
                of[n] = n = of[up]
            return n

        for a, b in source:
            low, high = sorted((top(a), top(b)))
            of[high] = low
            if len(of) >= most:
                yield from [(n, r) for n in list(of) if (r := top(n)) != n]
                of.clear()
        yield from [(n, r) for n in list(of) if (r := top(n)) != n]

    return mapped(links, made, "a long, b long", batch=8192)


def components(links: DataFrame, most: int = 500_000) -> DataFrame:
    """``node, component`` for the end points of ``links (a, b)``: the least node that can be reached.

    Each task first joins its own links, so that chains within a task are stars before anything is shuffled. Each round then takes
    the least label among a node and its neighbours (one shuffle, combined before it) and after it the label's own label; labels are
    written to the shared folder, and the rounds end when none changes (about the logarithm of the longest chain). Links with a null
    end, and links of a node with itself, add nothing. Nothing but counts reaches the driver.
    """
    spark = links.sparkSession
    sound = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    path = scratch_dir(spark)
    with scratch(spark):
        stars = _forest(sound.select("a", "b"), most)
        both = written(stars.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
        labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), path, keep=True)
        while True:
            near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("was"))
            own = labels.select("node", "component", F.col("component").alias("was"))
            stepped = near.unionByName(own).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
            up = labels.select(F.col("node").alias("over"), F.col("component").alias("higher"))
            following = scratch_dir(spark)
            fresh = written(stepped.join(up, stepped["component"] == up["over"]).select("node", "was", F.least("component", "higher").alias("component")), following, keep=True)
            changed = fresh.where(F.col("was") != F.col("component")).limit(1).count()
            removed(spark, path)
            labels, path = fresh.select("node", "component"), following
            if not changed:
                return labels
