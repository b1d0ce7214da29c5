"""Label spreading over a graph of nearest neighbours, for many tags at once, until each settles.

The labels of a tag are one for its members, zero for tracks that have other tags only, and unknown for the rest, unless a vote says
otherwise. So nearly all of a tag's labels follow from the track alone, and spreading is linear: what all tagged tracks spread as
zeros is worked out once, and each tag has a correction that starts at its members and votes. Both go on by differences: a round
takes the last change one step along the edges, and rows are only where something changes. Each round's change is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from segue.operators.tags import latest_votes, tag_index
from segue.store import scratch, scratch_dir, written


def seed_labels(labels: DataFrame, votes: DataFrame, tags: DataFrame, tracks: DataFrame) -> DataFrame:
    """``tag, trackid, label`` of each given tag and each tagged or voted track: 1 with the tag, 0 with others only; a vote's sign overrides.

    An absent row is -1, unknown. A vote without a sign lists a track of other tags or none with 0.
    """
    having = tag_index(labels).join(tags, "tag", "left_semi").select("tag", "trackid", F.lit(1).alias("has"))
    voted = latest_votes(votes).join(tags, "tag", "left_semi").select("tag", "trackid", F.when(F.col("weight_delta") > 0, 1).when(F.col("weight_delta") < 0, 0).alias("vote"))
    tagged = labels.where(F.size("semantic_tags") > 0).select("trackid").distinct()
    every = tagged.crossJoin(tags.select("tag").distinct())  # the result has all these rows
    out = every.join(having.join(voted, ["tag", "trackid"], "full"), ["tag", "trackid"], "full").select("tag", "trackid", F.coalesce("vote", "has", F.lit(0)).alias("label"))
    return out.join(tracks.select("trackid"), "trackid", "left_semi").select("tag", "trackid", "label")


def own_labels(labels: DataFrame, votes: DataFrame, tags: DataFrame, tracks: DataFrame) -> DataFrame:
    """``tag, trackid, label`` where it does not follow from the track alone: 1 with the tag, and what the sign of the latest vote says.

    A tagged track that is not listed has 0, any other track is unknown.
    """
    having = tag_index(labels).join(tags, "tag", "left_semi").select("tag", "trackid", F.lit(1).alias("has"))
    voted = latest_votes(votes).join(tags, "tag", "left_semi").where("weight_delta != 0").select("tag", "trackid", F.when(F.col("weight_delta") > 0, 1).otherwise(0).alias("vote"))
    out = having.join(voted, ["tag", "trackid"], "full").select("tag", "trackid", F.coalesce("vote", "has").alias("label"))
    return out.join(tracks.select("trackid"), "trackid", "left_semi").select("tag", "trackid", "label")


def _scaled(edges: DataFrame) -> DataFrame:
    """``seed, neighbour, s``: the numbers of edges that end at both ends scale an edge."""
    degree = edges.groupBy(F.col("neighbour").alias("node")).agg(F.count("*").cast("double").alias("d"))
    a, b = (degree.select(F.col("node").alias(c), F.col("d").alias(f"of_{c}")) for c in ("seed", "neighbour"))
    one = F.lit(1.0)
    return edges.join(a, "seed", "left").join(b, "neighbour", "left").select("seed", "neighbour", (1 / F.sqrt(F.coalesce("of_seed", one) * F.coalesce("of_neighbour", one))).alias("s"))


def label_spread(edges: DataFrame, seeds: DataFrame, tagged: DataFrame, alpha: float = 0.2, rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """``tag, trackid, probability`` of the tracks that a tag reaches, its seeds of label 1 left out; tracks that are not listed have 0.

    ``edges`` is ``seed, neighbour``: the nearest neighbours of each track with a vector, itself not listed; ``seeds`` are those of
    ``own_labels`` and ``tagged`` holds the ``trackid`` of all tracks with tags. A tag stops at the first round whose changes, added up over all
    tracks and both classes, are below ``tolerance``, and after ``rounds`` in any case. Tags without a seed of label 1 among the tracks with vectors are
    left out. Edges that repeat count once.
    """
    path = scratch_dir(edges.sparkSession)
    with scratch(edges.sparkSession):
        n = written(edges.select("seed", "neighbour").where("seed != neighbour").distinct())
        scaled = written(_scaled(n))
        nodes = written(n.select(F.col("seed").alias("node")).distinct())
        zeros = written(nodes.join(tagged.select(F.col("trackid").alias("node")), "node", "left_semi").select("node", F.lit(1.0).alias("g")))
        given = seeds.select("tag", F.col("trackid").alias("node"), "label").join(nodes, "node", "left_semi").join(zeros.select("node", F.lit(True).alias("plain")), "node", "left")
        plain = F.coalesce("plain", F.lit(False))
        start = given.select("tag", "node", F.when(F.col("label") == 1, F.when(plain, -1.0).otherwise(0.0)).otherwise(F.when(plain, 0.0).otherwise(1.0)).alias("c0"), F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("c1")).where("c0 != 0 or c1 != 0")
        chosen = given.where("label = 1").select("tag").distinct()
        none = F.lit(None).cast(start.schema["tag"].dataType)
        # What tagged tracks spread for all tags has no tag here.
        start = written(zeros.select(none.alias("tag"), "node", F.col("g").alias("c0"), F.lit(0.0).alias("c1")).unionByName(start.join(chosen, "tag", "left_semi")))

        def along(c: DataFrame) -> DataFrame:
            moved = scaled.join(c.withColumnRenamed("node", "neighbour"), "neighbour")
            return moved.select("tag", F.col("seed").alias("node"), *((alpha * F.col("s") * F.col(x)).alias(x) for x in ("c0", "c1")))

        c, changes, stops = start, [start.withColumn("t", F.lit(0))], []
        going = start.where("tag is not null").select("tag").distinct()
        for t in range(1, rounds + 1):
            moved = along(c)
            if t == 1:  # the share of a label that a node gives up
                moved = moved.unionByName(start.select("tag", "node", *((-alpha * F.col(x)).alias(x) for x in ("c0", "c1"))))
            c = written(moved.groupBy("tag", "node").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where("c0 != 0 or c1 != 0"))
            changes.append(c.withColumn("t", F.lit(t)))
            g, own, zero = c.where("tag is null").select("node", F.col("c0").alias("g")), c.where("tag is not null"), F.lit(0.0)
            beside = own.join(g, "node", "left").select("tag", (F.abs(F.coalesce("g", zero) + F.col("c0")) - F.abs(F.coalesce("g", zero)) + F.abs("c1")).alias("more"))
            whole = g.agg(F.coalesce(F.sum(F.abs("g")), zero).alias("whole"))
            judged = going.join(beside.groupBy("tag").agg(F.sum("more").alias("more")), "tag", "left").join(F.broadcast(whole))  # one row
            judged = written(judged.select("tag", (F.col("whole") + F.coalesce("more", zero)).alias("change")))
            last = judged if t == rounds else judged.where(F.col("change") < tolerance)
            stops.append(last.select("tag", F.lit(t).alias("t")))
            going = judged.where(F.col("change") >= tolerance).select("tag")
            if going.isEmpty():
                break
            c = c.where("tag is null").unionByName(own.join(going, "tag", "left_semi"))
        every = reduce(DataFrame.unionByName, changes)
        all_g, all_c = every.where("tag is null").select("node", F.col("t").alias("since"), F.col("c0").alias("g")), every.where("tag is not null").select("tag", "node", "c0", "c1")
        stop = written(reduce(DataFrame.unionByName, stops))
        return written(_probabilities(n, nodes, all_g, all_c, stop, seeds), path, keep=True)


def _probabilities(n: DataFrame, nodes: DataFrame, grown: DataFrame, corrections: DataFrame, stop: DataFrame, seeds: DataFrame) -> DataFrame:
    """What the nodes around a track, itself included, say on average of those that say anything."""
    times = stop.select("t").distinct()
    zero = written(grown.join(times, F.col("since") <= F.col("t")).groupBy("node", "t").agg(F.round(F.sum("g"), 12).alias("g")).where("g > 0"))  # a row for each node and round at which a tag stops
    own = corrections.groupBy("tag", "node").agg(F.sum("c0").alias("c0"), F.round(F.sum("c1"), 12).alias("c1")).join(stop, "tag")
    both = own.join(zero, ["node", "t"], "left").select("tag", "node", "t", F.greatest(F.lit(0.0), F.round(F.coalesce("g", F.lit(0.0)) + F.col("c0"), 12)).alias("f0"), F.col("c1").alias("f1"), F.col("g").isNotNull().cast("int").alias("counted"))
    said = F.when(F.col("f0") + F.col("f1") > 0, 1).otherwise(0)
    points = written(both.select("tag", "node", "t", F.when(said == 1, F.col("f1") / (F.col("f0") + F.col("f1"))).otherwise(0.0).alias("p"), (said - F.col("counted")).alias("more")).where("p != 0 or more != 0"))
    around = n.unionByName(nodes.select(F.col("node").alias("seed"), F.col("node").alias("neighbour")))
    votes = around.join(zero.select(F.col("node").alias("neighbour"), "t"), "neighbour").groupBy("seed", "t").agg(F.count("*").alias("votes"))
    found = around.join(points.withColumnRenamed("node", "neighbour"), "neighbour").groupBy("tag", "seed", "t").agg(F.sum("p").alias("p"), F.sum("more").alias("more")).where("p > 0")
    share = F.round(F.col("p") / (F.coalesce("votes", F.lit(0)) + F.col("more")), 6)
    out = found.join(votes, ["seed", "t"], "left").select("tag", F.col("seed").alias("trackid"), share.alias("probability"))
    return out.where("probability > 0").join(seeds.where("label = 1").select("tag", "trackid"), ["tag", "trackid"], "left_anti")
