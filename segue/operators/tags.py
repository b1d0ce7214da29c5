"""Tags: counts, suggestions, votes, centroids, quality and label spreading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from segue.functions.scores import dot, norm, unit
from segue.operators.tables import latest
from segue.operators.vectors import all_cosines, mean_vector, nearest, unit_vectors


def long_tags(labels: DataFrame, column: str = "semantic_tags") -> DataFrame:
    return labels.select("trackid", F.explode(column).alias("tag"))


def vocabulary(labels: DataFrame, column: str = "semantic_tags") -> DataFrame:
    return long_tags(labels, column).select("tag").distinct().orderBy("tag")


def tag_statistics(labels: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent tags, and how many there are in all."""
    counts = long_tags(labels).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.count("*").alias("distinct_tags")))).orderBy(F.desc("n"), "tag").limit(n)


def tag_index(labels: DataFrame) -> DataFrame:
    """``tag, trackid``: the inverted index in long form, a tag once per track."""
    return long_tags(labels).select("tag", "trackid").distinct()


def progress(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    done = labels.where(F.size("semantic_tags") > 0).select("trackid").distinct().withColumn("done", F.lit(1))
    return tracks.join(done, "trackid", "left").agg(F.count("done").alias("labelled"), F.count("*").alias("total"), F.round(F.count("done") / F.count("*"), 6).alias("share"))


def suggest(knn: DataFrame, labels: DataFrame, column: str = "semantic_tags", least: float = 0.5) -> DataFrame:
    """Tags of a track's neighbours by summed similarity above ``least``; confidence is a quarter of it, .99 at most.

    Nothing is suggested where the similarities of neighbours with tags or vibes sum up to 0.
    """
    known = labels.where((F.size("semantic_tags") > 0) | (F.size("vibe") > 0)).withColumnRenamed("trackid", "neighbour")
    joined = knn.join(known, "neighbour")
    sound = joined.groupBy("seed").agg(F.round(F.sum("sim"), 6).alias("total")).where("total != 0").select("seed")
    sums = joined.select("seed", "sim", F.explode(column).alias("tag")).groupBy("seed", "tag").agg(F.round(F.sum("sim"), 6).alias("weight"))
    return sums.where(F.col("weight") > least).join(sound, "seed", "left_semi").withColumn("confidence", F.round(F.least(F.lit(0.99), F.col("weight") / 4), 9))


def predict_energy(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """Similarity-weighted mean energy of the neighbours that have one.

    Null if the similarities of these sum to 0 or less, or those of the neighbours with tags or vibes to 0.
    """
    known = labels.select(F.col("trackid").alias("neighbour"), "energy", (F.coalesce(F.size("semantic_tags") > 0, F.lit(False)) | F.coalesce(F.size("vibe") > 0, F.lit(False))).alias("tagged"))
    sums = knn.join(known, "neighbour").groupBy("seed").agg(F.round(F.sum(F.when(F.col("tagged"), F.col("sim"))), 6).alias("any"), F.sum(F.when(F.col("energy").isNotNull(), F.col("energy") * F.col("sim"))).alias("e"), F.sum(F.when(F.col("energy").isNotNull(), F.col("sim"))).alias("w"))
    return sums.select("seed", F.when((F.col("any") != 0) & (F.round("w", 6) > 0), F.round(F.col("e") / F.col("w"), 5)).alias("energy"))


def latest_votes(votes: DataFrame) -> DataFrame:
    return latest(votes, ["trackid", "tag"], [F.desc("ts"), F.desc("event_id")])


def vote_summary(votes: DataFrame) -> DataFrame:
    """Up, down and active votes of each tag, the latest of each track counting."""
    return latest_votes(votes).groupBy("tag").agg(F.count_if(F.col("weight_delta") > 0).alias("up"), F.count_if(F.col("weight_delta") < 0).alias("down"), F.count_if(F.col("weight_delta") != 0).alias("active"))


def vote_weight(votes: DataFrame) -> DataFrame:
    return latest_votes(votes).select("trackid", "tag", F.greatest(F.lit(0.0), 1 + F.col("weight_delta")).alias("weight"))


def merge_tags(labels: DataFrame, sources: list[str], target: str) -> DataFrame:
    """Sources replaced by the target, and whether a row changed; the target is added before the sources go."""
    src = F.array(*map(F.lit, sources))
    hit = F.coalesce(F.arrays_overlap("semantic_tags", src), F.lit(False))
    merged = F.array_except(F.array_union("semantic_tags", F.array(F.lit(target))), src)
    return labels.withColumn("affected", hit).withColumn("semantic_tags", F.when(hit, merged).otherwise(F.col("semantic_tags")))


def promote_votes(labels: DataFrame, votes: DataFrame, least: float = 2.0) -> DataFrame:
    """Tags of the strongest votes added to the label rows that exist."""
    strong = latest_votes(votes).where(F.col("weight_delta") >= least).groupBy("trackid").agg(F.collect_set("tag").alias("voted"))
    none = F.array().cast("array<string>")
    return labels.join(strong, "trackid", "left").withColumn("semantic_tags", F.when(F.col("voted").isNotNull(), F.array_union(F.coalesce("semantic_tags", none), "voted")).otherwise(F.col("semantic_tags"))).drop("voted")


def members(labels: DataFrame, vectors: DataFrame, vector: str = "feat") -> DataFrame:
    """``tag, trackid, raw, unit``: each tag's members with a usable vector."""
    return tag_index(labels).join(unit_vectors(vectors, vector, raw=True).hint("merge"), "trackid")


def unit_sums(of: DataFrame) -> DataFrame:
    """``tag, n, total, square``: the number of members, the sum of their unit vectors and its squared length."""
    sizes = of.groupBy("tag").agg(F.count("*").alias("n"))
    return mean_vector(of, "tag", "unit").join(sizes, "tag").select("tag", "n", F.transform("mean", lambda x: x * F.col("n")).alias("total")).withColumn("square", dot(F.col("total"), F.col("total")))


def centroid_mean(of: DataFrame) -> DataFrame:
    return mean_vector(of, "tag", "raw").select("tag", unit(F.col("mean")).alias("centroid"))


def centroid_medoid(of: DataFrame) -> DataFrame:
    """The member nearest to the others on average, found from the sum of unit vectors in one pass."""
    near = of.join(unit_sums(of).select("tag", "n", "total"), "tag").withColumn("near", F.when(F.col("n") > 1, F.round((dot(F.col("unit"), F.col("total")) - 1) / (F.col("n") - 1), 6)).otherwise(1.0))
    return latest(near, ["tag"], [F.desc("near"), F.col("trackid")]).select("tag", "trackid", "near", F.col("raw").alias("centroid"))


def centroid_density(of: DataFrame, sigma: float = 0.1, block: int = 2048) -> DataFrame:
    """Members weighted by how many others are near.

    The members of a tag are dealt into blocks; each pair of blocks is a matrix product in one task, out of which only a sum
    per member comes.
    """
    a = of.select("tag", "trackid", "raw", "unit")
    sizes = of.groupBy("tag").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    numbered = a.join(sizes, "tag").withColumn("mine", F.pmod(F.xxhash64("trackid"), F.col("n")).cast("int"))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    lent = numbered.select("tag", F.explode(every).alias("a"), F.col("mine").alias("b"), F.lit(False).alias("asks"), "trackid", "unit")
    asking = numbered.select("tag", F.col("mine").alias("a"), F.explode(every).alias("b"), F.lit(True).alias("asks"), "trackid", "unit")
    dealt = lent.unionByName(asking).repartition("tag", "a", "b").sortWithinPartitions("tag", "a", "b", "asks", "trackid")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, vectors, matrix = None, [], None
        for batch in batches:
            out = []
            for *at, asks, trackid, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != place:
                    place, vectors, matrix = at, [], None
                if not asks:
                    vectors.append(v)
                elif vectors:
                    matrix = np.array(vectors) if matrix is None else matrix
                    out.append((at[0], trackid, float(np.exp(-(1 - matrix @ np.array(v)) / (2 * sigma**2)).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["tag", "trackid", "w"])

    weights = dealt.mapInArrow(summed, "tag string, trackid long, w double").groupBy("tag", "trackid").agg(F.sum("w").alias("w"))
    dims = a.join(weights, ["tag", "trackid"]).select("tag", "w", F.posexplode("raw").alias("dim", "x")).groupBy("tag", "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return dims.groupBy("tag").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])).alias("centroid"))


def _linkage_chain(u: np.ndarray, clusters: int) -> list[list[int]]:
    """Clusters by average linkage, along chains of nearest neighbours, from sums of unit vectors: no table of pairs is held. Of equally near ones the first counts."""
    n = len(u)
    sums, size, gone = u.astype(float), np.ones(n), np.zeros(n)
    chain: list[int] = []
    merges = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(gone == 0)[0]))
        i = chain[-1]
        near = (sums @ sums[i]) / (size * size[i]) + gone
        near[i] = -np.inf
        j = int(near.argmax())
        if len(chain) < 2 or near[chain[-2]] < near[j] - 1e-12:
            chain.append(j)
            continue
        j = chain[-2]
        del chain[-2:]
        a, b = min(i, j), max(i, j)
        sums[a] += sums[b]
        size[a] += size[b]
        gone[b] = -np.inf
        merges.append((float(near[j]), a, b))
    of = list(range(n))

    def top(x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for _, a, b in sorted(merges, key=lambda m: -m[0])[: n - clusters]:
        a, b = sorted((top(a), top(b)))
        of[b] = a
    groups: dict[int, list[int]] = {}
    for x in range(n):
        groups.setdefault(top(x), []).append(x)
    return list(groups.values())


def centroid_multi(of: DataFrame, clusters: int = 3) -> DataFrame:
    """Up to three medoids a tag, one per average-linkage cluster: one below four members, else at most half as many as members.

    One rule holds at every size. A tag is one task, whose memory grows with its members and whose time with their square.
    """

    def medoids(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("trackid").reset_index(drop=True)
        u = np.stack(g["unit"])
        n = min(clusters, len(g) // 2)
        groups = [list(range(len(g)))] if len(g) < 4 else _linkage_chain(u, n)
        near = {i: round(float(x), 6) for c in groups for i, x in zip(c, u[c] @ u[c].mean(axis=0), strict=True)}
        picked = [min(c, key=lambda i: (-near[i], g["trackid"][i])) for c in groups]
        return pd.DataFrame({"tag": g["tag"][0], "trackid": g["trackid"][picked], "centroid": [list(map(float, g["raw"][i])) for i in picked]})

    return of.select("tag", "trackid", "raw", "unit").groupBy("tag").applyInPandas(medoids, "tag string, trackid long, centroid array<double>")


def intra_similarity(of: DataFrame) -> DataFrame:
    """Mean cosine between different members, from the sum of unit vectors; null for a single one."""
    return unit_sums(of).select("tag", "n", F.when(F.col("n") > 1, F.round((F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6)).alias("intra"))


def routes(of: DataFrame, gate: float = 0.7) -> DataFrame:
    """Which centroid a tag gets, by its number of members and, for 16 to 30, its mean cosine (each with itself included)."""
    n, tight = F.col("n"), F.col("square") / (F.col("n") * F.col("n")) >= gate
    route = F.when(n == 1, "single").when(n <= 5, "voting").when(n <= 15, "medoid").when(n <= 30, F.when(tight, "density").otherwise("multi")).otherwise("mean")
    return unit_sums(of).select("tag", "n", route.alias("route"))


def adaptive_centroids(of: DataFrame, gate: float = 0.7) -> DataFrame:
    """``tag, route, centroid``; a voting tag's proxy is its medoid, and a multi-modal tag has up to three rows."""
    chosen = routes(of, gate)
    part = lambda *names: of.join(chosen.where(F.col("route").isin(*names)).select("tag"), "tag", "left_semi")
    raw = lambda df: df.select("tag", F.transform("centroid", lambda x: x.cast("double")).alias("centroid"))
    found = raw(centroid_medoid(part("single", "voting", "medoid"))).unionByName(raw(centroid_density(part("density")))).unionByName(raw(centroid_multi(part("multi")))).unionByName(raw(centroid_mean(part("mean"))))
    return found.join(chosen.select("tag", "route"), "tag")


def rank_for_tags(vectors: DataFrame, centroids: DataFrame, n: int = 10, vector: str = "feat") -> DataFrame:
    """The tracks nearest to each tag: the best cosine with any of its centroids.

    Each centroid asks for as many tracks as may be nearest to another of its tag first; centroids and tracks meet in blocks.
    """
    units = unit_vectors(vectors, vector).select(F.col("trackid").alias("neighbour"), "unit")
    reps = centroids.select("tag", unit(F.col("centroid")).alias("unit")).withColumn("seed", F.xxhash64("tag", "unit"))
    best = nearest(reps.select("seed", "unit"), units, n, same=True).join(reps.select("seed", "tag").distinct(), "seed").groupBy("tag", F.col("neighbour").alias("trackid")).agg(F.max("sim").alias("sim"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("sim"), "trackid")))
    return ranked.where(F.col("rank") <= n)


def rank_nn_voting(of: DataFrame, vectors: DataFrame, vector: str = "feat") -> DataFrame:
    """Mean cosine of every track with a tag's members, from the mean of their unit vectors."""
    means = mean_vector(of, "tag", "unit")
    units = unit_vectors(vectors, vector).select(F.col("trackid").alias("seed"), "unit")
    return all_cosines(units, means.select(F.col("tag").alias("neighbour"), F.col("mean").alias("unit"))).select(F.col("neighbour").alias("tag"), F.col("seed").alias("trackid"), "sim")


def misfits(of: DataFrame, centroids: DataFrame) -> DataFrame:
    """Members that are nearer to another tag's centroid than to their own, by margin.

    The two centroids nearest to a track are enough: one of them is another tag's, and the nearest such.
    """
    c = centroids.select(F.col("tag").alias("other"), unit(F.col("centroid")).alias("c"))
    own = of.join(c.withColumnRenamed("other", "tag"), "tag").select("tag", "trackid", F.round(dot(F.col("unit"), F.col("c")), 6).alias("own_sim"))
    units = of.select(F.col("trackid").alias("seed"), "unit").dropDuplicates(["seed"])
    near = nearest(units, c.select(F.col("other").alias("neighbour"), F.col("c").alias("unit")), 2, same=True).select(F.col("seed").alias("trackid"), F.col("neighbour").alias("other"), "sim")
    pairs = own.join(near.hint("merge"), "trackid").where((F.col("other") != F.col("tag")) & (F.col("sim") > F.col("own_sim")))
    return latest(pairs, ["tag", "trackid"], [F.desc("sim"), F.col("other")]).withColumn("margin", F.round(F.col("sim") - F.col("own_sim"), 6))


def tag_quality(of: DataFrame, centroids: DataFrame, drop_below: float = 0.5, merge_from: float = 0.85) -> DataFrame:
    """``drop``, ``merge`` or ``keep`` for each tag, by its own similarity and the nearest other tag's; ``top_similar`` are all that are nearest, if near enough to merge."""
    c = centroids.select("tag", unit(F.col("centroid")).alias("unit"))
    near = nearest(c.select(F.col("tag").alias("seed"), "unit"), c.select(F.col("tag").alias("neighbour"), "unit"), 1, ties=True)
    best = near.groupBy(F.col("seed").alias("tag")).agg(F.max("sim").alias("inter"), F.array_sort(F.collect_list("neighbour")).alias("all"))
    similar = F.when(F.col("inter") >= merge_from, F.array_join("all", ", ")).otherwise("")
    action = F.when((F.col("n") < 2) | F.col("intra").isNull(), "keep").when(F.col("intra") < drop_below, "drop").when(F.col("inter") >= merge_from, "merge").otherwise("keep")
    return intra_similarity(of).join(best, "tag", "left").select("tag", "n", "intra", F.get("all", F.lit(0)).alias("nearest"), "inter", F.coalesce(similar, F.lit("")).alias("top_similar"), action.alias("action"))


def triage(predicted: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` to accept (above .85) and of the uncertain (.4 to .6), per tag."""
    bucket = F.when(F.col("probability") > 0.85, "accept").when((F.col("probability") > 0.4) & (F.col("probability") < 0.6), "uncertain")
    sorted_ = predicted.withColumn("bucket", bucket).where("bucket is not null")
    return sorted_.withColumn("place", F.row_number().over(Window.partitionBy("tag", "bucket").orderBy(F.desc("probability"), "trackid"))).where(F.col("place") <= n)
