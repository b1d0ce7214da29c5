"""Queries about vectors, scores, tags, sequences, requests, measures and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from segue.functions import scores
from segue.functions.keys import harmonic
from segue.operators import edits, evaluation, graphs, hybrid, requests as req, scoring, search, sequences, spreading, tables, tags, vectors
from segue.operators.scoring import latest_n
from segue.plans.base import Tables, harmonic_sql, knn_sql, query
from segue.store import scratch, written

BPM = "CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = 0 OR {b} = 0 THEN 1 ELSE greatest(0, 1 - abs({a} - {b}) / 8) END"
CONFIDENCE = f"""SELECT n.*, a.bpm AS bpm_a, b.bpm AS bpm_b, a.key AS key_a, b.key AS key_b, {BPM.format(a='a.bpm', b='b.bpm')} AS bpm_factor, {harmonic_sql('a.key', 'b.key', 'searcher')} AS key_factor,
  CASE WHEN {harmonic_sql('a.key', 'b.key', 'searcher')} > 0 THEN 0.05::DOUBLE ELSE 0 END AS bonus,
  round(0.7::DOUBLE * sim * bpm_factor * key_factor + bonus, 9) AS confidence FROM n JOIN tracks a ON a.trackid = n.seed JOIN tracks b ON b.trackid = n.neighbour"""


def feat_knn(t: Tables, k: int, threshold: float | None = None) -> DataFrame:
    return vectors.knn(t.feat, k, vector="feat", threshold=threshold)


@query("v1_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(nxt, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query("v2_unit_vectors", "SELECT trackid, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, round(unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS x FROM tracks WHERE embedding IS NOT NULL")
def _(t):
    return vectors.unit_vectors(t.tracks).select("trackid", F.posexplode("unit").alias("dim", "x")).withColumn("x", F.round("x", 5))


@query("v3_knn", f"WITH n AS ({knn_sql(10, 'embedding', 'tracks')}) SELECT seed, neighbour, sim, rank FROM n")
def _(t):
    return vectors.knn(t.tracks, 10)


@query("v4_vector_search", f"WITH n AS ({knn_sql(12, 'embedding', 'tracks', 0.3)}) SELECT seed, neighbour, sim, rank, title, artist, bpm, key FROM n JOIN tracks t ON t.trackid = n.neighbour")
def _(t):
    return vectors.vector_search(t.tracks, t.tracks, 12, 0.3)


@query("v5_neighbors", f"WITH n AS ({knn_sql(8, threshold=0.3)}) SELECT seed, neighbour, sim, rank FROM n")
def _(t):
    return feat_knn(t, 8, 0.3)


@query("v7_find_similar", f"WITH n AS ({knn_sql(7, 'embedding', 'tracks', 0.2)}) SELECT seed, neighbour, sim, rank FROM n")
def _(t):
    return vectors.knn(t.tracks, 7, threshold=0.2)


@query("v8_mix_confidence", f"WITH n AS ({knn_sql(100)}), c AS ({CONFIDENCE}) SELECT seed, neighbour, sim, confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, neighbour) AS place FROM c) WHERE place <= 5")
def _(t):
    return vectors.mix_confidence(t.tracks, vector="feat", vectors=t.feat)


@query("v9_explain_pairs", f"WITH n AS ({knn_sql(5)}), c AS ({CONFIDENCE}) SELECT seed, neighbour, sim, round(abs(bpm_a - bpm_b), 6) AS bpm_diff, round(bpm_factor, 6) AS bpm_factor, {harmonic_sql('key_a', 'key_b', 'explain')} >= 0.8 AS key_compatible, key_factor, {harmonic_sql('key_a', 'key_b', 'explain')} AS shown_key_factor, bonus, confidence FROM c")
def _(t):
    return vectors.explain_pairs(feat_knn(t, 5), t.tracks)


@query("v11_pool_frames", "WITH d AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s, max(i) OVER () AS width FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS INTEGER) AS dim, round(m, 5) AS x FROM d UNION ALL SELECT label, i - 1 + width, round(s, 5) FROM d")
def _(t):
    p = vectors.pool_frames(t.embeddings.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")), "label")
    return p.select(F.col("label").cast("long").alias("label"), F.posexplode("pooled").alias("dim", "x")).withColumn("x", F.round("x", 5))


@query("v12_layout3d")
def _(t):
    return vectors.layout3d(t.tracks)


@query("v13_layout_coverage", "SELECT count(embedding) AS placed, count(*) AS total, round(count(embedding) / count(*), 6) AS share FROM tracks")
def _(t):
    e = F.col("embedding")
    return vectors.layout_coverage(t.tracks.select(F.get(e, F.lit(0)).alias("x_coord"), F.get(e, F.lit(1)).alias("y_coord"), F.get(e, F.lit(2)).alias("z_coord")))


SEMANTIC = "SELECT c.session_id AS seed, c.trackid, max(round(least(1, 0.4::DOUBLE * coalesce(len(list_intersect(b.semantic_tags, a.semantic_tags)), 0) / len(a.semantic_tags) + 0.3::DOUBLE * len(list_intersect(b.vibe, a.vibe)) / len(a.vibe) + 0.3::DOUBLE * coalesce(greatest(0, 1 - 2 * abs(b.energy / 10 - a.energy / 10)), 0)), 6)) AS semantic FROM crates c JOIN track_labels b ON b.trackid = c.trackid JOIN crates f ON f.session_id = c.session_id AND f.position = 0 JOIN track_labels a ON a.trackid = f.trackid WHERE len(a.semantic_tags) > 0 GROUP BY ALL"


def session_semantic(t: Tables) -> DataFrame:
    """The semantic score of each track of a session for the session's first track, ``seed`` being the session."""
    a = t.crates.where("position = 0").join(t.track_labels, "trackid").select("session_id", *(F.col(c).alias(f"{c}_a") for c in ("semantic_tags", "vibe", "energy"))).where(F.size("semantic_tags_a") > 0)
    b = t.crates.join(t.track_labels, "trackid").join(a, "session_id")
    e = F.col("energy_a") / 10
    s = scores.semantic_score(F.col("semantic_tags"), F.col("vibe"), F.col("energy") / 10, F.col("semantic_tags_a"), F.col("vibe_a"), e, e)
    return b.groupBy(F.col("session_id").alias("seed"), "trackid").agg(F.max(F.round(s, 6)).alias("semantic"))


@query("r3_semantic_score", f"WITH s AS ({SEMANTIC}) SELECT seed, trackid, semantic FROM s")
def _(t):
    return session_semantic(t)


def wishes(t: Tables) -> DataFrame:
    """What is like each track: its vector, tags and vibes, and energies near its own for every other one; some ask for labels or for a vector alone."""
    i, e = F.col("trackid"), F.col("energy") / 10
    own = t.tracks.select("trackid").join(t.feat.hint("merge"), "trackid", "left").join(t.track_labels.hint("merge"), "trackid", "left")
    return own.select(i.alias("request_id"), F.when(i % 7 != 3, F.col("feat")).alias("vector"), F.when(i % 7 != 5, F.col("semantic_tags")).alias("tags"), F.when((i % 7 != 5) & (i % 3 != 0), F.col("vibe")).alias("vibes"), F.when((i % 2 == 0) & (i % 7 != 5), e - 0.2).alias("energy_low"), F.when((i % 2 == 0) & (i % 7 != 5), e + 0.2).alias("energy_high"))


@query("v6_hybrid_search", """WITH o AS (SELECT t.trackid, feat, l.trackid IS NOT NULL AS labelled, coalesce(semantic_tags, []) AS tags, coalesce(vibe, []) AS vibes, energy / 10 AS energy FROM tracks t LEFT JOIN feat f USING (trackid) LEFT JOIN track_labels l ON l.trackid = t.trackid),
  w AS (SELECT trackid AS request_id, CASE WHEN trackid % 7 <> 3 THEN feat END AS vector, CASE WHEN trackid % 7 <> 5 THEN tags ELSE [] END AS wt, CASE WHEN trackid % 7 <> 5 AND trackid % 3 <> 0 THEN vibes ELSE [] END AS wv, CASE WHEN trackid % 2 = 0 AND trackid % 7 <> 5 THEN energy - 0.2::DOUBLE END AS lo, CASE WHEN trackid % 2 = 0 AND trackid % 7 <> 5 THEN energy + 0.2::DOUBLE END AS hi FROM o),
  s AS (SELECT a.trackid AS request_id, b.trackid, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM (SELECT trackid, CAST(feat AS DOUBLE[]) AS v FROM feat WHERE trackid % 7 <> 3) a CROSS JOIN (SELECT trackid, CAST(feat AS DOUBLE[]) AS v FROM feat) b),
  p AS (SELECT request_id, trackid, coalesce(s.sim, 0) AS sim,
      labelled AND (len(wt) > 0 OR len(wv) > 0 OR lo IS NOT NULL) AND (len(wt) = 0 OR list_has_any(wt, tags)) AND (len(wv) = 0 OR list_has_any(wv, vibes)) AND (lo IS NULL OR coalesce(energy BETWEEN lo AND hi, false)) AS sem,
      round(least(1, CASE WHEN len(wt) > 0 THEN 0.4::DOUBLE * (len(list_intersect(wt, tags)) / len(wt)) ELSE 0 END + CASE WHEN len(wv) > 0 THEN 0.3::DOUBLE * (len(list_intersect(wv, vibes)) / len(wv)) ELSE 0 END + CASE WHEN lo IS NOT NULL THEN 0.3::DOUBLE * coalesce(greatest(0, 1 - 2 * abs(energy - (lo + hi) / 2)), 0) ELSE 0 END), 6) AS semantic FROM w JOIN o ON request_id <> o.trackid LEFT JOIN s USING (request_id, trackid)),
  u AS (SELECT request_id, trackid, round(CASE WHEN sim > 0.5 THEN 0.6::DOUBLE * sim ELSE 0 END + CASE WHEN sem THEN 0.4::DOUBLE * semantic ELSE 0 END, 6) AS score, CASE WHEN sim > 0.5 AND sem THEN 'hybrid' WHEN sim > 0.5 THEN 'embedding' ELSE 'semantic' END AS match_type FROM p WHERE sim > 0.5 OR sem)
  SELECT request_id, trackid, score, match_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, trackid) AS rank FROM u) WHERE rank <= 20""")
def _(t):
    return hybrid.hybrid_search(wishes(t), t.tracks, t.track_labels, t.feat, 20)


def candidates(t: Tables, k: int = 20) -> DataFrame:
    """Neighbours with both sides' metadata and a direction by the seed, for the scoring queries."""
    meta = tables.with_labels(t.tracks.select("trackid", "bpm", "key", "artist"), t.track_labels)
    a = meta.select(F.col("trackid").alias("seed"), *(F.col(c).alias(f"{n}_a") for c, n in (("bpm", "bpm"), ("key", "key"), ("energy", "energy"), ("semantic_tags", "tags"), ("vibe", "vibe"))))
    b = meta.select(F.col("trackid").alias("neighbour"), F.col("artist"), *(F.col(c).alias(f"{n}_b") for c, n in (("bpm", "bpm"), ("key", "key"), ("energy", "energy"), ("semantic_tags", "tags"), ("vibe", "vibe"))))
    plays = t.votes.groupBy(F.col("trackid").alias("neighbour")).agg(F.max("ts").alias("last_play"))
    as_of = t.votes.agg(F.max("ts").alias("as_of"))
    ways = F.array(*map(F.lit, ("build", "breakdown", "maintain", "bridge", "sideways")), F.lit(None))
    joined = feat_knn(t, k).drop("rank").join(a, "seed").join(b, "neighbour").join(plays, "neighbour", "left").join(F.broadcast(as_of))  # one row
    return joined.withColumn("direction", F.get(ways, (F.col("seed") % 6).cast("int")))


def overlap_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {b} IS NULL OR len({b}) = 0 THEN 0.5::DOUBLE ELSE coalesce(len(list_intersect({a}, {b})) / len({b}), 0)::DOUBLE END)"


FLOW = "(CASE way WHEN 'build' THEN CASE WHEN d BETWEEN 0.1::DOUBLE AND 0.3::DOUBLE THEN 1 WHEN d > 0 THEN 0.7 ELSE 0.2 END WHEN 'breakdown' THEN CASE WHEN d BETWEEN -0.4::DOUBLE AND -0.1::DOUBLE THEN 1 WHEN d < 0 THEN 0.7 ELSE 0.2 END WHEN 'maintain' THEN CASE WHEN abs(d) <= 0.15::DOUBLE THEN 1 ELSE greatest(0.1::DOUBLE, 1 - 2 * abs(d)) END WHEN 'bridge' THEN CASE WHEN abs(d) <= 0.2::DOUBLE THEN 0.8 ELSE 0.5 END ELSE 0.5 END)::DOUBLE"
FACTORS = f"""p AS (SELECT trackid AS neighbour, max(ts) AS last_play FROM votes GROUP BY trackid), o AS (SELECT max(ts) AS as_of FROM votes),
  m AS (SELECT t.trackid, bpm, key, artist, energy, semantic_tags, vibe FROM tracks t LEFT JOIN track_labels l USING (trackid)),
  f AS (SELECT seed, neighbour, sim AS embedding, b.artist, {overlap_sql('b.semantic_tags', 'a.semantic_tags')} AS semantic, {overlap_sql('b.vibe', 'a.vibe')} AS vibe,
    (CASE WHEN b.bpm IS NULL THEN 0.5 WHEN a.bpm IS NOT NULL THEN greatest(0, 1 - abs(b.bpm - a.bpm) / 20) ELSE 0.5 END)::DOUBLE AS bpm, {harmonic_sql('a.key', 'b.key')} AS harmonic,
    round(coalesce(b.energy / 10, 0.5) - coalesce(a.energy / 10, 0.5), 6)::DOUBLE AS d, coalesce((['build', 'breakdown', 'maintain', 'bridge', 'sideways', NULL])[1 + seed % 6], 'maintain') AS way, {FLOW} AS energy,
    (CASE WHEN last_play IS NULL THEN 1 ELSE least(1, (epoch_us(as_of) - epoch_us(last_play)) / 3600000000 / 24) END)::DOUBLE AS freshness,
    a.bpm AS bpm_a, b.bpm AS bpm_b, a.energy AS energy_a, b.energy AS energy_b, a.semantic_tags AS tags_a, b.semantic_tags AS tags_b, a.vibe AS vibe_a, b.vibe AS vibe_b
    FROM n JOIN m a ON a.trackid = n.seed JOIN m b ON b.trackid = n.neighbour LEFT JOIN p USING (neighbour) CROSS JOIN o),
  r AS (SELECT *, round(embedding * 0.25::DOUBLE + semantic * 0.2::DOUBLE + vibe * 0.15::DOUBLE + bpm * 0.15::DOUBLE + harmonic * 0.15::DOUBLE + energy * 0.1::DOUBLE + freshness * 0.05::DOUBLE, 9) AS total FROM f)"""
ROUNDED = "round(semantic, 6) AS semantic, round(vibe, 6) AS vibe, round(bpm, 6) AS bpm, harmonic, round(energy, 6) AS energy, round(freshness, 6) AS freshness"


@query("r1_recommend", f"WITH n AS ({knn_sql(20)}), {FACTORS} SELECT seed, neighbour, embedding, {ROUNDED}, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY total DESC, neighbour) AS rank FROM r) WHERE rank <= 10")
def _(t):
    out = scoring.recommend(candidates(t), n=10)
    return out.select("seed", "neighbour", "embedding", *(F.round(c, 6).alias(c) for c in ("semantic", "vibe", "bpm")), "harmonic", F.round("energy", 6).alias("energy"), F.round("freshness", 6).alias("freshness"), "total", "rank")


@query("r4_energy_flow", f"WITH n AS ({knn_sql(20)}), {FACTORS} SELECT seed, neighbour, round(energy, 6) AS flow FROM f")
def _(t):
    c = candidates(t)
    return c.select("seed", "neighbour", F.round(scores.energy_flow(F.col("energy_b") / 10, F.col("energy_a") / 10, F.col("direction")), 6).alias("flow"))


@query("r5_harmonic", "SELECT seed, neighbour, e, r, s, x FROM (SELECT a.trackid AS seed, b.trackid AS neighbour, " + ", ".join(f"{harmonic_sql('a.key', 'b.key', p)} AS {c}" for p, c in (("engine", "e"), ("readme", "r"), ("searcher", "s"), ("explain", "x"))) + " FROM tracks a JOIN tracks b ON b.trackid BETWEEN a.trackid + 1 AND a.trackid + 3)")
def _(t):
    a = t.tracks.select(F.col("trackid").alias("seed"), F.col("key").alias("a"))
    b = t.tracks.select(F.explode(F.array(*(F.col("trackid") - i for i in (1, 2, 3)))).alias("seed"), F.col("trackid").alias("neighbour"), F.col("key").alias("b"))
    return a.join(b, "seed").select("seed", "neighbour", *(harmonic(F.col("a"), F.col("b"), p).alias(c) for p, c in (("engine", "e"), ("readme", "r"), ("searcher", "s"), ("explain", "x"))))


@query("r6_bpm_compat", "SELECT trackid, round((CASE WHEN bpm IS NULL THEN 0.5 WHEN trackid % 2 = 0 THEN greatest(0, 1 - greatest(110 - bpm, bpm - 125, 0) / 10) WHEN trackid % 3 = 0 THEN greatest(0, 1 - abs(bpm - 120) / 20) ELSE 0.5 END)::DOUBLE, 6) AS compat FROM tracks")
def _(t):
    even = F.col("trackid") % 2 == 0
    return t.tracks.select("trackid", F.round(scores.bpm_compat(F.col("bpm"), F.when(even, 110.0), F.when(even, 125.0), F.when(F.col("trackid") % 3 == 0, 120.0)), 6).alias("compat"))


@query("r7_overlap", f"WITH n AS ({knn_sql(10)}), {FACTORS} SELECT seed, neighbour, round(semantic, 6) AS semantic, round(vibe, 6) AS vibe FROM f")
def _(t):
    c = candidates(t, 10)
    return c.select("seed", "neighbour", F.round(scores.overlap(F.col("tags_b"), F.col("tags_a")), 6).alias("semantic"), F.round(scores.overlap(F.col("vibe_b"), F.col("vibe_a")), 6).alias("vibe"))


@query("r8_freshness", "WITH p AS (SELECT trackid, max(ts) AS last_play FROM votes GROUP BY trackid) SELECT t.trackid, round((CASE WHEN last_play IS NULL THEN 1 ELSE least(1, (epoch_us((SELECT max(ts) FROM votes)) - epoch_us(last_play)) / 3600000000 / 24) END)::DOUBLE, 6) AS freshness FROM tracks t LEFT JOIN p USING (trackid)")
def _(t):
    plays = t.votes.groupBy("trackid").agg(F.max("ts").alias("last_play"))
    return t.tracks.join(plays, "trackid", "left").join(F.broadcast(t.votes.agg(F.max("ts").alias("as_of")))).select("trackid", F.round(scores.freshness(F.col("last_play"), F.col("as_of")), 6).alias("freshness"))


@query("r9_diversify", f"WITH n AS ({knn_sql(20)}), {FACTORS}, g AS (SELECT *, row_number() OVER (PARTITION BY seed, coalesce(artist, 'track ' || neighbour) ORDER BY total DESC, neighbour) AS place FROM r) SELECT seed, neighbour, total, place, round(total * pow(0.8::DOUBLE, place - 1), 9) AS diverse FROM g")
def _(t):
    c = candidates(t)
    scored = scoring.recommend(c, n=20).join(c.select("seed", "neighbour", "artist"), ["seed", "neighbour"])
    return scoring.diversify(scored).select("seed", "neighbour", "total", "place", "diverse")


@query("r10_reasons", f"WITH n AS ({knn_sql(20)}), {FACTORS}, x AS (SELECT seed, neighbour, unnest(['embedding', 'semantic', 'vibe', 'bpm', 'harmonic', 'energy', 'freshness']) AS c, unnest([embedding, semantic, vibe, bpm, harmonic, energy, freshness]) AS s, unnest([0.25, 0.2, 0.15, 0.15, 0.15, 0.1, 0.05]::DOUBLE[]) AS w FROM f) SELECT seed, neighbour, coalesce(string_agg(c, ', ' ORDER BY round(-s * w, 6), c) FILTER (s >= 0.8::DOUBLE), '') AS reasons FROM x GROUP BY seed, neighbour")
def _(t):
    return scoring.reasons(scoring.recommend(candidates(t), n=20)).select("seed", "neighbour", "reasons")


@query("r11_fuse", f"WITH n AS ({knn_sql(20)}), {FACTORS} SELECT seed, neighbour, round(embedding * 0.4::DOUBLE + harmonic * 0.2::DOUBLE + bpm * 0.2::DOUBLE + semantic * 0.1::DOUBLE + energy * 0.1::DOUBLE, 9) AS total FROM f")
def _(t):
    return scoring.with_total(scoring.recommend(candidates(t), n=20), {"embedding": 0.4, "harmonic": 0.2, "bpm": 0.2, "semantic": 0.1, "energy": 0.1}).select("seed", "neighbour", "total")


@query("r12_feature_nearness", "SELECT trackid, round(least(1, 0.5 + coalesce(greatest(0, 0.5 - abs(energy / 10 - 0.6::DOUBLE)), 0) + coalesce(greatest(0, 0.5 - abs(bpm - 122) / 30), 0))::DOUBLE, 3) AS score FROM tracks LEFT JOIN track_labels USING (trackid)")
def _(t):
    return tables.with_labels(t.tracks, t.track_labels).select("trackid", scores.feature_nearness(F.col("energy") / 10, F.lit(0.6), F.col("bpm"), F.lit(122.0)).alias("score"))


@query("r14_direction_clue", f"""WITH n AS ({knn_sql(20)}), {FACTORS}, e AS (SELECT *, round((energy_b - energy_a) / 10, 6) AS de, round(bpm_b - bpm_a, 6) AS db, list_sort(list_filter(tags_b, lambda x: NOT list_contains(tags_a, x)))[1] AS nt, list_sort(list_filter(vibe_b, lambda x: NOT list_contains(vibe_a, x)))[1] AS nv FROM f)
  SELECT seed, neighbour, CASE WHEN de > 0.15::DOUBLE THEN 'more energy' WHEN coalesce(de >= -0.15::DOUBLE, true) AND db > 5 THEN 'more tempo' WHEN de < -0.15::DOUBLE THEN 'less energy' WHEN db < -5 THEN 'slower' WHEN tags_a IS NOT NULL AND nt IS NOT NULL THEN 'adds ' || nt WHEN vibe_a IS NOT NULL AND nv IS NOT NULL THEN 'turns ' || nv ELSE 'similar vibe' END AS clue FROM e""")
def _(t):
    return scoring.describe_direction(candidates(t)).select("seed", "neighbour", "clue")


#: Requests of many kinds, in the SQL of both engines: no tags, tags or vibes below the first steps' scores, no vibes, terms that nobody has, more tracks than
#: match, brands in small letters (which score but do not match), lists of terms beside the scores.
ASKED = """SELECT p_partkey AS request_id, {w}[{one} - 1] AS a, {w}[{one}] AS b, lower(p_brand) AS c, lower(p_type) AS v,
  CASE WHEN p_partkey % 50 = 9 THEN 'rare' WHEN p_partkey % 8 = 0 THEN 'none' WHEN p_partkey % 8 = 3 THEN 'low' ELSE 'all' END AS tag_kind,
  CASE WHEN p_partkey % 50 = 9 THEN 'rare' WHEN p_partkey % 5 = 2 THEN 'low' WHEN p_partkey % 5 = 4 THEN 'none' ELSE 'all' END AS vibe_kind, p_partkey % 100 = 9 AS listed,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(0.2 AS DOUBLE) END AS energy_low, CASE WHEN p_partkey % 2 = 0 THEN CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS energy_high,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(110 AS DOUBLE) END AS bpm_low, CASE WHEN p_partkey % 3 = 0 THEN CAST(130 AS DOUBLE) END AS bpm_high,
  CAST(CASE WHEN p_partkey % 10 = 7 THEN 60 ELSE 1 + p_size % 9 END AS INT) AS track_count FROM part"""


def intents(t: Tables) -> DataFrame:
    """One intent per part."""
    i = t.spark.sql(ASKED.format(w="split(p_name, ' ')", one=1).replace("FROM part", "FROM {part}"), part=t.part)
    scored = lambda *s: F.map_from_arrays(F.array("a", "b", "c"), F.array(*map(F.lit, s)))
    none = F.create_map().cast("map<string,double>")
    tags_ = F.when(F.col("tag_kind") == "rare", F.create_map(F.lit("nothing such"), F.lit(0.9))).when(F.col("tag_kind") == "none", none).when(F.col("tag_kind") == "low", scored(0.5, 0.3, 0.1)).otherwise(scored(0.9, 0.5, 0.3))
    vibes = F.when(F.col("vibe_kind") == "rare", F.create_map(F.lit("nothing such"), F.lit(1.0))).when(F.col("vibe_kind") == "none", none).when(F.col("vibe_kind") == "low", F.create_map("v", F.lit(0.3))).otherwise(F.create_map("v", F.lit(1.0)))
    lists = F.when(F.col("listed"), F.array("a", "b")), F.when(F.col("listed"), F.array().cast("array<string>"))
    return i.select("request_id", tags_.alias("tag_scores"), vibes.alias("vibe_scores"), lists[0].alias("semantic_tags"), lists[1].alias("vibes"), "energy_low", "energy_high", "bpm_low", "bpm_high", "track_count")


INTENTS = f"""i AS ({ASKED.format(w="string_split(p_name, ' ')", one=2)}),
  w AS (SELECT request_id, 'nothing such' AS term, 0.9::DOUBLE AS s FROM i WHERE tag_kind = 'rare' UNION ALL
    SELECT request_id, unnest([a, b, c]), unnest(CASE tag_kind WHEN 'low' THEN [0.5, 0.3, 0.1]::DOUBLE[] ELSE [0.9, 0.5, 0.3]::DOUBLE[] END) FROM i WHERE tag_kind IN ('low', 'all')),
  x AS (SELECT request_id, CASE WHEN vibe_kind = 'rare' THEN 'nothing such' ELSE v END AS term, CASE WHEN vibe_kind = 'low' THEN 0.3::DOUBLE ELSE 1::DOUBLE END AS s FROM i WHERE vibe_kind <> 'none'),
  lt AS (SELECT trackid, unnest(semantic_tags) AS tag FROM track_labels), lv AS (SELECT trackid, unnest(vibe) AS tag FROM track_labels),
  wt AS (SELECT request_id, sum(s) AS total, max(s) AS most FROM w GROUP BY ALL), xt AS (SELECT request_id, sum(s) AS total, max(s) AS most FROM x GROUP BY ALL),
  g AS (SELECT request_id, trackid, sum(s) AS got, max(s) FILTER (term = tag) AS best FROM w JOIN lt ON lower(tag) = lower(term) GROUP BY ALL),
  h AS (SELECT request_id, trackid, sum(s) AS got, max(s) FILTER (term = tag) AS best FROM x JOIN lv ON lower(tag) = lower(term) GROUP BY ALL),
  q AS (SELECT i.*, l.trackid, energy / 10 AS e, bpm, wt.most AS wm, xt.most AS xm, g.best AS wb, h.best AS xb,
      CASE WHEN wt.total IS NULL AND xt.total IS NULL AND energy_low IS NULL AND bpm_low IS NULL THEN 0.5::DOUBLE ELSE
      round(least(1, 0.45::DOUBLE * coalesce(g.got / wt.total, 0) + 0.35::DOUBLE * coalesce(h.got / xt.total, 0) + coalesce(greatest(0, 1 - abs(energy / 10 - (energy_low + energy_high) / 2) / greatest(energy_high - energy_low, 0.1::DOUBLE)) * 0.12::DOUBLE, 0) + coalesce(greatest(0, 1 - abs(bpm - (bpm_low + bpm_high) / 2) / greatest(bpm_high - bpm_low, 10)) * 0.08::DOUBLE, 0)), 3) END AS score
    FROM i CROSS JOIN track_labels l LEFT JOIN tracks t ON t.trackid = l.trackid LEFT JOIN wt ON wt.request_id = i.request_id LEFT JOIN xt ON xt.request_id = i.request_id
    LEFT JOIN g ON g.request_id = i.request_id AND g.trackid = l.trackid LEFT JOIN h ON h.request_id = i.request_id AND h.trackid = l.trackid),
  best AS (SELECT * FROM (SELECT request_id, trackid, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, trackid) AS rank, track_count FROM q) WHERE rank <= track_count)"""

LADDER = f"""{INTENTS}, steps(step, least, dropped) AS (VALUES (0, 0.65::DOUBLE, false), (1, 0.45::DOUBLE, false), (2, 0.2::DOUBLE, false), (3, 0.2::DOUBLE, true), (4, 0::DOUBLE, true)),
  inr AS (SELECT *, (energy_low IS NULL OR coalesce(e BETWEEN energy_low AND energy_high, false)) AND (bpm_low IS NULL OR bpm IS NULL OR bpm BETWEEN bpm_low AND bpm_high) AS fits FROM q),
  ps AS (SELECT request_id, trackid, score, track_count, step FROM inr JOIN steps ON (coalesce(wm < least, true) OR wb >= least) AND (coalesce(xm < least, true) OR xb >= least) AND (fits OR dropped)),
  st AS (SELECT request_id, coalesce(min(step) FILTER (n >= track_count), 4) AS step FROM (SELECT request_id, step, track_count, count(*) AS n FROM ps GROUP BY ALL) GROUP BY request_id),
  rs AS (SELECT * FROM (SELECT request_id, trackid, score, step, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, trackid) AS rank, track_count FROM ps JOIN st USING (request_id, step)) WHERE rank <= track_count),
  need AS (SELECT request_id, i.track_count - count(rs.trackid) AS needed, count(rs.trackid) AS held FROM i LEFT JOIN rs USING (request_id) GROUP BY request_id, i.track_count HAVING count(rs.trackid) < i.track_count),
  al AS (SELECT request_id, term FROM w JOIN i USING (request_id) WHERE NOT listed UNION SELECT request_id, unnest([a, b]) FROM i WHERE listed), ax AS (SELECT request_id, term FROM x JOIN i USING (request_id) WHERE NOT listed),
  rf AS (SELECT * FROM (SELECT request_id, trackid, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, trackid) AS nth FROM inr JOIN need USING (request_id) WHERE fits
      AND (request_id NOT IN (SELECT request_id FROM al) OR (request_id, trackid) IN (SELECT request_id, trackid FROM al JOIN lt ON tag = term))
      AND (request_id NOT IN (SELECT request_id FROM ax) OR (request_id, trackid) IN (SELECT request_id, trackid FROM ax JOIN lv ON tag = term))) WHERE nth <= 30),
  ce AS (SELECT request_id, list(m ORDER BY d) AS c FROM (SELECT request_id, d, avg(z) AS m FROM (SELECT request_id, unnest(feat) AS z, generate_subscripts(feat, 1) AS d FROM rf JOIN feat USING (trackid) WHERE (request_id, trackid) NOT IN (SELECT request_id, trackid FROM rs)) GROUP BY ALL) GROUP BY request_id),
  sm AS (SELECT request_id, trackid, round(list_cosine_similarity(feat, c), 6) AS sim FROM ce CROSS JOIN feat),
  fa AS (SELECT request_id, trackid, round(sim, 3) AS score, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, trackid) AS rank FROM sm WHERE sim > 0.25 AND (request_id, trackid) NOT IN (SELECT request_id, trackid FROM rs)),
  sb AS (SELECT request_id, trackid, round(least(1, 0.5 + coalesce(greatest(0, 0.5 - abs(energy / 10 - (energy_low + energy_high) / 2)), 0) + coalesce(greatest(0, 0.5 - abs(bpm - (bpm_low + bpm_high) / 2) / 30), 0))::DOUBLE, 3) AS score
    FROM need JOIN i USING (request_id) CROSS JOIN (SELECT trackid, bpm, energy FROM tracks LEFT JOIN track_labels USING (trackid)) WHERE request_id NOT IN (SELECT request_id FROM ce) AND (request_id, trackid) NOT IN (SELECT request_id, trackid FROM rs)),
  fb AS (SELECT request_id, trackid, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, trackid) AS rank FROM sb),
  fill AS (SELECT *, 'embedding similarity to tagged references' AS reason FROM fa UNION ALL SELECT *, 'audio feature proximity (untagged)' FROM fb),
  whole AS (SELECT request_id, trackid, score, CAST(step AS INTEGER) AS step, CAST(rank AS INTEGER) AS rank, false AS inferred, NULL::VARCHAR AS reason FROM rs
    UNION ALL SELECT request_id, trackid, score, 4, CAST(rank + held AS INTEGER), true, reason FROM fill JOIN need USING (request_id) WHERE rank <= needed)"""


@query("r2_relevance", f"WITH {INTENTS} SELECT request_id, trackid, score, rank FROM best")
def _(t):
    return search.relevance(intents(t), t.track_labels, t.tracks)


@query("r13_relaxation_search", f"WITH {LADDER} SELECT request_id, trackid, score, step, rank, inferred, reason FROM whole")
def _(t):
    return search.relaxation_search(intents(t), t.track_labels, t.tracks, t.feat)


@query("r13_without_vectors", f"WITH {LADDER.replace('list_cosine_similarity(feat, c)', '0::DOUBLE').replace('NOT IN (SELECT request_id FROM ce)', 'IS NOT NULL')} SELECT request_id, trackid, score, step, rank, inferred, reason FROM whole")
def _(t):
    return search.relaxation_search(intents(t), t.track_labels, t.tracks)


@query("v10_infer_by_centroid", f"WITH {LADDER} SELECT request_id, trackid, score, rank FROM whole WHERE reason LIKE 'embedding%'")
def _(t):
    return search.relaxation_search(intents(t), t.track_labels, t.tracks, t.feat).where(F.col("reason") == search.BY_CENTROID).select("request_id", "trackid", "score", "rank")


@query("r15_score_detail", f"""WITH {INTENTS}, d AS (SELECT request_id, trackid, lt.tag || '=' || printf('%.2f', s) AS said FROM best JOIN w USING (request_id) JOIN lt USING (trackid) WHERE lower(lt.tag) = lower(term)),
  v AS (SELECT request_id, trackid, lv.tag || '=' || printf('%.2f', s) AS said FROM best JOIN x USING (request_id) JOIN lv USING (trackid) WHERE lower(lv.tag) = lower(term))
  SELECT request_id, trackid, coalesce((SELECT string_agg(DISTINCT said, ', ' ORDER BY said) FROM d WHERE d.request_id = best.request_id AND d.trackid = best.trackid), '') AS tags, coalesce((SELECT string_agg(DISTINCT said, ', ' ORDER BY said) FROM v WHERE v.request_id = best.request_id AND v.trackid = best.trackid), '') AS vibes FROM best""")
def _(t):
    asked = intents(t)
    d = search.score_detail(search.relevance(asked, t.track_labels, t.tracks), asked, t.track_labels)
    said = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), F.format_number(x["value"], 2)))), ", ")
    return d.select("request_id", "trackid", said("matched_tags").alias("tags"), said("matched_vibes").alias("vibes"))


@query("a1_tag_vocabulary", "SELECT DISTINCT unnest(semantic_tags) AS tag FROM track_labels")
def _(t):
    return tags.vocabulary(t.track_labels)


@query("a1_vibe_vocabulary", "SELECT DISTINCT unnest(vibe) AS tag FROM track_labels")
def _(t):
    return tags.vocabulary(t.track_labels, "vibe")


@query("a2_tag_statistics", "WITH c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(semantic_tags) AS tag FROM track_labels) GROUP BY tag) SELECT tag, n, (SELECT count(*) FROM c) AS distinct_tags FROM c ORDER BY n DESC, tag LIMIT 20")
def _(t):
    return tags.tag_statistics(t.track_labels)


@query("a3_tag_index", "SELECT DISTINCT unnest(semantic_tags) AS tag, trackid FROM track_labels")
def _(t):
    return tags.tag_index(t.track_labels)


@query("a4_progress", "SELECT count(l.trackid) AS labelled, count(*) AS total, round(count(l.trackid) / count(*), 6) AS share FROM tracks t LEFT JOIN (SELECT trackid FROM track_labels WHERE len(semantic_tags) > 0) l USING (trackid)")
def _(t):
    return tags.progress(t.tracks, t.track_labels)


@query("a5_crate_stats", """WITH o AS (SELECT session_id, position, CASE WHEN coalesce(bpm, 0) = 0 THEN 120 ELSE bpm END AS bpm, coalesce(key, 'Unknown') AS key, coalesce(energy, 0.5)::DOUBLE AS energy, semantic_tags FROM crates JOIN tracks USING (trackid) LEFT JOIN track_labels USING (trackid)),
  k AS (SELECT session_id, string_agg(kv, ';' ORDER BY kv) AS keys FROM (SELECT session_id, key || '=' || count(*) AS kv FROM o GROUP BY session_id, key) GROUP BY session_id), g AS (SELECT session_id, string_agg(kv, ';' ORDER BY kv) AS tags FROM (SELECT session_id, tag || '=' || count(*) AS kv FROM (SELECT session_id, unnest(semantic_tags) AS tag FROM o) GROUP BY session_id, tag) GROUP BY session_id)
  SELECT session_id, count(*) AS n, 4 * count(*) AS minutes, CAST(round(round(avg(bpm), 6)) AS BIGINT) AS mean_bpm, round(avg(energy), 6) AS mean_energy, min(energy) AS low_energy, max(energy) AS high_energy, any_value(keys) AS keys, any_value(tags) AS tags FROM o LEFT JOIN k USING (session_id) LEFT JOIN g USING (session_id) GROUP BY session_id""")
def _(t):
    return sequences.crate_stats(t.crates, t.tracks, t.track_labels)


@query("a6_ingest_stats", "SELECT count(*) AS total, count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 2 = 0) AS uploaded, count(*) FILTER (p_partkey % 2 = 1) AS skipped, count(*) FILTER (p_partkey % 4 = 0) AS failed FROM part")
def _(t):
    from segue.sources.writers import ingest_stats
    from segue.streaming.jobs import skip_existing

    paths = t.tracks.select("trackid", F.when(F.col("trackid") % 4 != 0, F.col("filepath")).alias("filepath"))
    return ingest_stats(skip_existing(paths, t.tracks.where("trackid % 2 = 1")))


LATEST = "lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trackid, tag ORDER BY ts DESC, event_id DESC) AS n FROM votes) WHERE n = 1)"


@query("a7_vote_summary", f"WITH {LATEST} SELECT tag, count(*) FILTER (weight_delta > 0) AS up, count(*) FILTER (weight_delta < 0) AS down, count(*) FILTER (weight_delta <> 0) AS active FROM lv GROUP BY tag")
def _(t):
    return tags.vote_summary(t.votes)


SUGGEST = "j AS (SELECT n.*, {c} AS names, energy, semantic_tags, vibe FROM n JOIN track_labels l ON l.trackid = n.neighbour), so AS (SELECT seed FROM j WHERE len(semantic_tags) > 0 OR len(vibe) > 0 GROUP BY seed HAVING round(sum(sim), 6) <> 0), x AS (SELECT seed, tag, round(sum(sim), 6) AS weight FROM (SELECT seed, sim, unnest(names) AS tag FROM j) GROUP BY seed, tag) SELECT seed, tag, weight, round(least(0.99::DOUBLE, weight / 4), 9) AS confidence FROM x WHERE weight > 0.5 AND seed IN (FROM so)"


@query("a8_suggest_tags", f"WITH n AS ({knn_sql(10)}), {SUGGEST.format(c='semantic_tags')}")
def _(t):
    return tags.suggest(feat_knn(t, 10), t.track_labels)


@query("a9_suggest_vibes", f"WITH n AS ({knn_sql(10)}), {SUGGEST.format(c='vibe')}")
def _(t):
    return tags.suggest(feat_knn(t, 10), t.track_labels, "vibe")


@query("a10_predict_energy", f"WITH n AS ({knn_sql(10)}), j AS (SELECT n.*, energy, coalesce(len(semantic_tags) > 0, false) OR coalesce(len(vibe) > 0, false) AS tagged FROM n JOIN track_labels l ON l.trackid = n.neighbour) SELECT seed, CASE WHEN round(sum(sim) FILTER (tagged), 6) <> 0 AND round(sum(sim) FILTER (energy IS NOT NULL), 6) > 0 THEN round(sum(energy * sim) / sum(sim) FILTER (energy IS NOT NULL), 5) END AS energy FROM j GROUP BY seed")
def _(t):
    return tags.predict_energy(feat_knn(t, 10), t.track_labels)


@query("a11_vote_weight", f"WITH {LATEST} SELECT trackid, tag, greatest(0, 1 + weight_delta) AS weight FROM lv")
def _(t):
    return tags.vote_weight(t.votes)


@query("a12_merge_tags", "SELECT trackid, coalesce(list_has_any(semantic_tags, ['blue', 'cold']), false) AS affected, array_to_string(list_sort(CASE WHEN list_has_any(semantic_tags, ['blue', 'cold']) THEN list_distinct(list_concat(list_filter(semantic_tags, lambda x: x NOT IN ('blue', 'cold')), ['chill'])) ELSE semantic_tags END), '|') AS tags FROM track_labels")
def _(t):
    return tags.merge_tags(t.track_labels, ["blue", "cold"], "chill").select("trackid", "affected", F.array_join(F.array_sort("semantic_tags"), "|").alias("tags"))


@query("a13_promote_votes", f"WITH {LATEST}, s AS (SELECT trackid, list(DISTINCT tag) AS voted FROM lv WHERE weight_delta >= 2 GROUP BY trackid) SELECT l.trackid, array_to_string(list_sort(CASE WHEN voted IS NOT NULL THEN list_distinct(list_concat(coalesce(semantic_tags, []), voted)) ELSE semantic_tags END), '|') AS tags FROM track_labels l LEFT JOIN s USING (trackid)")
def _(t):
    return tags.promote_votes(t.track_labels, t.votes).select("trackid", F.array_join(F.array_sort("semantic_tags"), "|").alias("tags"))


@query("a14_bins", f"WITH n AS ({knn_sql(5)}), c AS ({CONFIDENCE}) SELECT CASE WHEN bpm_b < 110 THEN 'slow' WHEN bpm_b < 125 THEN 'medium' WHEN bpm_b < 140 THEN 'fast' WHEN bpm_b >= 140 THEN 'very fast' END AS tempo, CASE WHEN confidence * 100 >= 80 THEN 'excellent' WHEN confidence * 100 >= 60 THEN 'good' WHEN confidence * 100 >= 40 THEN 'fair' ELSE 'poor' END AS mix, CASE WHEN sim >= 0.8::DOUBLE THEN 'strong' WHEN sim >= 0.65::DOUBLE THEN 'good' WHEN sim >= 0.5::DOUBLE THEN 'fair' ELSE 'weak' END AS match, CASE WHEN confidence >= 0.7::DOUBLE THEN 'high' WHEN confidence >= 0.4::DOUBLE THEN 'middle' ELSE 'low' END AS bar, count(*) AS n FROM c GROUP BY ALL")
def _(t):
    e = vectors.explain_pairs(feat_knn(t, 5), t.tracks).join(t.tracks.select(F.col("trackid").alias("neighbour"), "bpm"), "neighbour")
    return e.groupBy(scores.tempo_bin(F.col("bpm")).alias("tempo"), scores.mix_bin(F.col("confidence") * 100).alias("mix"), scores.match_bin(F.col("sim")).alias("match"), scores.bar_bin(F.col("confidence")).alias("bar")).agg(F.count("*").alias("n"))


MEMBERS = """mb AS (SELECT DISTINCT tag, trackid, feat, list_transform(feat, lambda x: x / sqrt(list_inner_product(feat, feat))) AS u FROM (SELECT trackid, unnest(semantic_tags) AS tag FROM track_labels) JOIN feat USING (trackid)),
  cn AS (SELECT tag, count(*) AS n FROM mb GROUP BY tag),
  ss AS (SELECT tag, list(x ORDER BY d) AS total FROM (SELECT tag, d, sum(x) AS x FROM (SELECT tag, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM mb) GROUP BY ALL) GROUP BY tag),
  sq AS (SELECT tag, n, total, list_inner_product(total, total) AS square FROM ss JOIN cn USING (tag)),
  pairs AS (SELECT a.tag, a.trackid, b.trackid AS other, list_inner_product(a.u, b.u) AS c FROM mb a JOIN mb b USING (tag)),
  near AS (SELECT tag, trackid, CASE WHEN count(*) > 1 THEN round((sum(c) FILTER (trackid <> other)) / (count(*) - 1), 6) ELSE 1 END AS near FROM pairs GROUP BY tag, trackid),
  md AS (SELECT tag, trackid, near FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY near DESC, trackid) AS r FROM near) WHERE r = 1),
  ma AS (SELECT tag, list(x ORDER BY d) AS centroid FROM (SELECT tag, d, avg(x) AS x FROM (SELECT tag, unnest(feat) AS x, generate_subscripts(feat, 1) AS d FROM mb) GROUP BY ALL) GROUP BY tag),
  mu AS (SELECT tag, list_transform(centroid, lambda x: x / sqrt(list_inner_product(centroid, centroid))) AS centroid FROM ma)"""


def checked(df: DataFrame) -> DataFrame:
    """Centroids, a row for each dimension."""
    return df.select("tag", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 5))


def tag_members(t: Tables) -> DataFrame:
    return tags.members(t.track_labels, t.feat)


@query("c1_mean_centroid", f"WITH {MEMBERS} SELECT tag, CAST(generate_subscripts(centroid, 1) - 1 AS INTEGER) AS dim, round(unnest(centroid), 5) AS x FROM mu")
def _(t):
    return checked(tags.centroid_mean(tag_members(t)))


@query("c2_medoid", f"WITH {MEMBERS} SELECT tag, trackid, near FROM md")
def _(t):
    return tags.centroid_medoid(tag_members(t)).select("tag", "trackid", "near")


@query("c3_density_centroid", f"WITH {MEMBERS}, w AS (SELECT tag, trackid, sum(exp(-(1 - c) / (2 * 0.1::DOUBLE * 0.1::DOUBLE))) AS w FROM pairs GROUP BY ALL), ce AS (SELECT tag, list(x ORDER BY d) AS centroid FROM (SELECT tag, d, sum(w * x) / sum(w) AS x FROM (SELECT mb.tag, w, unnest(feat) AS x, generate_subscripts(feat, 1) AS d FROM mb JOIN w ON w.tag = mb.tag AND w.trackid = mb.trackid) GROUP BY ALL) GROUP BY tag) SELECT tag, CAST(generate_subscripts(centroid, 1) - 1 AS INTEGER) AS dim, round(unnest(centroid) / sqrt(list_inner_product(centroid, centroid)), 5) AS x FROM ce")
def _(t):
    return checked(tags.centroid_density(tag_members(t)))


@query("c4_multi_centroids")
def _(t):
    return tags.centroid_multi(tag_members(t)).select("tag", "trackid")


@query("c5_nn_voting", f"WITH {MEMBERS} SELECT m.tag, f.trackid, round(avg(list_cosine_similarity(f.feat, m.feat)), 6) AS sim FROM feat f CROSS JOIN mb m GROUP BY ALL")
def _(t):
    return tags.rank_nn_voting(tag_members(t), t.feat)


@query("c6_routes", f"WITH {MEMBERS} SELECT tag, n, CASE WHEN n = 1 THEN 'single' WHEN n <= 5 THEN 'voting' WHEN n <= 15 THEN 'medoid' WHEN n <= 30 THEN CASE WHEN square / (n * n) >= 0.4 THEN 'density' ELSE 'multi' END ELSE 'mean' END AS route FROM sq")
def _(t):
    return tags.routes(tag_members(t), 0.4)


@query("c6_adaptive_centroids")
def _(t):
    return checked(tags.adaptive_centroids(tag_members(t), 0.4))


@query("c7_rank_for_tags", f"WITH {MEMBERS} SELECT tag, trackid, sim, rank FROM (SELECT tag, trackid, round(list_inner_product(centroid, feat) / sqrt(list_inner_product(feat, feat)), 6) AS sim, row_number() OVER (PARTITION BY tag ORDER BY round(list_inner_product(centroid, feat) / sqrt(list_inner_product(feat, feat)), 6) DESC, trackid) AS rank FROM mu CROSS JOIN feat) WHERE rank <= 10")
def _(t):
    return tags.rank_for_tags(t.feat, tags.centroid_mean(tag_members(t)))


@query("c8_intra_similarity", f"WITH {MEMBERS} SELECT tag, n, round(avg(c) FILTER (trackid <> other), 6) AS intra FROM pairs JOIN cn USING (tag) GROUP BY tag, n")
def _(t):
    return tags.intra_similarity(tag_members(t))


@query("c9_misfits", f"""WITH {MEMBERS}, e AS (SELECT m.tag, m.trackid, c.tag AS other, round(list_inner_product(m.u, c.centroid), 6) AS sim FROM mb m CROSS JOIN mu c), o AS (SELECT tag, trackid, sim AS own_sim FROM e WHERE tag = other)
  SELECT tag, trackid, own_sim, other, sim, round(sim - own_sim, 6) AS margin FROM (SELECT e.*, own_sim, row_number() OVER (PARTITION BY e.tag, e.trackid ORDER BY sim DESC, other) AS r FROM e JOIN o ON o.tag = e.tag AND o.trackid = e.trackid WHERE other <> e.tag AND sim > own_sim) WHERE r = 1""")
def _(t):
    with scratch(t.spark):
        m = written(tag_members(t))
        return written(tags.misfits(m, written(tags.centroid_mean(m))).select("tag", "trackid", "own_sim", "other", "sim", "margin"), keep=True)


@query("c10_tag_quality", f"""WITH {MEMBERS}, i AS (SELECT tag, n, round(avg(c) FILTER (trackid <> other), 6) AS intra FROM pairs JOIN cn USING (tag) GROUP BY tag, n), p AS (SELECT a.tag, b.tag AS nearest, round(list_inner_product(a.centroid, b.centroid), 6) AS inter FROM mu a JOIN mu b ON a.tag <> b.tag), b AS (SELECT tag, min(nearest) AS nearest, any_value(inter) AS inter, CASE WHEN any_value(inter) >= 0.85 THEN string_agg(nearest, ', ' ORDER BY nearest) END AS top_similar FROM (SELECT *, rank() OVER (PARTITION BY tag ORDER BY inter DESC) AS r FROM p) WHERE r = 1 GROUP BY tag)
  SELECT tag, n, intra, nearest, inter, coalesce(top_similar, '') AS top_similar, CASE WHEN n < 2 OR intra IS NULL THEN 'keep' WHEN intra < 0.5 THEN 'drop' WHEN inter >= 0.85 THEN 'merge' ELSE 'keep' END AS action FROM i LEFT JOIN b USING (tag)""")
def _(t):
    with scratch(t.spark):
        m = written(tag_members(t))
        return written(tags.tag_quality(m, tags.centroid_mean(m)), keep=True)


SEEDS = f"""tg AS (SELECT DISTINCT p_brand AS tag FROM part), {LATEST}, hv AS (SELECT DISTINCT tag, trackid FROM (SELECT trackid, unnest(semantic_tags) AS tag FROM track_labels) WHERE tag IN (FROM tg)), vo AS (SELECT tag, trackid, CASE WHEN weight_delta > 0 THEN 1 WHEN weight_delta < 0 THEN 0 END AS vote FROM lv WHERE tag IN (FROM tg)),
  sd AS (SELECT tag, trackid, CAST(coalesce(vote, 1) AS INTEGER) AS label FROM hv FULL JOIN vo USING (tag, trackid) WHERE (vote IS NOT NULL OR hv.trackid IS NOT NULL) AND trackid IN (SELECT trackid FROM tracks))"""


def brands(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("tag")).distinct()


def brand_seeds(t: Tables) -> DataFrame:
    return spreading.own_labels(t.track_labels, t.votes, brands(t), t.tracks)


def brand_spread(t: Tables) -> DataFrame:
    return spreading.label_spread(feat_knn(t, 6), brand_seeds(t), t.track_labels.where(F.size("semantic_tags") > 0))


#: The labels of all tagged tracks, those that follow from the track alone included.
LABELLED = f"""tg AS (SELECT DISTINCT p_brand AS tag FROM part), {LATEST}, hv AS (SELECT DISTINCT tag, trackid FROM (SELECT trackid, unnest(semantic_tags) AS tag FROM track_labels) WHERE tag IN (FROM tg)), vo AS (SELECT tag, trackid, CASE WHEN weight_delta > 0 THEN 1 WHEN weight_delta < 0 THEN 0 END AS vote FROM lv WHERE tag IN (FROM tg)),
  gr AS (SELECT tag, trackid FROM tg CROSS JOIN (SELECT trackid FROM track_labels WHERE len(semantic_tags) > 0) UNION SELECT tag, trackid FROM vo WHERE trackid IN (SELECT trackid FROM tracks)),
  sd AS (SELECT tag, trackid, CAST(coalesce(vote, CASE WHEN hv.trackid IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS label FROM gr LEFT JOIN hv USING (tag, trackid) LEFT JOIN vo USING (tag, trackid))"""


@query("c11_seed_labels", f"WITH {LABELLED} SELECT tag, trackid, label FROM sd")
def _(t):
    return spreading.seed_labels(t.track_labels, t.votes, brands(t), t.tracks)


#: Each tag's labels of all tracks are spread until they settle; an edge from each track to itself carries what it was before.
SPREAD = f"""n AS ({knn_sql(6)}), {SEEDS}, dg AS (SELECT neighbour AS node, count(*)::DOUBLE AS d FROM n GROUP BY 1),
  sc AS (SELECT seed, neighbour, 1 / sqrt(coalesce(a.d, 1) * coalesce(b.d, 1)) AS s, 0 AS me FROM n LEFT JOIN dg a ON a.node = seed LEFT JOIN dg b ON b.node = neighbour UNION ALL SELECT DISTINCT seed, seed, 0, 1 FROM n),
  y AS (SELECT tg.tag, node, coalesce(label, CASE WHEN node IN (SELECT trackid FROM track_labels WHERE len(semantic_tags) > 0) THEN 0 ELSE -1 END) AS label FROM (SELECT DISTINCT seed AS node FROM n) CROSS JOIN tg LEFT JOIN sd ON sd.trackid = node AND sd.tag = tg.tag WHERE tg.tag IN (SELECT tag FROM sd WHERE label = 1 AND trackid IN (SELECT seed FROM n))),
  f AS (SELECT 0 AS t, y.tag, node, label, (label = 0)::INT::DOUBLE AS a, (label = 1)::INT::DOUBLE AS b, 1::DOUBLE AS change FROM y UNION ALL
    SELECT t + 1, tag, node, label, a, b, sum(abs(a - oa) + abs(b - ob)) OVER (PARTITION BY tag) FROM (SELECT f.t, f.tag, seed AS node, max(f.label) FILTER (me = 1) AS label, 0.2::DOUBLE * sum(s * a) + 0.8::DOUBLE * (max(f.label) FILTER (me = 1) = 0)::INT AS a, 0.2::DOUBLE * sum(s * b) + 0.8::DOUBLE * (max(f.label) FILTER (me = 1) = 1)::INT AS b,
      sum(a) FILTER (me = 1) AS oa, sum(b) FILTER (me = 1) AS ob FROM f JOIN sc ON sc.neighbour = f.node WHERE f.t < 30 AND change >= 0.001::DOUBLE GROUP BY f.t, f.tag, seed)),
  fl AS (SELECT * FROM f QUALIFY t = max(t) OVER (PARTITION BY tag)),
  nm AS (SELECT tag, node, a / (a + b) AS a, b / (a + b) AS b FROM fl WHERE a + b > 0), ar AS (SELECT seed, neighbour FROM n UNION SELECT seed, seed FROM n),
  pr AS (SELECT tag, seed AS trackid, round(sum(b) / (sum(a) + sum(b)), 6) AS probability FROM ar JOIN nm ON nm.node = neighbour GROUP BY tag, seed), po AS (SELECT * FROM pr WHERE probability > 0 AND (tag, trackid) NOT IN (SELECT (tag, trackid) FROM sd WHERE label = 1))"""


@query("c12_label_spread", f"WITH RECURSIVE {SPREAD} SELECT tag, trackid, probability FROM po")
def _(t):
    return brand_spread(t)


@query("c13_triage", f"WITH RECURSIVE {SPREAD} SELECT tag, trackid, probability, bucket, place FROM (SELECT *, row_number() OVER (PARTITION BY tag, bucket ORDER BY probability DESC, trackid) AS place FROM (SELECT *, CASE WHEN probability > 0.85 THEN 'accept' WHEN probability > 0.4 AND probability < 0.6 THEN 'uncertain' END AS bucket FROM po) WHERE bucket IS NOT NULL) WHERE place <= 10")
def _(t):
    return tags.triage(brand_spread(t))


@query("c14_random_unlabeled", "SELECT t.trackid FROM tracks t LEFT JOIN track_labels l ON l.trackid = t.trackid LEFT JOIN (SELECT DISTINCT trackid, 1 AS seen FROM votes) v ON v.trackid = t.trackid WHERE l.trackid IS NULL OR coalesce(len(l.semantic_tags), 0) = 0 ORDER BY coalesce(seen, 0), md5(concat(t.trackid, '/7')), t.trackid LIMIT 50")
def _(t):
    return tables.random_unlabeled(t.tracks, t.track_labels, t.votes, 50, 7).select("trackid")


STEPS = f"""j AS (SELECT session_id, position, c.trackid, bpm, key FROM crates c LEFT JOIN tracks t USING (trackid)), s AS (SELECT *, lead(trackid) OVER w AS next_track, lead(bpm) OVER w AS next_bpm, lead(key) OVER w AS next_key, lead(1) OVER w AS more FROM j WINDOW w AS (PARTITION BY session_id ORDER BY position)),
  tr AS (SELECT session_id, position, trackid, next_track, bpm, next_bpm, key, next_key, round(abs(coalesce(next_bpm, 120) - coalesce(bpm, 120)), 6) AS bpm_step, {harmonic_sql('key', 'next_key')} AS harmony, round(0.5::DOUBLE * (1 - least(round(abs(coalesce(next_bpm, 120) - coalesce(bpm, 120)), 6) / 20, 1)) + 0.5::DOUBLE * {harmonic_sql('key', 'next_key')}, 6) AS score FROM s WHERE more = 1),
  iss AS (SELECT session_id, 'bpm_incompatibility' AS type, position, CASE WHEN bpm_step > 15 THEN 'high' ELSE 'medium' END AS severity, 'BPM jump: ' || coalesce(bpm::VARCHAR, 'None') || ' → ' || coalesce(next_bpm::VARCHAR, 'None') AS details FROM tr WHERE bpm_step > 10
    UNION ALL SELECT session_id, 'harmonic_clash', position, 'medium', 'Key clash: ' || coalesce(key, 'None') || ' → ' || coalesce(next_key, 'None') FROM tr WHERE harmony < 0.3)"""


@query("q1_transitions", f"WITH {STEPS} SELECT * FROM tr")
def _(t):
    return sequences.transitions(t.crates, t.tracks)


@query("q2_sequence_issues", f"WITH {STEPS} SELECT session_id, type, CAST(position AS INTEGER) AS position, severity, details FROM iss")
def _(t):
    return sequences.sequence_issues(sequences.transitions(t.crates, t.tracks))


@query("q3_validate_sequence", f"""WITH {STEPS}, a AS (SELECT session_id, string_agg(type || '/' || position || '/' || severity || '/' || details, '; ' ORDER BY position, type) AS issues, bool_or(severity = 'high') AS high FROM iss GROUP BY 1),
  b AS (SELECT session_id, string_agg(printf('%.6f', score), ' ' ORDER BY position) AS scores, round(avg(score), 9) AS overall FROM tr GROUP BY 1)
  SELECT session_id, n, coalesce(issues, '') AS issues, coalesce(scores, '') AS transition_scores, coalesce(overall, 0) AS overall_score, NOT coalesce(high, false) AS is_mixable FROM (SELECT session_id, count(*) AS n FROM crates GROUP BY 1) LEFT JOIN a USING (session_id) LEFT JOIN b USING (session_id)""")
def _(t):
    report = sequences.validate_sequence(t.crates, t.tracks)
    said = lambda x: F.concat_ws("/", x["type"], x["position"].cast("string"), x["severity"], x["details"])
    return report.withColumns({"issues": F.array_join(F.transform("issues", said), "; "), "transition_scores": F.array_join(F.transform("transition_scores", lambda x: F.format_string("%.6f", x)), " ")})


@query("q4_apply_order", "SELECT session_id, CAST(max(position) OVER (PARTITION BY session_id) - position AS INTEGER) AS position, trackid FROM crates")
def _(t):
    g = t.crates.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "trackid"))).alias("o"))
    return sequences.apply_order(g.select("session_id", F.transform("o", lambda x: x["trackid"]).alias("tracks"), F.reverse(F.transform("o", lambda x: x["position"].cast("int"))).alias("sequence_order")))


@query("q5_without_repeats", "SELECT session_id, trackid, row_number() OVER (PARTITION BY session_id ORDER BY p) - 1 AS position FROM (SELECT session_id, trackid, min(position) AS p FROM crates GROUP BY ALL)")
def _(t):
    return sequences.without_repeats(t.crates)


@query("q5_remove_and_move", "SELECT session_id, trackid, CASE p WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE p END AS position FROM (SELECT session_id, trackid, row_number() OVER (PARTITION BY session_id ORDER BY position) - 1 AS p FROM crates WHERE trackid NOT IN (SELECT trackid FROM tracks WHERE title IS NULL))")
def _(t):
    return sequences.move_track(sequences.remove_tracks(t.crates, t.tracks.where("title is null")), 0, 2)


def crate_edits(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The first three tracks of each session, and its other rows as edits: most add their track or that of the row before, some remove the track three rows before, set a new order or clear."""
    w = Window.partitionBy("session_id").orderBy("position")
    rows = t.crates.withColumns({"third": F.lag("trackid", 3).over(w), "one": F.lag("trackid", 1).over(w)}).where("position > 2")
    m = F.col("trackid") % 9
    op = F.when(m == 0, "remove").when(m == 1, "reorder").when((m == 2) & (F.col("position") > 4), "clear").otherwise("add")
    order = F.when(op == "reorder", F.array("one", "third"))
    return t.crates.where("position < 3"), rows.select("session_id", F.col("position").alias("seq"), op.alias("op"), F.when(op == "remove", F.col("third")).when(m == 3, F.col("one")).otherwise(F.col("trackid")).alias("trackid"), order.alias("order"))


EDITS = """op AS (SELECT session_id, position AS seq, CASE WHEN m = 0 THEN 'remove' WHEN m = 1 THEN 'reorder' WHEN m = 2 AND position > 4 THEN 'clear' ELSE 'add' END AS op, CASE WHEN m = 0 THEN third WHEN m = 3 THEN one ELSE trackid END AS trackid, list_distinct([one, third]) AS l1, one, third
    FROM (SELECT *, trackid % 9 AS m, lag(trackid, 3) OVER w AS third, lag(trackid, 1) OVER w AS one FROM crates WINDOW w AS (PARTITION BY session_id ORDER BY position)) WHERE position > 2),
  st AS (SELECT session_id, 2::BIGINT AS seq, list(trackid ORDER BY first) AS held, true AS accepted FROM (SELECT session_id, trackid, min(position) AS first FROM crates WHERE position < 3 GROUP BY ALL) GROUP BY session_id UNION ALL
    SELECT st.session_id, op.seq, CASE op.op WHEN 'add' THEN CASE WHEN list_contains(held, op.trackid) THEN held ELSE list_append(held, op.trackid) END WHEN 'remove' THEN list_filter(held, lambda x: x <> op.trackid) WHEN 'clear' THEN [] ELSE CASE WHEN one = third THEN [one] ELSE [one, third] END END, op.op <> 'add' OR NOT list_contains(held, op.trackid)
    FROM st JOIN op ON op.session_id = st.session_id AND op.seq = st.seq + 1),
  fin AS (SELECT session_id, held FROM st QUALIFY seq = max(seq) OVER (PARTITION BY session_id))"""


@query("q5_edited_crates", f"WITH RECURSIVE {EDITS} SELECT session_id, CAST(unnest(range(0, len(held))) AS INTEGER) AS position, unnest(held) AS trackid FROM fin")
def _(t):
    return edits.edited(*crate_edits(t))


@query("q5_edit_log", f"WITH RECURSIVE {EDITS} SELECT session_id, seq, op.op, CASE WHEN op.op IN ('add', 'remove') THEN trackid END AS trackid, accepted FROM st JOIN op USING (session_id, seq)")
def _(t):
    return edits.edit_log(*crate_edits(t))


@query("q6_recent_crates", "SELECT o_orderkey AS session_id FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 24 HOURS")
def _(t):
    return sequences.recent_crates(t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("modified")), "1998-01-01 00:00:00").select("session_id")


@query("q7_badges", f"WITH {STEPS} SELECT session_id, position, CASE WHEN bpm_step > 15 THEN 'high' WHEN bpm_step > 10 OR harmony < 0.3 THEN 'medium' WHEN score > 0.7 THEN 'good' ELSE 'none' END AS badge FROM tr")
def _(t):
    return sequences.badges(sequences.transitions(t.crates, t.tracks)).select("session_id", "position", "badge")


@query("sn10_save_crates", f"WITH {STEPS} SELECT session_id, coalesce(round(avg(score), 9), 0) AS overall, 2 AS saved_at FROM (SELECT DISTINCT session_id FROM crates) LEFT JOIN tr USING (session_id) GROUP BY session_id")
def _(t):
    new = sequences.validate_sequence(t.crates, t.tracks).select("session_id", F.col("overall_score").alias("overall"), F.lit(2).alias("saved_at"))
    old = t.crates.select("session_id", F.lit(0.0).alias("overall"), F.lit(1).alias("saved_at")).distinct()
    return sequences.save_crates(old, new)


@query("g1_artist_edges", "SELECT source, target, type FROM (SELECT trackid AS source, lead(trackid) OVER (PARTITION BY coalesce(artist, 'Unknown') ORDER BY trackid) AS target, 'artist' AS type FROM tracks) WHERE target IS NOT NULL")
def _(t):
    return sequences.artist_edges(t.tracks)


@query("g2_graph_edges", f"WITH n AS ({knn_sql(8, threshold=0.3)}) SELECT seed AS source, neighbour AS target, 'similarity' AS type FROM n UNION ALL SELECT source, target, type FROM (SELECT trackid AS source, lead(trackid) OVER (PARTITION BY coalesce(artist, 'Unknown') ORDER BY trackid) AS target, 'artist' AS type FROM tracks) WHERE target IS NOT NULL")
def _(t):
    return sequences.graph_edges(feat_knn(t, 8, 0.3), t.tracks)


def far_pairs(t: Tables) -> DataFrame:
    """For every tenth track that has a vector the next three such tracks in id order, one far away, and one that does not exist."""
    f = t.feat.select("trackid", F.floor(F.col("trackid") / 1000).alias("b"))
    w = Window.partitionBy("b").orderBy("trackid")
    some = f.select("trackid", F.array(*(F.lead("trackid", n).over(w) for n in (1, 2, 3, 71)), F.lit(-1).cast("long")).alias("targets")).where("trackid % 10 = 0")
    return some.select(F.col("trackid").alias("source"), F.explode("targets").alias("target")).where("target is not null")


@query("g3_pathways", f"""WITH n AS ({knn_sql(8, threshold=0.3)}), pq AS (SELECT * FROM (SELECT source, unnest([a, b, c, d, -1]) AS target FROM (SELECT trackid AS source, lead(trackid, 1) OVER w AS a, lead(trackid, 2) OVER w AS b, lead(trackid, 3) OVER w AS c, lead(trackid, 71) OVER w AS d FROM feat WINDOW w AS (PARTITION BY trackid // 1000 ORDER BY trackid)) WHERE source % 10 = 0) WHERE target IS NOT NULL),
  """ + ", ".join(
    f"p{h} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source, target, node ORDER BY round(-total, 6), path) AS r FROM (SELECT source, target, neighbour AS node, list_append(path, neighbour) AS path, total + sim AS total FROM {'(SELECT source, target, source AS node, [source] AS path, 0::DOUBLE AS total FROM pq)' if h == 1 else f'(SELECT * FROM p{h - 1} WHERE node <> target)'} JOIN n ON n.seed = node WHERE NOT list_contains(path, neighbour))) WHERE r = 1)"
    for h in (1, 2, 3, 4)
) + ", al AS (" + " UNION ALL ".join(f"SELECT *, {h} AS hops FROM p{h} WHERE node = target" for h in (1, 2, 3, 4)) + ") SELECT source, target, CAST(hops AS INTEGER) AS hops, round(round(total, 6) / hops, 9) AS mean_sim, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY hops, round(-total, 6), path) AS r FROM al) WHERE r = 1")
def _(t):
    return graphs.pathways(feat_knn(t, 8, 0.3), far_pairs(t))


@query("g4_pathway_data", f"""WITH n AS ({knn_sql(20)}), {FACTORS}, best AS (SELECT seed, neighbour, total, row_number() OVER (PARTITION BY seed ORDER BY total DESC, neighbour) AS rank FROM r)
  SELECT b.seed AS source, b.neighbour AS target, total, rank, title, artist, feat[1] AS x, feat[2] AS y, feat[3] AS z FROM best b LEFT JOIN tracks t ON t.trackid = b.neighbour LEFT JOIN feat f ON f.trackid = b.neighbour WHERE rank <= 5""")
def _(t):
    placed = t.feat.select("trackid", *(F.get("feat", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
    return graphs.pathway_data(scoring.recommend(candidates(t), n=5), t.tracks, placed)


VOCABULARY = "vt AS (SELECT DISTINCT unnest(semantic_tags) AS tag FROM track_labels), vv AS (SELECT DISTINCT unnest(vibe) AS tag FROM track_labels)"


@query("x1_keyword_intents", f"WITH {VOCABULARY}, a AS (SELECT request_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM requests JOIN vt ON contains(lower(text), lower(tag)) GROUP BY 1), b AS (SELECT request_id, string_agg(tag, '|' ORDER BY tag) AS vibes FROM requests JOIN vv ON contains(lower(text), lower(tag)) GROUP BY 1) SELECT request_id, coalesce(tags, '') AS tags, coalesce(vibes, '') AS vibes FROM requests LEFT JOIN a USING (request_id) LEFT JOIN b USING (request_id)")
def _(t):
    p = req.parse_requests(t.requests, tags.vocabulary(t.track_labels), tags.vocabulary(t.track_labels, "vibe"))
    named = lambda c: F.array_join(F.array_sort(F.map_keys(c)), "|")
    return p.select("request_id", named("tag_scores").alias("tags"), named("vibe_scores").alias("vibes"))


@query("x2_energy_range", "SELECT request_id, (CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN {lo}" for w, lo, _ in req.DESCRIPTORS) + " END)::DOUBLE AS low, (CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN {hi}" for w, _, hi in req.DESCRIPTORS) + " END)::DOUBLE AS high FROM requests")
def _(t):
    return t.requests.select("request_id", req.energy_range(F.col("text")).alias("e")).select("request_id", "e.low", "e.high")


@query("x3_track_count", "SELECT request_id, CAST(greatest(1, coalesce(TRY_CAST(nullif(regexp_extract(lower(text), '([0-9]+)\\s*(?:\\w+\\s+)*?(?:track|song|result|tune)s?', 1), '') AS INTEGER), 5)) AS INTEGER) AS n FROM requests")
def _(t):
    return t.requests.select("request_id", req.track_count(F.col("text")).alias("n"))


@query("x4_validate_terms", f"WITH {VOCABULARY}, w AS (SELECT p_partkey AS request_id, unnest([upper(p_name), p_brand, p_type]) AS term, 0.12345::DOUBLE AS score FROM part), v AS (SELECT lower(tag) AS low, min(tag) AS tag FROM vt GROUP BY 1) SELECT request_id, coalesce(tag, term) AS term, round(score, 3) AS score, tag IS NOT NULL AS known FROM w LEFT JOIN v ON low = lower(term)")
def _(t):
    wanted = t.part.select(F.col("p_partkey").alias("request_id"), F.explode(F.array(F.upper("p_name"), "p_brand", "p_type")).alias("term"), F.lit(0.12345).alias("score"))
    return req.validate_terms(wanted, tags.vocabulary(t.track_labels))


@query("x5_widened_bpm", "SELECT trackid, CASE WHEN w < 6 THEN greatest(1, bpm + w / 2 - 4) ELSE bpm END AS low, CASE WHEN w < 6 THEN bpm + w / 2 + 4 ELSE bpm + w END AS high FROM (SELECT trackid, bpm, (trackid % 12)::DOUBLE AS w FROM tracks WHERE bpm IS NOT NULL)")
def _(t):
    b = t.tracks.where("bpm is not null").select("trackid", "bpm", (F.col("trackid") % 12).cast("double").alias("w"))
    return b.select("trackid", req.widened_bpm(F.col("bpm"), F.col("bpm") + F.col("w")).alias("r")).select("trackid", F.round("r.low", 6).alias("low"), F.round("r.high", 6).alias("high"))


@query("x6_defaults", "SELECT p_partkey AS request_id, 0.7::DOUBLE AS confidence, CAST(CASE WHEN p_size % 4 = 0 THEN 5 ELSE greatest(1, p_size % 4 - 1) END AS INTEGER) AS track_count, CASE WHEN p_partkey % 6 = 1 THEN 'same' WHEN t.key IS NOT NULL THEN 'compatible' END AS key_compatibility, CASE WHEN p_partkey % 6 <> 1 THEN t.key END AS reference_key FROM part LEFT JOIN tracks t ON t.trackid = p_partkey")
def _(t):
    n = F.col("p_size") % 4
    i = t.part.select(F.col("p_partkey").alias("request_id"), F.lit(None).cast("double").alias("confidence"), F.when(n != 0, n - 1).alias("track_count"), F.when(F.col("p_partkey") % 6 == 1, "same").alias("key_compatibility"))
    return req.with_defaults(i, t.tracks.select(F.col("trackid").alias("request_id"), F.col("key").alias("context_key")))


@query("x7_suggest_similar", f"WITH {VOCABULARY}, i AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS input FROM part UNION SELECT DISTINCT p_type FROM part), v AS (SELECT tag, 0 AS kind FROM vt UNION ALL SELECT tag, 1 FROM vv) SELECT input, tag, CAST(kind AS INTEGER) AS kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY kind, tag) AS rank FROM i JOIN v ON contains(lower(input), lower(tag)) OR contains(lower(tag), lower(input))) WHERE rank <= 5")
def _(t):
    i = t.part.select(F.explode(F.split("p_name", " ")).alias("input")).unionByName(t.part.select(F.col("p_type").alias("input"))).distinct()
    return req.suggest_similar(i, tags.vocabulary(t.track_labels), tags.vocabulary(t.track_labels, "vibe"))


@query("x8_intents_from_json", "WITH j AS (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 50 <> 0 THEN json_object('tag_scores', json_object(p_brand, 0.9), 'bpm_range', [100.0, 120.0], 'track_count', p_size) END AS j FROM part) SELECT request_id, CAST(j ->> '$.track_count' AS INTEGER) AS track_count, array_to_string(json_keys(j, '$.tag_scores'), '|') AS tags FROM j")
def _(t):
    text = F.to_json(F.struct(F.create_map(F.col("p_brand"), F.lit(0.9)).alias("tag_scores"), F.array(F.lit(100.0), F.lit(120.0)).alias("bpm_range"), F.col("p_size").alias("track_count")))
    bad = F.when(F.col("p_partkey") % 50 == 0, F.lit("no json")).otherwise(text)
    return req.intents_from_json(t.part.select(F.col("p_partkey").alias("request_id"), bad.alias("json"))).select("request_id", "track_count", F.array_join(F.map_keys("tag_scores"), "|").alias("tags"))


@query("e1_precision_at_k", f"WITH n AS ({knn_sql(8, threshold=0.3)}) SELECT seed, round(avg(CASE WHEN coalesce(list_has_any(a.semantic_tags, b.semantic_tags), false) THEN 1::DOUBLE ELSE 0 END), 6) AS precision FROM n JOIN track_labels a ON a.trackid = seed LEFT JOIN track_labels b ON b.trackid = neighbour WHERE rank <= 5 AND len(a.semantic_tags) > 0 GROUP BY seed")
def _(t):
    return evaluation.precision_at_k(feat_knn(t, 8, 0.3), t.track_labels, 5)


@query("e2_tag_coherence", f"WITH n AS ({knn_sql(8, threshold=0.3)}) SELECT seed, round(avg(len(list_intersect(a.semantic_tags, coalesce(b.semantic_tags, []))) / len(list_distinct(list_concat(a.semantic_tags, coalesce(b.semantic_tags, []))))), 6) AS coherence FROM n JOIN track_labels a ON a.trackid = seed LEFT JOIN track_labels b ON b.trackid = neighbour WHERE len(a.semantic_tags) > 0 GROUP BY seed")
def _(t):
    return evaluation.tag_coherence(feat_knn(t, 8, 0.3), t.track_labels)


@query("e3_harmonic_accuracy", f"WITH n AS ({knn_sql(8, threshold=0.3)}) SELECT round(avg({harmonic_sql('a.key', 'b.key')}), 6) AS accuracy, count(*) AS n FROM n JOIN tracks a ON a.trackid = seed JOIN tracks b ON b.trackid = neighbour")
def _(t):
    return evaluation.harmonic_accuracy(feat_knn(t, 8, 0.3), t.tracks)


@query("e4_tempo_consistency", f"WITH n AS ({knn_sql(8, threshold=0.3)}), s AS (SELECT round(abs(b.bpm - a.bpm), 6) AS step FROM n JOIN tracks a ON a.trackid = seed JOIN tracks b ON b.trackid = neighbour WHERE a.bpm IS NOT NULL AND b.bpm IS NOT NULL) SELECT CAST(floor(step / 2) AS BIGINT) AS bin, count(*) AS n, (SELECT round(avg(step), 5) FROM s) AS mean_step, (SELECT round(stddev_pop(step), 5) FROM s) AS sd_step FROM s GROUP BY 1")
def _(t):
    return evaluation.tempo_consistency(feat_knn(t, 8, 0.3), t.tracks)
