"""Queries: sources and edits, cleaning, filters, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.functions import clean, keys
from segue.operators import tables as ops
from segue.plans.base import camelot_sql, harmonic_sql, keys_sql, query
from segue.sources import readers, writers

TAGS = "array_to_string(list_sort(semantic_tags), '|')"


def tags(c="semantic_tags"):
    return F.array_join(F.array_sort(c), "|")


@query("sc1_scan", "SELECT trackid, title, artist, bpm, key FROM tracks")
def _(t):
    return t.tracks.select("trackid", "title", "artist", "bpm", "key")


@query("sc8_page", "SELECT trackid, title, (SELECT count(*) FROM tracks) AS total, (SELECT count(*) FROM tracks) > 300 AS has_more FROM tracks ORDER BY trackid LIMIT 200 OFFSET 100")
def _(t):
    return ops.page(t.tracks.select("trackid", "title"), 200, 100)


@query("sc9_scan_capped", "SELECT trackid, title FROM tracks ORDER BY trackid LIMIT 2000")
def _(t):
    return ops.scan_capped(t.tracks.select("trackid", "title"))


@query("sc6_audio_files", "SELECT trackid, filepath FROM tracks WHERE lower(regexp_extract(filepath, '[.]([^./]+)$', 1)) IN ('mp3', 'wav', 'flac', 'm4a', 'aac', 'ogg')")
def _(t):
    return readers.audio_only(t.tracks, "filepath").select("trackid", "filepath")


@query("sc7_content_hashes", "WITH h AS (SELECT page_id, sha256(html) AS file_hash FROM pages) SELECT page_id, file_hash, count(*) OVER (PARTITION BY file_hash) AS copies FROM h")
def _(t):
    return readers.file_hashes(t.pages.select(F.col("page_id").alias("path"), F.col("html").cast("binary").alias("content"))).withColumnRenamed("path", "page_id")


@query("sn1_init_labels", "SELECT trackid, '' AS tags, CAST(NULL AS DOUBLE) AS energy, '' AS vibes FROM tracks WHERE trackid NOT IN (SELECT trackid FROM track_labels)")
def _(t):
    return ops.init_labels(ops.unlabeled(t.tracks, t.track_labels, "row")).select("trackid", tags().alias("tags"), "energy", tags("vibe").alias("vibes"))


@query("sn2_insert_ignore", "SELECT trackid, title FROM tracks WHERE trackid % 2 = 0 UNION ALL SELECT min(p_partkey), p_name FROM part WHERE p_partkey % 2 = 1 GROUP BY p_partkey, p_name")
def _(t):
    new = t.part.select(F.col("p_partkey").alias("trackid"), F.col("p_name").alias("title"))
    return ops.insert_ignore(t.tracks.where("trackid % 2 = 0").select("trackid", "title"), new, ["trackid"], [F.col("title")])


@query("sn3_upsert_votes", "SELECT event_id, trackid, tag, weight_delta, ts FROM (SELECT *, row_number() OVER (PARTITION BY trackid, tag ORDER BY ts DESC, event_id DESC) AS n FROM votes) WHERE n = 1")
def _(t):
    v = t.votes
    return ops.upsert(v.where("weight_delta > 0"), v.where("weight_delta <= 0"), ["trackid", "tag"], [F.desc("ts"), F.desc("event_id")])


@query("sn4_update_from", "SELECT t.trackid, coalesce(CASE WHEN l.energy > 5 THEN 100 + l.energy END, t.bpm) AS bpm FROM tracks t LEFT JOIN track_labels l USING (trackid)")
def _(t):
    new = t.track_labels.select("trackid", F.when(F.col("energy") > 5, 100 + F.col("energy")).alias("bpm"))
    return ops.update_from(t.tracks.select("trackid", "bpm"), new, "trackid", ["bpm"])


@query("sn5_position_ids", "SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, label) AS trackid FROM embeddings")
def _(t):
    return readers.with_position_id(t.embeddings.select("vec_id", "label").orderBy("vec_id", "label"))


@query("sn6_cascade_delete", "WITH gone AS (SELECT trackid FROM tracks WHERE title IS NULL) SELECT 'tracks' AS table_name, count(*) AS n FROM tracks WHERE trackid IN (FROM gone) UNION ALL SELECT 'labels', count(*) FROM track_labels WHERE trackid IN (FROM gone) UNION ALL SELECT 'votes', count(*) FROM votes WHERE trackid IN (FROM gone)")
def _(t):
    return ops.deletion_report({"tracks": t.tracks, "labels": t.track_labels, "votes": t.votes}, t.tracks.where("title is null"))


@query("sn6_cascade_rest", "SELECT event_id, trackid, tag FROM votes WHERE trackid NOT IN (SELECT trackid FROM tracks WHERE title IS NULL)")
def _(t):
    return ops.cascade_delete({"votes": t.votes}, t.tracks.where("title is null"))["votes"].select("event_id", "trackid", "tag")


CRATE_ROWS = "SELECT c.session_id, count(*) OVER w AS track_count, 4 * count(*) OVER w AS minutes, round(round(avg(bpm) OVER w, 6)) AS mean_bpm, c.position, c.trackid, title, artist, bpm, key FROM crates c JOIN tracks t USING (trackid) WINDOW w AS (PARTITION BY c.session_id)"


@query("sn7_crate_json", CRATE_ROWS)
def _(t):
    track = "STRUCT<position: LONG, trackid: LONG, title: STRING, artist: STRING, bpm: DOUBLE, key: STRING>"
    parsed = writers.crate_json(t.crates, t.tracks).select(F.from_json("json", f"session_id LONG, tracks ARRAY<{track}>, stats STRUCT<track_count: LONG, minutes: LONG, mean_bpm: DOUBLE>").alias("j"))
    return parsed.select("j.session_id", "j.stats.*", F.inline("j.tracks"))


@query("sn8_m3u", "SELECT c.session_id, concat('#EXTM3U\n', string_agg(concat('#EXTINF:240,', coalesce(artist, 'Unknown Artist'), ' - ', coalesce(title, 'Unknown Title'), chr(10), filepath), chr(10) ORDER BY position)) AS m3u FROM crates c JOIN tracks t USING (trackid) GROUP BY c.session_id")
def _(t):
    return writers.m3u(t.crates, t.tracks)


@query("sn9_merge_log", "SELECT 'merge' AS operation_type, 'blue|cold' AS sources, 'chill' AS target_tag, (SELECT count(*) FROM track_labels WHERE list_has_any(semantic_tags, ['blue', 'cold'])) AS affected_tracks")
def _(t):
    merged = t.track_labels.agg(F.count_if(F.coalesce(F.arrays_overlap("semantic_tags", F.array(F.lit("blue"), F.lit("cold"))), F.lit(False))).alias("n"))
    return writers.log_operation(t.spark, "merge", ["blue", "cold"], "chill", merged.first()["n"]).select("operation_type", F.array_join("payload.source_tags", "|").alias("sources"), "payload.target_tag", "payload.affected_tracks")


DIRTY = "(SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('[\"', role, '\", \"x\"]') WHEN 2 THEN concat(' ', role, ' ') WHEN 3 THEN '  ' ELSE '[]' END AS raw FROM conversations)"


@query("n1_tag_arrays", f"SELECT conv_id, turn, CASE WHEN raw LIKE '[%' THEN array_to_string(CAST(json(raw) AS VARCHAR[]), '|') ELSE coalesce(trim(raw), '') END AS tags FROM {DIRTY}")
def _(t):
    r, role = F.col("conv_id") % 5, F.col("role")
    raw = F.when(r == 0, F.lit(None)).when(r == 1, F.concat(F.lit('["'), role, F.lit('", "x"]'))).when(r == 2, F.concat(F.lit(" "), role, F.lit(" "))).when(r == 3, "  ").otherwise("[]")
    return t.conversations.select("conv_id", "turn", F.array_join(clean.as_tag_array(raw), "|").alias("tags"))


@query("n2_vectors_from_text", "SELECT vec_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(round(x, 3) AS DOUBLE))), 4) AS total FROM embeddings")
def _(t):
    text = F.concat(F.lit("["), F.concat_ws(",", F.transform("embedding", lambda x: F.round(x, 3).cast("string"))), F.lit("]"))
    e = t.embeddings.select("vec_id", clean.as_vector(text).alias("v"))
    return e.select("vec_id", F.size("v").cast("long").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("n3_flatten_labels", f"SELECT trackid, {TAGS} AS tags, energy, vibe[1] AS vibe_descriptor FROM track_labels")
def _(t):
    twice = t.track_labels.unionByName(t.track_labels.withColumn("energy", F.lit(99.0)))
    return ops.flatten_labels(twice, [F.coalesce("energy", F.lit(0.0))]).select("trackid", tags().alias("tags"), "energy", F.element_at("vibe_descriptors", 1).alias("vibe_descriptor"))


@query("n4_track_view", "SELECT t.trackid, coalesce(title, 'Unknown') AS title, coalesce(artist, 'Unknown') AS artist, bpm, coalesce(energy, 0.5) AS energy, coalesce(array_to_string(list_sort(semantic_tags), '|'), '') AS tags, coalesce(vibe[1], '') AS vibe, CASE WHEN t.trackid % 9 <> 4 AND embedding IS NOT NULL THEN round(embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE, 6) END AS place FROM tracks t LEFT JOIN track_labels l USING (trackid)")
def _(t):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    placed = t.tracks.withColumns({"x_coord": at(0), "y_coord": F.when(F.col("trackid") % 9 != 4, at(1)), "z_coord": at(2)})
    view = ops.track_view(placed, t.track_labels).withColumn("tags", tags("tags")).withColumn("vibe", F.array_join("vibe", "|"))
    return view.withColumn("place", F.round(F.get("position", F.lit(0)) + F.get("position", F.lit(1)) + F.get("position", F.lit(2)), 6)).drop("position")


@query("n5_crate_defaults", "SELECT t.trackid, coalesce(title, 'Unknown Title') AS title, coalesce(artist, 'Unknown Artist') AS artist, coalesce(nullif(bpm, 0), 120) AS bpm, coalesce(key, 'Unknown') AS key, coalesce(nullif(energy, 0), 0.5) AS energy FROM tracks t LEFT JOIN track_labels l USING (trackid)")
def _(t):
    return ops.crate_defaults(ops.with_labels(t.tracks, t.track_labels))


@query("n6_title_or_stem", "SELECT trackid, coalesce(title, regexp_extract(filepath, '([^/]+?)([.][^./]*)?$', 1)) AS title FROM tracks")
def _(t):
    return t.tracks.select("trackid", clean.title_or_stem(F.col("title"), F.col("filepath")).alias("title"))


@query("n7_normalised_names", "SELECT trackid, coalesce(nullif(trim(artist), ''), 'unknown artist') AS artist, nullif(trim(title), '') AS title FROM tracks")
def _(t):
    return t.tracks.select("trackid", clean.norm_artist(F.col("artist")).alias("artist"), clean.norm_title(F.col("title")).alias("title"))


@query("n8_artist_title_key", "SELECT trackid, lower(coalesce(artist, 'unknown artist') || '_' || title) AS art_key, lower(coalesce(artist, 'unknown artist') || '_' || title) AS again FROM tracks")
def _(t):
    k = t.tracks.select("trackid", clean.artist_title_key(F.col("artist"), F.col("title")).alias("art_key"))
    return k.withColumn("again", clean.renormalised_key(F.col("art_key")))


@query("n9_safe_filename", "SELECT trackid, left(trim(regexp_replace(regexp_replace(lower(concat_ws('_', artist, title)), '[^\\p{L}\\p{N}_-]', '_', 'g'), '_+', '_', 'g'), '_'), 150) AS name FROM tracks")
def _(t):
    return t.tracks.select("trackid", clean.safe_filename(F.col("artist"), F.col("title")).alias("name"))


@query("n10_safe_filename_ascii", "SELECT doc_id, left(trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(concat_ws('_', source, text)), '[^\\x00-\\x7F]', '', 'g')), '[^\\p{L}\\p{N}_-]', '_', 'g'), '_+', '_', 'g'), '_'), 150) AS name FROM documents")
def _(t):
    return t.documents.select("doc_id", clean.safe_filename_ascii(F.col("source"), F.col("text")).alias("name"))


@query("n11_first_known", "SELECT trackid, coalesce(nullif(key, ''), album) AS value FROM tracks")
def _(t):
    return t.tracks.select("trackid", clean.first_known(F.col("key"), F.col("album")).alias("value"))


@query("n12_valid_bpm", "SELECT trackid, coalesce(CASE WHEN bpm * 2 BETWEEN 40 AND 250 THEN round(bpm * 2, 2) END, CASE WHEN bpm BETWEEN 40 AND 250 THEN round(bpm, 2) END) AS bpm FROM tracks")
def _(t):
    return t.tracks.select("trackid", clean.valid_bpm(F.col("bpm") * 2, F.col("bpm")).alias("bpm"))


@query("n13_parse_tag_input", "SELECT request_id, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT trim(unnest(string_split(text, ','))) AS x) WHERE x <> '') AS tags FROM requests")
def _(t):
    return t.requests.select("request_id", F.array_join(F.array_sort(clean.parse_tag_input(F.col("text"))), "|").alias("tags"))


@query("n14_normalise_similar", "SELECT coalesce(CASE WHEN trackid % 3 = 0 THEN NULL ELSE trackid END, CASE WHEN trackid % 2 = 0 THEN trackid END) AS id, coalesce(bpm, 0.5) AS score FROM tracks WHERE trackid % 6 <> 3")
def _(t):
    shaped = t.tracks.select(F.when(F.col("trackid") % 3 != 0, F.col("trackid")).alias("id_a"), F.when(F.col("trackid") % 2 == 0, F.col("trackid")).alias("id_b"), "bpm")
    return ops.normalise_similar(shaped, ["id_a", "id_b"], "bpm")


@query("n15_track_index", "SELECT trackid, artist, concat(coalesce(artist, 'Unknown'), ' — ', coalesce(title, 'Unknown'), CASE WHEN coalesce(bpm, 0) <> 0 THEN concat('  (', CAST(round(bpm) AS BIGINT), ' BPM)') ELSE '' END) AS label FROM tracks")
def _(t):
    return ops.track_index(t.tracks)


@query("n16_dedupe_titles", "SELECT min(trackid) AS trackid, lower(trim(title)) AS title FROM tracks WHERE title IS NOT NULL AND title <> '' GROUP BY lower(trim(title))")
def _(t):
    return ops.dedupe_titles(t.tracks).select("trackid", F.lower(F.trim("title")).alias("title"))


@query("n17_camelot", f"WITH s AS (SELECT p_partkey AS trackid, (['Am', 'A minor', 'F#m', 'Gbm', 'C', 'C major', '8A', 'H', 'Ebm', 'Db major', ' B '])[1 + p_partkey % 11] AS key FROM part) SELECT trackid, key, camelot FROM s LEFT JOIN {keys_sql()} ON trim(key) = spelling")
def _(t):
    spelled = F.array(*map(F.lit, ("Am", "A minor", "F#m", "Gbm", "C", "C major", "8A", "H", "Ebm", "Db major", " B ")))
    k = t.part.select(F.col("p_partkey").alias("trackid"), F.get(spelled, (F.col("p_partkey") % 11).cast("int")).alias("key"))
    return k.withColumn("camelot", keys.to_camelot(F.col("key")))


@query("f1_bpm_between", "SELECT trackid, bpm FROM tracks WHERE bpm BETWEEN 110 AND 125")
def _(t):
    return ops.bpm_between(t.tracks, 110, 125).select("trackid", "bpm")


@query("f2_bpm_between_or_null", "SELECT trackid, bpm FROM tracks WHERE bpm IS NULL OR bpm BETWEEN 110 AND 125")
def _(t):
    return ops.bpm_between(t.tracks, 110, 125, keep_null=True).select("trackid", "bpm")


@query("f3_energy_between", "SELECT trackid, energy FROM track_labels WHERE energy BETWEEN 3 AND 7")
def _(t):
    return ops.energy_between(t.track_labels, 3, 7).select("trackid", "energy")


@query("f4_any_tag", "SELECT trackid FROM track_labels WHERE list_has_any(semantic_tags, ['blue', 'gizmo']) AND list_has_any(vibe, ['promo', 'small'])")
def _(t):
    return ops.any_tag(t.track_labels, ["blue", "gizmo"], ["promo", "small"]).select("trackid")


@query("f5_any_tag_open", "SELECT trackid FROM track_labels WHERE list_has_any(semantic_tags, ['blue', 'red'])")
def _(t):
    return ops.any_tag(t.track_labels, ["blue", "red"], []).select("trackid")


@query("f6_has_vector", "SELECT trackid FROM tracks WHERE embedding IS NOT NULL AND len(embedding) > 0")
def _(t):
    return t.tracks.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("trackid")


@query("f7_vector_faults", "SELECT trackid, CASE WHEN v IS NULL THEN 'missing' WHEN len(v) = 0 THEN 'empty' WHEN len(v) <> 64 THEN 'width' WHEN len(list_filter(v, lambda x: isnan(x))) > 0 THEN 'nan' WHEN len(list_filter(v, lambda x: isinf(x))) > 0 THEN 'inf' WHEN list_sum(list_transform(v, lambda x: abs(x))) = 0 THEN 'zero' END AS fault FROM (SELECT trackid, CASE trackid % 7 WHEN 1 THEN list_transform(embedding, lambda x: CAST('nan' AS FLOAT)) WHEN 2 THEN list_transform(embedding, lambda x: CAST('inf' AS FLOAT)) WHEN 3 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) WHEN 4 THEN embedding[1:3] WHEN 5 THEN embedding[1:0] ELSE embedding END AS v FROM tracks)")
def _(t):
    m, e = F.col("trackid") % 7, F.col("embedding")
    as_ = lambda s: F.transform(e, lambda x: F.lit(s).cast("float"))
    v = F.when(m == 1, as_("nan")).when(m == 2, as_("infinity")).when(m == 3, as_("0")).when(m == 4, F.slice(e, 1, 3)).when(m == 5, F.slice(e, 1, 0)).otherwise(e)
    return t.tracks.select("trackid", clean.vector_fault(v, 64).alias("fault"))


@query("f9_exclude", "SELECT trackid FROM tracks WHERE trackid NOT IN (SELECT trackid FROM votes)")
def _(t):
    return ops.exclude(t.tracks, t.votes).select("trackid")


@query("f10_by_ids", "SELECT session_id AS request_id, CAST(position AS INTEGER) AS pos, trackid, title FROM crates JOIN tracks USING (trackid)")
def _(t):
    asked = t.crates.select(F.col("session_id").alias("request_id"), F.col("position").cast("int").alias("pos"), "trackid")
    return ops.by_ids(t.tracks, asked).select("request_id", "pos", "trackid", "title")


@query("f11_relaxed_terms", "SELECT trackid, tag FROM (SELECT trackid, unnest(semantic_tags) AS tag, energy FROM track_labels) WHERE energy / 10 >= 0.45")
def _(t):
    from segue.operators.requests import relaxed_terms

    return relaxed_terms(t.track_labels.select("trackid", F.explode("semantic_tags").alias("tag"), (F.col("energy") / 10).alias("score")), 0.45).select("trackid", "tag")


@query("f12_semantic_search", "SELECT trackid FROM tracks JOIN track_labels USING (trackid) WHERE list_has_any(semantic_tags, ['blue', 'ring', 'rod']) AND energy BETWEEN 2 AND 8 AND bpm BETWEEN 105 AND 140 AND NOT coalesce(list_has_any(semantic_tags, ['old', 'cold']), false)")
def _(t):
    return ops.semantic_search(ops.labelled(t.tracks, t.track_labels), ["blue", "ring", "rod"], energy=(2, 8), bpm=(105, 140), without=["old", "cold"]).select("trackid")


@query("f13_key_filter", f"""WITH f AS (SELECT session_id, key AS reference FROM crates JOIN tracks USING (trackid) WHERE position = 0), m AS (SELECT session_id, reference, (['same', 'compatible', 'any', NULL])[1 + session_id % 4] AS mode FROM f)
  SELECT session_id, position, trackid, key FROM crates JOIN tracks USING (trackid) JOIN m USING (session_id)
  WHERE mode IS NULL OR mode = 'any' OR reference IS NULL OR (mode = 'same' AND {camelot_sql('key')} = {camelot_sql('reference')}) OR (mode = 'compatible' AND {harmonic_sql('key', 'reference', 'explain')} >= 0.8)""")
def _(t):
    """Each session's tracks that go with its first one, in the way that the session asks for."""
    held = t.crates.join(t.tracks.select("trackid", "key"), "trackid")
    mode = F.get(F.array(F.lit("same"), F.lit("compatible"), F.lit("any"), F.lit(None)), (F.col("session_id") % 4).cast("int"))
    asked = held.where("position = 0").select("session_id", F.col("key").alias("reference"), mode.alias("mode"))
    return held.join(asked, "session_id").where(keys.key_passes(F.col("key"), F.col("reference"), F.col("mode"))).select("session_id", "position", "trackid", "key")


@query("j1_left_join", "SELECT t.trackid, title, energy FROM tracks t LEFT JOIN track_labels l USING (trackid)")
def _(t):
    return ops.with_labels(t.tracks, t.track_labels).select("trackid", "title", "energy")


@query("j2_inner_join", "SELECT t.trackid, title, energy FROM tracks t JOIN track_labels l USING (trackid)")
def _(t):
    return ops.labelled(t.tracks, t.track_labels).select("trackid", "title", "energy")


@query("j3_labels_first", "SELECT l.trackid, l.energy, t.bpm FROM track_labels l LEFT JOIN (SELECT * FROM tracks WHERE bpm > 120) t USING (trackid)")
def _(t):
    return ops.labels_first(t.track_labels, t.tracks.where("bpm > 120")).select("trackid", "energy", "bpm")


@query("j4_without_tags", "SELECT trackid FROM tracks WHERE trackid NOT IN (SELECT trackid FROM track_labels WHERE len(semantic_tags) > 0)")
def _(t):
    return ops.unlabeled(t.tracks, t.track_labels).select("trackid")


@query("j4_without_label_row", "SELECT trackid FROM tracks WHERE trackid NOT IN (SELECT trackid FROM track_labels)")
def _(t):
    return ops.unlabeled(t.tracks, t.track_labels, "row").select("trackid")


@query("j5_semi_join", "SELECT trackid, title FROM tracks WHERE trackid IN (SELECT trackid FROM votes)")
def _(t):
    return ops.keep(t.tracks, t.votes).select("trackid", "title")


@query("j6_skip_existing", "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'failed' WHEN p_partkey % 2 = 1 THEN 'skipped' ELSE 'uploaded' END AS status, count(*) AS n FROM part GROUP BY 1")
def _(t):
    from segue.streaming.jobs import skip_existing

    paths = t.tracks.select("trackid", F.when(F.col("trackid") % 4 != 0, F.col("filepath")).alias("filepath"))
    return skip_existing(paths, t.tracks.where("trackid % 2 = 1")).groupBy("status").agg(F.count("*").alias("n"))


@query("j7_enrich_art", "WITH a AS (SELECT DISTINCT lower(p_brand || '_' || p_name) AS art_key, concat('art/', p_brand) AS art_url FROM part WHERE p_size < 25) SELECT trackid, art_url, art_url IS NOT NULL AS matched FROM tracks LEFT JOIN a ON art_key = lower(coalesce(artist, 'unknown artist') || '_' || title)")
def _(t):
    art = t.part.where("p_size < 25").select(F.lower(F.concat("p_brand", F.lit("_"), "p_name")).alias("art_key"), F.concat(F.lit("art/"), "p_brand").alias("art_url")).distinct()
    return ops.enrich_art(t.tracks, art).select("trackid", "art_url", "matched")


@query("j8_match_titles", "SELECT f.p_type AS path_type, t.trackid FROM (SELECT DISTINCT p_type, p_name FROM part) f JOIN tracks t ON t.title = f.p_name")
def _(t):
    files = t.part.select("p_type", "p_name").distinct().select(F.concat_ws("/", "p_type", F.concat("p_name", F.lit(".mp3"))).alias("path"))
    return ops.match_titles(files, t.tracks).select(F.regexp_extract("path", "^([^/]*)/", 1).alias("path_type"), "trackid")


@query("t1_top_n", "SELECT trackid, bpm FROM tracks WHERE bpm IS NOT NULL ORDER BY bpm DESC, trackid LIMIT 50")
def _(t):
    return t.tracks.where("bpm is not null").select("trackid", "bpm").orderBy(F.desc("bpm"), "trackid").limit(50)


@query("t2_top_n_per_group", "SELECT album, trackid, n FROM (SELECT album, trackid, row_number() OVER (PARTITION BY album ORDER BY bpm DESC NULLS LAST, trackid) AS n FROM tracks) WHERE n <= 10")
def _(t):
    from segue.operators.scoring import latest_n

    best = latest_n(t.tracks, "album", [F.desc_nulls_last("bpm"), F.col("trackid")], 10)
    from pyspark.sql import Window

    return best.select("album", "trackid", F.row_number().over(Window.partitionBy("album").orderBy(F.desc_nulls_last("bpm"), "trackid")).cast("long").alias("n"))


@query("t4_by_artist", "SELECT artist, trackid FROM tracks ORDER BY artist NULLS FIRST, trackid")
def _(t):
    return t.tracks.select("artist", "trackid").orderBy("artist", "trackid")


@query("u1_union_flagged", "SELECT trackid, false AS inferred FROM track_labels WHERE len(semantic_tags) > 0 UNION ALL SELECT trackid, true FROM tracks WHERE trackid NOT IN (SELECT trackid FROM track_labels)")
def _(t):
    tagged = t.track_labels.where(F.size("semantic_tags") > 0).select("trackid", F.lit(False).alias("inferred"))
    return tagged.unionByName(ops.unlabeled(t.tracks, t.track_labels, "row").select("trackid", F.lit(True).alias("inferred")))


@query("u2_tag_sets", "SELECT trackid, array_to_string(list_sort(list_intersect(semantic_tags, ['blue', 'hot', 'rod'])), '|') AS both, array_to_string(list_sort(list_filter(semantic_tags, lambda x: NOT list_contains(['blue', 'hot', 'rod'], x))), '|') AS rest, len(list_distinct(list_concat(semantic_tags, ['blue', 'hot', 'rod']))) AS n_union FROM track_labels WHERE semantic_tags IS NOT NULL")
def _(t):
    some = F.array(*map(F.lit, ("blue", "hot", "rod")))
    return t.track_labels.where("semantic_tags is not null").select("trackid", tags(F.array_intersect("semantic_tags", some)).alias("both"), tags(F.array_except("semantic_tags", some)).alias("rest"), F.size(F.array_union("semantic_tags", some)).cast("long").alias("n_union"))


@query("u3_distinct", "SELECT DISTINCT artist, album FROM tracks")
def _(t):
    return t.tracks.select("artist", "album").distinct()
