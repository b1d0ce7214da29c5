"""Formulas on small rows worked out by hand, and properties."""

import pytest
from pyspark.sql import functions as F

from segue.functions import clean, keys, scores
from segue.operators import graphs, requests as req, scoring, sequences, tables, tags, vectors
from segue.sources import readers, writers


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[1] for r in sorted(df.select("i", column.alias("x")).collect())]


def test_camelot(spark):
    spelled = ["12A", "1B", "Am", "A minor", "F#m", "Gbm", "C", "C major", "13A", "H", None, "Ebm", " Bb "]
    assert values(spark, spelled, "k string", keys.to_camelot(F.col("k"))) == ["12A", "1B", "8A", "8A", "11A", "11A", "8B", "8B", None, None, None, "2A", "6B"]


@pytest.mark.parametrize(("profile", "want"), [("engine", [1.0, 0.8, 0.8, 0.1, 0.1, 0.1, 0.5]), ("readme", [1.0, 0.9, 0.8, 0.7, 0.5, 0.1, 0.5]), ("searcher", [1.5, 1.2, 1.2, 0.3, 0.3, 0.3, 0.0]), ("explain", [1.0, 0.8, 0.8, 0.2, 0.2, 0.2, None])])
def test_harmonic(spark, profile, want):
    pairs = [("8A", "8A"), ("8A", "8B"), ("12A", "1A"), ("12A", "1B"), ("1A", "11A"), ("1A", "6A"), ("1A", None)]
    assert values(spark, pairs, "a string, b string", keys.harmonic(F.col("a"), F.col("b"), profile)) == want
    assert values(spark, [("Am", "Am"), ("Am", "8A")], "a string, b string", keys.compatible(F.col("a"), F.col("b"))) == [True, False]
    spelled = [("Am", "8A"), ("Am", "C major"), ("H", "8A"), ("H", "H"), ("13A", "13A"), ("", "8A")]
    same, relative, *_, other, missing = want
    meant = [same, relative, missing, missing, missing, missing] if profile in keys.SPELLED else [other, other, other, same, same, missing]
    assert values(spark, spelled, "a string, b string", keys.harmonic(F.col("a"), F.col("b"), profile)) == meant


def test_bpm(spark):
    bpm = [None, 0.0, 39.99, 40.0, 128.005, 250.0, 250.01]
    assert values(spark, bpm, "b double", clean.valid_bpm(F.col("b"), F.lit(100.0))) == [100.0, 100.0, 100.0, 40.0, 128.01, 250.0, 100.0]
    assert values(spark, [(None, 1.0), (0.0, 120.0), (120.0, 124.0), (120.0, 128.0), (120.0, 140.0)], "a double, b double", scores.bpm_factor(F.col("a"), F.col("b"))) == [1.0, 1.0, 0.5, 0.0, 0.0]
    df = spark.createDataFrame([(b,) for b in bpm], "bpm double")
    assert tables.bpm_between(df, 40, 250).count() == 3 and tables.bpm_between(df, 40, 250, keep_null=True).count() == 4
    compat = scores.bpm_compat(F.col("b"), F.lit(100.0), F.lit(110.0), F.lit(None))
    assert values(spark, [None, 105.0, 115.0, 130.0], "b double", compat) == [0.5, 1.0, 0.5, 0.0]


@pytest.mark.parametrize(
    ("way", "want"),
    [("build", [0.2, 0.2, 0.2, 0.2, 0.2, 0.7, 1.0, 1.0, 1.0, 1.0, 0.7]), ("breakdown", [0.7, 1.0, 1.0, 0.7, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.2]), ("maintain", [0.18, 0.2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.6, 0.4, 0.38]), ("bridge", [0.5, 0.5, 0.8, 0.8, 0.8, 0.8, 0.8, 0.8, 0.8, 0.5, 0.5]), ("sideways", [0.5] * 11), (None, [0.18, 0.2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.6, 0.4, 0.38])],
)
def test_energy_flow(spark, way, want):
    steps = [-0.41, -0.4, -0.1, -0.09, 0.0, 0.09, 0.1, 0.15, 0.2, 0.3, 0.31]
    got = values(spark, [0.5 + d for d in steps], "e double", scores.energy_flow(F.col("e"), F.lit(0.5), F.lit(way)))
    assert [round(x, 6) for x in got] == want


def test_vectors(spark):
    rows = [None, [], [1.0], [float("nan"), 1.0], [float("-inf"), 1.0], [0.0, 0.0], [3.0, 4.0]]
    assert values(spark, rows, "v array<double>", clean.vector_fault(F.col("v"), 2)) == ["missing", "empty", "width", "nan", "inf", "zero", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "trackid long, embedding array<double>")
    assert [tuple(r) for r in vectors.unit_vectors(df).collect()] == [(2, [1.0]), (6, [0.6, 0.8])]
    assert values(spark, [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>", F.round(scores.cosine(F.col("a"), F.col("b")), 9)) == [0.0, 1.0, 0.0]


def test_blocks_do_not_change_neighbours(spark):
    df = spark.createDataFrame([(i, [float((i * 7 + j * j) % 11 - 5) for j in range(4)]) for i in range(90)], "trackid long, embedding array<double>")
    one, many = ({tuple(r) for r in vectors.knn(df, 5, block=b).collect()} for b in (2048, 13))
    assert one == many and len(one) == 450
    assert {r.seed for r in vectors.knn(df, 5, df.where("trackid < 3"), block=13).collect()} == {0, 1, 2}


def test_dirty_tags_and_names(spark):
    raw = [None, "[]", '["a","b"]', "a", " ", '{"x":1}']
    assert values(spark, raw, "t string", clean.as_tag_array(F.col("t"))) == [[], [], ["a", "b"], ["a"], [], ['{"x":1}']]
    assert values(spark, [("Unknown", "/x/my song.v2.mp3"), (None, "noext"), ("T", "/a.b")], "t string, p string", clean.title_or_stem(F.col("t"), F.col("p"))) == ["my song.v2", "noext", "T"]
    assert values(spark, [("Beyoncé!", "Déjà  Vu (live)")], "a string, t string", clean.safe_filename(F.col("a"), F.col("t"))) == ["beyoncé_déjà_vu_live"]
    assert values(spark, [("Beyoncé!", "Déjà  Vu (live)")], "a string, t string", clean.safe_filename_ascii(F.col("a"), F.col("t"))) == ["beyonce_deja_vu_live"]
    assert values(spark, [" a, b ,,a "], "t string", clean.parse_tag_input(F.col("t"))) == [["a", "b"]]


def test_requests(spark):
    assert values(spark, ["6 upbeat tracks", "0 songs", "slow tunes", "12 results please", "3 deep house tracks", None], "t string", req.track_count(F.col("t"))) == [6, 1, 5, 12, 3, 5]
    got = values(spark, ["peak low", "slow tunes", "nothing", "PEAK time"], "t string", req.energy_range(F.col("t")))
    assert [g and (g.low, g.high) for g in got] == [(0.0, 0.3), (0.0, 0.3), None, (0.8, 1.0)]
    wide = values(spark, [(120.0, 122.0), (120.0, 126.0), (1.0, 2.0)], "a double, b double", req.widened_bpm(F.col("a"), F.col("b")))
    assert [(w.low, w.high) for w in wide] == [(117.0, 125.0), (120.0, 126.0), (1.0, 5.5)]


def test_merge_and_upsert(spark):
    labels = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, None)], "trackid long, semantic_tags array<string>")
    got = {r.trackid: (r.affected, r.semantic_tags) for r in tags.merge_tags(labels, ["a"], "b").collect()}
    assert got == {1: (True, ["b"]), 2: (False, ["c"]), 3: (False, None)}
    assert tags.merge_tags(labels, ["a", "b"], "b").where("trackid = 1").first().semantic_tags == []  # the target is a source too
    base = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, ts int")
    once = tables.upsert(base, spark.createDataFrame([(2, "z", 2), (3, "w", 2)], base.schema), ["k"], [F.desc("ts")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert(once, once, ["k"], [F.desc("ts")]).collect())) == [(1, "x", 1), (2, "z", 2), (3, "w", 2)]


def test_sums_equal_pairs(spark):
    from itertools import combinations

    import numpy as np

    r = np.random.default_rng(1)
    of = spark.createDataFrame([("t", i, v, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in enumerate(r.normal(size=(9, 3)).tolist())], "tag string, trackid long, raw array<double>, unit array<double>")
    u = {x.trackid: np.array(x.unit) for x in of.collect()}
    assert tags.intra_similarity(of).first().intra == pytest.approx(np.mean([u[a] @ u[b] for a, b in combinations(u, 2)]), abs=1e-6)
    mean = {i: np.mean([u[i] @ u[j] for j in u if j != i]) for i in u}
    assert tags.centroid_medoid(of).first().trackid == max(mean, key=mean.get)
    assert tags.centroid_multi(of).count() == 3


def test_sequences(spark):
    tracks = spark.createDataFrame([(1, 120.0, "8A"), (2, 131.0, "8A"), (3, 150.0, "2A"), (4, None, None)], "trackid long, bpm double, key string")
    crates = spark.createDataFrame([("s", i, k) for i, k in enumerate([1, 2, 3, 4])] + [("one", 0, 1)], "session_id string, position int, trackid long")
    issues = sorted(tuple(r) for r in sequences.sequence_issues(sequences.transitions(crates, tracks)).collect())
    tempo, clash = "bpm_incompatibility", "harmonic_clash"
    assert issues == [("s", tempo, 0, "medium", "BPM jump: 120.0 → 131.0"), ("s", tempo, 1, "high", "BPM jump: 131.0 → 150.0"), ("s", tempo, 2, "high", "BPM jump: 150.0 → None"), ("s", clash, 1, "medium", "Key clash: 8A → 2A")]
    reports = {r.session_id: r for r in sequences.validate_sequence(crates, tracks).collect()}
    one, many = reports["one"], reports["s"]
    assert (one.overall_score, one.is_mixable, one.issues, one.transition_scores) == (0.0, True, [], [])
    assert not many.is_mixable and [(x.type, x.position) for x in many.issues] == [(tempo, 0), (tempo, 1), (clash, 1), (tempo, 2)] and len(many.transition_scores) == 3
    moved = {r.trackid: r.position for r in sequences.move_track(crates.where("session_id = 's'"), 3, 1).collect()}
    assert moved == {1: 0, 4: 1, 2: 2, 3: 3}


def test_pathways(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 4, 0.5), (4, 3, 0.5), (3, 5, 0.7), (2, 1, 0.9)], "seed long, neighbour long, sim double")
    pairs = spark.createDataFrame([(1, 3), (1, 5), (5, 1), (1, 1), (1, 77)], "source long, target long")
    assert sorted((r.source, r.target, r.hops, r.path) for r in graphs.pathways(edges, pairs).collect()) == [(1, 3, 2, "1>2>3"), (1, 5, 3, "1>2>3>5")]


def test_pathways_of_many_targets(spark):
    """Against all simple paths."""
    import random

    r = random.Random(6)
    near = {s: {n: r.choice([0.3, 0.5, 0.7, 0.9]) for n in r.sample(range(40), 2)} for s in range(36)}
    edges = [(s, n, x) for s, row in near.items() for n, x in row.items() if n != s]
    pairs = [(s, t) for s in range(0, 40, 5) for t in range(41)]
    want = []
    for s, t in pairs:
        paths, found = [((s,), 0.0)], None
        for hop in range(1, 5):
            paths = [((*p, n), x + y) for p, x in paths for a, n, y in edges if a == p[-1] and n not in p]
            hits = sorted((round(-x, 6), p) for p, x in paths if p[-1] == t)
            if hits and s != t:
                found = (s, t, hop, round(-hits[0][0] / hop, 9), ">".join(map(str, hits[0][1])))
                break
        want += [found] if found else []
    df = graphs.pathways(spark.createDataFrame(edges, "seed long, neighbour long, sim double"), spark.createDataFrame(pairs, "source long, target long"))
    assert sorted(tuple(x) for x in df.collect()) == sorted(want) and len(want) > 30


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿trackid,filepath,title,artist,album,bpm,key\n4,/m/a.mp3,\"Up, Down\",Mr. D',,144.37,F#\n12,/m/b.mp3,,,,,\n".encode())
    rows = [tuple(r) for r in readers.read_tracks_csv(spark, f"{tmp_path}/t.csv").collect()]
    assert rows == [(4, "/m/a.mp3", "Up, Down", "Mr. D'", None, 144.37, "F#"), (12, "/m/b.mp3", None, None, None, None, None)]
    (tmp_path / "lib.xml").write_text('<C><TRACK Name="A" Artist="" Tonality="8A" AverageBpm="120.5"/><TRACK Name="" Artist=""/><TRACK Artist="B"/></C>')
    assert {tuple(r) for r in readers.read_library_xml(spark, f"{tmp_path}/lib.xml").collect()} == {("A", None, "8A", "120.5"), (None, "B", None, None)}
    for name, data in (("x/a.MP3", b"1"), ("x/y/b.flac", b"1"), ("x/c.txt", b"1")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = readers.discover_files(spark, f"{tmp_path}/x")
    assert found.count() == 2 and {r.copies for r in readers.file_hashes(found).collect()} == {2}
    ids = readers.with_position_id(spark.createDataFrame([(c,) for c in "abcd"], "v string").repartition(1))
    assert sorted(r.trackid for r in ids.collect()) == [1, 2, 3, 4]
    tracks = spark.createDataFrame([(1, "A", "T", "/p.mp3", None), (2, None, None, "/q.mp3", 99)], "trackid long, artist string, title string, filepath string, duration int")
    crates = spark.createDataFrame([(7, 1, 1), (7, 0, 2)], "session_id long, position int, trackid long")
    assert writers.m3u(crates, tracks).first().m3u == "#EXTM3U\n#EXTINF:99,Unknown Artist - Unknown Title\n/q.mp3\n#EXTINF:240,A - T\n/p.mp3"


def test_predicted_energy_needs_weight(spark):
    labels = spark.createDataFrame([(1, ["x"], None, 4.0), (2, [], [], 8.0), (3, ["y"], None, None), (4, None, ["z"], 6.0)], "trackid long, semantic_tags array<string>, vibe array<string>, energy double")
    near = [("sum", 1, 0.5), ("sum", 2, 0.5), ("cancel", 1, 0.4), ("cancel", 4, -0.4), ("below", 1, -0.5), ("below", 2, 0.2), ("untagged", 2, 0.9), ("no energy", 3, 0.9)]
    knn = spark.createDataFrame(near, "seed string, neighbour long, sim double")
    assert {r.seed: r.energy for r in tags.predict_energy(knn, labels).collect()} == {"sum": 6.0, "cancel": None, "below": None, "untagged": None, "no energy": None}


def test_artist_edges_across_ranges(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"a{i % 2}") for i in range(40)], "trackid long, artist string")
    one, many = ({tuple(r) for r in sequences.artist_edges(df, n).collect()} for n in (1000, 7))
    assert one == many and len(one) == 40 - 3


def test_ingest_counts_rows_without_a_path(spark):
    from segue.streaming.jobs import skip_existing

    files = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "trackid long, filepath string")
    got = skip_existing(files, spark.createDataFrame([(9, "b")], "trackid long, filepath string"))
    assert sorted((r.trackid, r.status) for r in got.collect()) == [(1, "failed"), (2, "failed"), (3, "uploaded"), (4, "skipped"), (5, "skipped")]


def test_discover_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/x.MP3", "a/b/y.flac", "z.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = readers.discover_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["x.MP3", "y.flac"]
    assert {r.copies for r in readers.file_hashes(found).collect()} == {2}
