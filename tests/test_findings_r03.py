"""What the third round's findings asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.functions import scores
from segue.operators import blocks, hybrid, spreading, vectors
from segue.plans import registry
from segue.store import scratch

SF = "/root/testdata/sf0.001"


def test_saved_crates_carry_their_scores(spark):
    saved = {r.session_id: r for r in registry.queries()["sn10_save_crates"](spark, SF).collect()}
    told = {r.session_id: r.overall_score for r in registry.queries()["q3_validate_sequence"](spark, SF).collect()}
    assert saved.keys() == told.keys()
    assert {r.saved_at for r in saved.values()} == {2}
    assert {k: r.overall for k, r in saved.items()} == pytest.approx(told)


def test_seed_labels_list_every_tagged_track(spark):
    labels = spark.createDataFrame([(1, ["a", "x"]), (2, ["b"]), (3, []), (4, None)], "trackid long, semantic_tags array<string>")
    votes = spark.createDataFrame([(1, 2, "a", 2.0, 1), (2, 4, "a", -1.5, 1), (3, 1, "b", 0.0, 1)], "event_id long, trackid long, tag string, weight_delta double, ts long")
    tags, tracks = spark.createDataFrame([("a",), ("b",)], "tag string"), spark.createDataFrame([(i,) for i in range(1, 5)], "trackid long")
    got = sorted(tuple(r) for r in spreading.seed_labels(labels, votes, tags, tracks).collect())
    assert got == [("a", 1, 1), ("a", 2, 1), ("a", 4, 0), ("b", 1, 0), ("b", 2, 1)]


def test_dealt_vectors_grow_with_the_rows():
    for cores in (6, 12, 200):
        small, large = (blocks.cut(n, n, cores, 65536) for n in (100_000, 600_000))
        assert sum(small) == sum(large) and small[0] * small[1] >= cores
    assert blocks.cut(30, 600_000, 12, 65536) == (1, 24)
    assert blocks.cut(0, 0, 12, 65536) == (1, 1)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("threshold", [None, 0.2])
def test_tiles_keep_the_best(ties, same, threshold):
    r = np.random.default_rng(1)
    ids, units = np.sort(r.choice(900, 300, replace=False)), r.integers(-2, 3, (300, 3)) + 0.1  # many are equal
    units /= np.linalg.norm(units, axis=1)[:, None]
    sims = np.round(units @ units.T, 6) + 0.0
    for k in (1, 7, 40):
        asking = vectors._Asking(ids[:90], units[:90], k, threshold, same, ties)
        for at in range(0, 300, 47):
            asking.meet(ids[at : at + 47], units[at : at + 47], at)
        rows, got, places = asking.best
        for i in range(90):
            want = sorted((-s, j) for j, s in enumerate(sims[i].tolist()) if (same or j != i) and (threshold is None or s > threshold))
            want = [x for x in want if not ties or x[0] <= want[:k][-1][0]][: None if ties else k]
            assert list(zip((-got[rows == i]).tolist(), places[rows == i].tolist(), strict=True)) == want


def test_highest_scores_equal_ones_by_place():
    r = np.random.default_rng(2)
    for size in (0, 3, 40, 5000):
        score = np.round(r.random(size), 2)
        for n in (1, 5, 60):
            for at in (None, np.flatnonzero(r.random(size) < 0.5)):
                places = np.arange(size) if at is None else at
                want = places[np.lexsort((places, -score[places]))][:n]
                assert blocks.highest(score, at, n).tolist() == sorted(want.tolist())


def test_equal_requests_are_asked_once(spark):
    asking = spark.createDataFrame([(i, (["a"] if i % 2 else [], None, float(i % 3))) for i in range(30)], "id long, asked struct<tags array<string>, low double, n double>")
    with scratch(spark):
        firsts, members = blocks.distinct(asking)
        assert sorted(x.id for x in firsts.collect()) == [0, 1, 2, 3, 4, 5]
        assert {x.request_id: x.first for x in members.collect()} == {i: i % 6 for i in range(30)}


def test_equal_wishes_leave_each_its_own_track_out(spark):
    requests = spark.createDataFrame([(i, None, ["a"], None, None, None) for i in range(6)], "request_id long, vector array<double>, tags array<string>, vibes array<string>, energy_low double, energy_high double")
    labels = spark.createDataFrame([(i, ["a"], None, None) for i in range(6)], "trackid long, semantic_tags array<string>, vibe array<string>, energy double")
    none = spark.createDataFrame([], "trackid long, feat array<double>")
    got = sorted((x.request_id, x.rank, x.trackid) for x in hybrid.hybrid_search(requests, labels.select("trackid"), labels, none, 2).collect())
    assert got == [(i, k + 1, t) for i in range(6) for k, t in enumerate([t for t in range(6) if t != i][:2])]


@pytest.mark.parametrize("ties", [False, True])
def test_products_of_single_precision_lose_nothing(ties):
    r = np.random.default_rng(3)
    units = r.standard_normal((700, 64))
    units[100:400] = units[7] + r.standard_normal((300, 64)) * 1e-6  # nearer to each other than single precision tells
    units[400:600] = units[9]
    units /= np.linalg.norm(units, axis=1)[:, None]
    ids, sims = np.arange(700), np.round(units @ units.T, 6) + 0.0
    asking = vectors._Asking(ids, units, 5, None, False, ties)
    for at in range(0, 700, 96):
        asking.meet(ids[at : at + 96], units[at : at + 96], at)
    rows, got, places = asking.best
    for i in range(700):
        want = sorted((-s, j) for j, s in enumerate(sims[i].tolist()) if j != i)
        want = [x for x in want if x[0] <= want[4][0]] if ties else want[:5]
        assert list(zip((-got[rows == i]).tolist(), places[rows == i].tolist(), strict=True)) == want


def test_the_length_of_a_vector_is_worked_out_once(spark):
    assert str(scores.unit(F.col("v"))).lower().count("sqrt(") == 1
    v = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])]
    told = spark.createDataFrame(v, "i long, v array<double>").select("i", scores.unit(F.col("v")).alias("u"))
    assert {x.i: x.u for x in told.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: []}


def test_each_pair_of_blocks_is_a_partition(spark):
    units = spark.range(4096).select("id", F.array(F.lit(1.0)).alias("unit"))
    places = blocks.streamed(units, units, 65536).groupBy(F.spark_partition_id().alias("at")).agg(F.count_distinct("a", "b").alias("n")).collect()
    assert len(places) == 16 and {x.n for x in places} == {1}


def test_tag_quality_reads_its_tables_once(spark):
    quality = registry.queries()["c10_tag_quality"](spark, SF)
    assert quality.inputFiles() and not any("part.parquet" in f or "embeddings.parquet" in f for f in quality.inputFiles())
