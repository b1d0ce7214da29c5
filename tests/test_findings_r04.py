"""What the fourth round's findings asked for."""

import json

import numpy as np
import pyarrow as pa

from segue.operators import blocks, hybrid, search
from segue.store import scratch

ASKED = "request_id long, tag_scores map<string,double>, vibe_scores map<string,double>, energy_low double, energy_high double, bpm_low double, bpm_high double, track_count int"


def test_requests_for_more_or_fewer_tracks_are_asked_once(spark):
    requests = spark.createDataFrame([(i, {"a": 0.9, "b": 0.5}, {}, None, None, None, None, 1 + i % 7) for i in range(30)], ASKED)
    labels = spark.createDataFrame([(i, ["a"] if i % 3 else ["a", "b"], None, None) for i in range(20)], "trackid long, semantic_tags array<string>, vibe array<string>, energy double")
    tracks = labels.selectExpr("trackid", "cast(null as double) bpm")
    with scratch(spark):
        firsts, members = blocks.distinct(search._asked(requests))
        assert firsts.count() == 1 and sorted((x.request_id, x.first, x.track_count) for x in members.collect()) == [(i, 0, 1 + i % 7) for i in range(30)]
    best = sorted(range(20), key=lambda i: (i % 3 != 0, i))
    for df in (search.relevance(requests, labels, tracks), search.relaxation_search(requests, labels, tracks)):
        got = {}
        for x in df.orderBy("request_id", "rank").collect():
            got.setdefault(x.request_id, []).append(x.trackid)
        assert got.keys() == set(range(30)) and all(got[i] == best[: 1 + i % 7] for i in got)


def block_of(rows):
    own = pa.array([{"terms": json.dumps({"tags": t, "vibes": v}), "energy": e, "bpm": b} for _, t, v, e, b in rows], pa.struct([("terms", pa.string()), ("energy", pa.float64()), ("bpm", pa.float64())]))
    return search._Block([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), own], names=["id", "own"])])


def test_only_tracks_that_may_be_among_the_best_are_scored(monkeypatch):
    r = np.random.default_rng(5)
    words, moods = ["a", "A", "b", "c", "d"], ["x", "y"]
    pick = lambda of, n: [str(x) for x in r.choice(of, n, replace=False)]
    rows = [(i, pick(words, r.integers(0, 4)) if i % 9 else None, pick(moods, 1) if i % 4 else None, r.integers(1, 11) / 10 if i % 5 else None, float(r.integers(90, 150)) if i % 6 else None) for i in r.permutation(4000).tolist()]
    block = block_of(rows)
    looked, whole = [], search._Block.scored

    def scored(*args):
        out = whole(*args)
        looked.append(len(out[0]))
        return out

    monkeypatch.setattr(search._Block, "scored", scored)
    seen = 0
    for n in (1, 8, 60, 5000):
        for tags, vibes in (({}, {}), ({"a": 0.9, "b": 0.5, "C": 0.3}, {"x": 1.0}), ({"a": 0.5}, {}), ({}, {"y": 0.3}), ({"none": 1.0}, {})):
            for energy, bpm in ((None, None), ((0.2, 0.6), None), (None, (100.0, 120.0)), ((0.2, 0.6), (100.0, 120.0))):
                asked = {"tags": tags, "vibes": vibes, "all_tags": list(tags), "all_vibes": list(vibes)}
                asked |= dict(zip(search.RANGES, (*(energy or (None, None)), *(bpm or (None, None))), strict=True))

                def score(t, v, e, b):
                    if not (tags or vibes or energy or bpm):
                        return 0.5
                    out = 0.0
                    for weight, wanted, own in ((0.45, tags, t), (0.35, vibes, v)):
                        if wanted:
                            out += weight * (sum(s * [x.lower() for x in own or ()].count(w.lower()) for w, s in sorted(wanted.items(), key=lambda x: (x[1], x[0]))) / sum(wanted.values()))
                    for at, rng, least, weight in ((e, energy, 0.1, 0.12), (b, bpm, 10.0, 0.08)):
                        if rng and at is not None:
                            out += max(0.0, 1 - abs(at - sum(rng) / 2) / max(rng[1] - rng[0], least)) * weight
                    return np.floor(min(1.0, out) * 1000 + 0.5) / 1000

                counts = block.counts(asked)
                for step in range(search.ALL + 1):
                    ts, vs, all_ = search._step(asked, step)
                    passing = [
                        (-score(t, v, e, b), i) for i, t, v, e, b in rows
                        if (not ts or set(ts) & set(t or ())) and (not vs or set(vs) & set(v or ()))
                        and (all_ or ((not energy or (e is not None and energy[0] <= e <= energy[1])) and (not bpm or b is None or bpm[0] <= b <= bpm[1])))
                    ]
                    assert step >= len(counts) or counts[step] == len(passing)
                    looked.clear()
                    ids, got = block.best(block.passing(ts, vs), block.shares(asked), block.ranges(asked), all_, n)
                    assert list(zip((-got).tolist(), ids.tolist(), strict=True)) == sorted(passing)[:n]
                    seen += len(tags) == 3 and n == 8 and step == search.ALL and sum(looked) < len(rows) / 4
    assert seen == 4


def broadcasts(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_members_are_not_broadcast(spark):
    from segue.plans.base import Tables
    from segue.plans.music import tag_members

    t = Tables(spark, "/root/testdata/sf0.001")
    assert broadcasts(t.feat) == 0 and broadcasts(tag_members(t)) == 0


def test_fewer_tracks_are_the_first_of_more(spark):
    requests = spark.createDataFrame([(i, {"none": 0.9}, {}, ["a"], None, None, None, None, 1 + 3 * i) for i in range(4)], ASKED.replace("energy_low", "semantic_tags array<string>, energy_low"))
    labels = spark.createDataFrame([(i, ["a"] if i < 5 else ["b"], None, None) for i in range(30)], "trackid long, semantic_tags array<string>, vibe array<string>, energy double")
    feat = spark.createDataFrame([(i, [1.0, i / 40]) for i in range(30)], "trackid long, feat array<double>")
    got = {}
    for x in search.relaxation_search(requests, labels, labels.selectExpr("trackid", "cast(null as double) bpm"), feat).orderBy("request_id", "rank").collect():
        assert x.inferred and x.reason == search.BY_CENTROID
        got.setdefault(x.request_id, []).append((x.trackid, x.rank))
    assert [len(got[i]) for i in range(4)] == [1, 4, 7, 10] and all(got[i] == got[3][: 1 + 3 * i] for i in got)
    assert sorted(t for t, _ in got[3]) == list(range(10))


def test_answers_are_not_broadcast(spark):
    members = spark.createDataFrame([(i, i % 3) for i in range(9)], "request_id long, first long")
    answers = spark.createDataFrame([(i, i) for i in range(3)], "request_id long, trackid long")
    told = blocks.told(answers, members)
    assert broadcasts(told) == 0 and told.count() == 9


def test_hybrid_search_is_that_of_all_tracks(spark):
    r = np.random.default_rng(8)
    pick = lambda of: [str(x) for x in r.choice(of, r.integers(0, min(3, len(of) + 1)), replace=False)]
    vectors = {i: r.normal(size=3) for i in range(80) if i % 3}
    labels = {i: (pick(["a", "b", "c"]), pick(["x", "y"]), float(r.integers(1, 11)) if i % 4 else None) for i in range(90) if i % 7}
    requests = [(200 + i, r.normal(size=3) if i % 4 else None, pick(["a", "b"]), pick(["x"]), *((0.2, 0.6) if i % 3 == 0 else (None, None))) for i in range(24)]
    feat = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "trackid long, feat array<double>")
    own = spark.createDataFrame([(i, *x) for i, x in labels.items()], "trackid long, semantic_tags array<string>, vibe array<string>, energy double")
    asked = spark.createDataFrame([(i, None if v is None else v.tolist(), *x) for i, v, *x in requests], "request_id long, vector array<double>, tags array<string>, vibes array<string>, energy_low double, energy_high double")
    for threshold in (0.3, -0.2):
        want = []
        for id_, v, tags, vibes, low, high in requests:
            best = []
            for t in range(100):
                sim = 0.0 if v is None or t not in vectors else round(float(v @ vectors[t] / np.linalg.norm(v) / np.linalg.norm(vectors[t])), 6)
                sem = None
                if t in labels and (tags or vibes or low is not None):
                    g, m, e = labels[t]
                    if (not tags or set(tags) & set(g)) and (not vibes or set(vibes) & set(m)) and (low is None or (e is not None and low <= e / 10 <= high)):
                        sem = sum(w * len(set(q) & set(o)) / len(q) for w, q, o in ((0.4, tags, g), (0.3, vibes, m)) if q) + (0.3 * max(0.0, 1 - 2 * abs(e / 10 - (low + high) / 2)) if low is not None else 0)
                if sim > threshold or sem is not None:
                    score = (0.6 * sim if sim > threshold else 0) + (0.4 * round(min(1.0, sem), 6) if sem is not None else 0)
                    best.append((-round(score, 6), t, hybrid.KINDS[2 if sim > threshold and sem is not None else sem is not None]))
            want += [(id_, t, -s, kind, k + 1) for k, (s, t, kind) in enumerate(sorted(best)[:6])]
        for block in ((64, 512), (5, 9)):
            got = sorted(tuple(x) for x in hybrid.hybrid_search(asked, spark.range(100).withColumnRenamed("id", "trackid"), own, feat, 6, threshold, block=block).collect())
            assert [(a, t, round(s, 5), k, n) for a, t, s, k, n in got] == [(a, t, round(s, 5), k, n) for a, t, s, k, n in sorted(want, key=lambda x: (x[0], x[1]))]
