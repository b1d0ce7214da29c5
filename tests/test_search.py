"""The ladder against a plain loop over requests, steps and tracks."""

import random

import numpy as np
import pytest

from segue.operators import search

SCHEMA = "request_id long, tag_scores map<string,double>, vibe_scores map<string,double>, semantic_tags array<string>, vibes array<string>, energy_low double, energy_high double, bpm_low double, bpm_high double, track_count int"


def third(x):
    return np.floor(min(1.0, x) * 1000 + 0.5) / 1000


def score(asked, tags, vibes, e, b):
    _, ts, vs, _, _, el, eh, bl, bh, _ = asked
    if not (ts or vs or el is not None or bl is not None):
        return 0.5
    out = 0.0
    for weight, wanted, own in ((0.45, ts, tags), (0.35, vs, vibes)):
        if wanted:
            low = {k.lower(): v for k, v in sorted(wanted.items(), key=lambda x: x[1])}
            out += weight * (sum(low.get(t.lower(), 0.0) for t in own or ()) / (sum(wanted.values()) or 1.0))
    if el is not None and e is not None:
        out += max(0.0, 1 - abs(e / 10 - (el + eh) / 2) / max(eh - el, 0.1)) * 0.12
    if bl is not None and b is not None:
        out += max(0.0, 1 - abs(b - (bl + bh) / 2) / max(bh - bl, 10)) * 0.08
    return third(out)


def plain(asked, labels, bpm, vectors):
    i, ts, vs, lt, lv, el, eh, bl, bh, n = asked
    n = max(1, 5 if n is None else n)

    def passing(tags, vibes, dropped):
        for t, own, vibe, e in labels:
            if tags and not set(tags) & set(own or ()) or vibes and not set(vibes) & set(vibe or ()):
                continue
            if not dropped and (el is not None and (e is None or not el <= e / 10 <= eh) or bl is not None and bpm.get(t) is not None and not bl <= bpm[t] <= bh):
                continue
            yield -score(asked, own, vibe, e, bpm.get(t)), t

    for step, a, b, dropped in search.STEPS:
        got = sorted(passing([t for t, s in ts.items() if s >= a], [v for v, s in vs.items() if s >= b], dropped))
        if len(got) >= n:
            break
    got = got[:n]
    out = [(i, t, -s, step, k + 1, False, None) for k, (s, t) in enumerate(got)]
    have, need = {t for _, t in got}, n - len(got)
    if not need:
        return out
    refs = sorted(passing(list(ts) if lt is None else lt, list(vs) if lv is None else lv, False))[:30]
    refs = [vectors[t] for _, t in refs if t not in have and vectors and t in vectors]
    if refs:
        c = np.mean(refs, axis=0)
        sims = ((t, round(float(np.dot(c, v) / np.linalg.norm(c) / np.linalg.norm(v)), 6)) for t, v in vectors.items() if t not in have)
        more, why = sorted((-s, t) for t, s in sims if s > 0.25), search.BY_CENTROID
        more = [(-round(-s, 3), t) for s, t in more]
    else:
        energy, more, why = {t: e for t, _, _, e in labels}, [], search.BY_FEATURES
        for t, b in bpm.items():
            e = energy.get(t)
            s = 0.5 + (max(0.0, 0.5 - abs(e / 10 - (el + eh) / 2)) if el is not None and e is not None else 0) + (max(0.0, 0.5 - abs(b - (bl + bh) / 2) / 30) if bl is not None and b is not None else 0)
            more += [(-third(s), t)] if t not in have else []
        more.sort()
    return out + [(i, t, -s, step, len(got) + k + 1, True, why) for k, (s, t) in enumerate(more[:need])]


@pytest.mark.parametrize("block", [(1024, 8192), (3, 7)])
@pytest.mark.parametrize("with_vectors", [True, False])
def test_ladder(spark, block, with_vectors):
    r = random.Random(4)
    words, moods = ["house", "House", "dub", "techno", "acid"], ["dark", "bright", "Warm"]
    labels = [(i, r.sample(words, r.randint(0, 3)) if i % 9 else None, [r.choice(moods)] if i % 4 else None, float(r.randint(1, 10)) if i % 5 else None) for i in range(70)]
    bpm = {i: float(r.randint(90, 150)) if i % 6 else None for i in range(90)}
    vectors = {i: [r.gauss(0.3, 1) for _ in range(4)] for i in range(90) if i % 7} if with_vectors else None
    some = lambda of: {x: r.choice([0.9, 0.5, 0.3, 0.1, 0.0]) for x in r.sample(of, r.randint(0, len(of) - 1))}
    requests = []
    for i in range(60):
        e, b = r.choice([None, 0.2]), r.choice([None, 110.0])
        lists = (["dub", "acid"], None) if i % 4 == 3 else (None, None)
        requests.append((i, some(words), some(moods), *lists, e, e and 0.6, b, b and 128.0, r.choice([1, 3, 9, 40, None])))
    requests += [(100, {"house": 0.9}, {"dark": 1.0}, None, None, None, None, None, None, 2), (101, {"house": 0.5}, {}, None, None, None, None, None, None, 4), (102, {}, {"dark": 1.0}, None, None, None, None, None, None, 3), (103, {}, {}, None, None, None, None, None, None, 3)]
    requests += [(104, {"none": 0.9}, {}, None, None, 0.2, 0.4, None, None, 5), (105, {"none": 0.9}, {}, ["dub"], [], None, None, None, None, 5), (106, {"house": 0.9}, {"dark": 0.3}, None, None, None, None, None, None, 500)]
    args = spark.createDataFrame(requests, SCHEMA), spark.createDataFrame(labels, "trackid long, semantic_tags array<string>, vibe array<string>, energy double"), spark.createDataFrame(list(bpm.items()), "trackid long, bpm double")
    feat = spark.createDataFrame(list(vectors.items()), "trackid long, feat array<double>") if vectors else None
    got = sorted(tuple(x) for x in search.relaxation_search(*args, feat, block=block).collect())
    want = sorted(x for q in requests for x in plain(q, labels, bpm, vectors))
    assert [(*x[:2], round(x[2], 3), *x[3:]) for x in got] == [(*x[:2], round(x[2], 3), *x[3:]) for x in want]
    assert {x[6] for x in got} == ({None, search.BY_CENTROID, search.BY_FEATURES} if with_vectors else {None, search.BY_FEATURES})
    assert all(sum(x[0] == q[0] for x in got) == max(1, q[-1] or 5) for q in requests if q[0] < 106 and not with_vectors)
    assert {x.request_id for x in search.relevance(*args).collect()} == {q[0] for q in requests}


def test_no_rows(spark):
    labels = spark.createDataFrame([(1, ["a"], None, None)], "trackid long, semantic_tags array<string>, vibe array<string>, energy double")
    tracks = spark.createDataFrame([(1, None)], "trackid long, bpm double")
    requests = spark.createDataFrame([(1, {"a": 0.9}, {}, None, None, None, None, None, None, 2)], SCHEMA)
    assert search.relaxation_search(requests.limit(0), labels, tracks).collect() == []
    assert search.relaxation_search(requests, labels.limit(0), tracks.limit(0)).collect() == []
    assert [x.trackid for x in search.relaxation_search(requests, labels, tracks).collect()] == [1]
    detail = search.score_detail(search.relevance(requests, labels, tracks), requests, labels).first()
    assert detail.matched_tags == {"a": 0.9} and detail.matched_vibes == {}
