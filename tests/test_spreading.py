"""Spreading against a plain loop over matrices, tag by tag."""

import random

import numpy as np
import pytest

from segue.operators import spreading


def plain(ids, near, labels, alpha, rounds, tolerance):
    """Probabilities of class 1, by full matrices and one tag's labels (1, 0 or -1)."""
    at = {t: i for i, t in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, other in near:
        a[at[s], at[other]] = 1
    w = np.sqrt(np.where(a.sum(0) == 0, 1, a.sum(0)))
    m = a / w[:, None] / w[None, :]
    y = np.array([[labels[t] == 0, labels[t] == 1] for t in ids], float)
    f, before = y.copy(), np.zeros_like(y)
    for _ in range(rounds):
        if np.abs(f - before).sum() < tolerance:
            break
        before, f = f, alpha * m @ f + (1 - alpha) * y
    total = f.sum(1, keepdims=True)
    p = np.divide(f, total, out=np.zeros_like(f), where=total > 0)
    votes = (a + np.eye(len(ids))) @ p
    return {t: votes[i, 1] / votes[i].sum() for t, i in at.items() if votes[i].sum() > 0}


@pytest.mark.parametrize(("alpha", "rounds", "tolerance"), [(0.2, 30, 1e-3), (0.9, 4, 1e-3), (0.6, 30, 1e-1)])
def test_many_tags(spark, alpha, rounds, tolerance):
    r = random.Random(7)
    ids = list(range(60))
    near = [(s, n) for s in ids[:55] for n in r.sample([x for x in ids[:50] if x != s], 3)]
    ids = sorted({s for s, _ in near})
    tagged = [i for i in range(60) if i % 3 == 0]
    seeds = {("a", 0): 1, ("a", 3): 1, ("a", 7): 0, ("b", 9): 1, ("b", 12): 0, ("c", 5): 0, ("d", 58): 1, ("e", 4): 1, ("e", 6): 1, ("e", 1): 0}
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = spreading.label_spread(df(near, "seed long, neighbour long"), df([(*k, v) for k, v in seeds.items()], "tag string, trackid long, label int"), df([(i,) for i in tagged], "trackid long"), alpha, rounds, tolerance)
    have = {(x.tag, x.trackid): x.probability for x in got.collect()}
    want = {}
    for tag in "abe":
        labels = {i: seeds.get((tag, i), 0 if i in tagged else -1) for i in ids}
        want |= {(tag, i): round(p, 6) for i, p in plain(ids, near, labels, alpha, rounds, tolerance).items() if labels[i] != 1 and round(p, 6) > 0}
    assert have.keys() == want.keys()
    assert have == pytest.approx(want, abs=2e-6)


def test_two_islands(spark):
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b and (a < 3) == (b < 3)], "seed long, neighbour long")
    seeds = spark.createDataFrame([("x", 0, 1), ("x", 3, 0)], "tag string, trackid long, label int")
    none = spark.createDataFrame([], "trackid long")
    assert {x.trackid: x.probability for x in spreading.label_spread(edges, seeds, none).collect()} == {1: 1.0, 2: 1.0}
    assert spreading.label_spread(edges, seeds.limit(0), none).collect() == []
