"""Several medoids for tags of every size."""

import numpy as np

from segue.operators import tags


def test_every_tag_has_medoids(spark):
    r = np.random.default_rng(3)
    rows = []
    for tag, n in (("one", 1), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("large", 90)):
        for i in range(n):
            v = np.eye(3)[i % 3] + r.normal(size=3) * 0.1
            rows.append((tag, i, v.tolist(), (v / np.linalg.norm(v)).tolist()))
    of = spark.createDataFrame(rows, "tag string, trackid long, raw array<double>, unit array<double>")
    got = {}
    for x in tags.centroid_multi(of).collect():
        got.setdefault(x.tag, []).append(x.trackid)
    assert {k: len(v) for k, v in got.items()} == {"one": 1, "three": 1, "four": 2, "five": 2, "six": 3, "large": 3}
    assert {i % 3 for i in got["large"]} == {0, 1, 2}


def plain_linkage(sims, clusters):
    """Average linkage by comparing all groups with all others, step by step."""
    groups = [[i] for i in range(len(sims))]
    while len(groups) > clusters:
        _, i, j = max((sims[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        groups[-j] = groups[-j] + groups.pop(-i)
    return groups


def test_one_rule_at_every_size(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for n in (4, 5, 7, 30, 31, 60, 120):
        u = r.normal(size=(n, 4))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        groups = plain_linkage(u @ u.T, min(3, n // 2))
        assert sorted(map(sorted, tags._linkage_chain(u, min(3, n // 2)))) == sorted(map(sorted, groups))
        want[str(n)] = {min(c, key=lambda i: (-round(float(u[i] @ u[c].mean(axis=0)), 6), i)) for c in groups}
        rows += [(str(n), i, v, v) for i, v in enumerate(u.tolist())]
    got = {}
    for x in tags.centroid_multi(spark.createDataFrame(rows, "tag string, trackid long, raw array<double>, unit array<double>")).collect():
        got.setdefault(x.tag, set()).add(x.trackid)
    assert got == want


def test_many_members():
    u = np.random.default_rng(5).normal(size=(2000, 4)) + np.eye(4)[np.arange(2000) % 3] * 8
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert sorted(map(sorted, tags._linkage_chain(u, 3))) == [list(range(k, 2000, 3)) for k in range(3)]
