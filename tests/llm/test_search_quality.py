"""Search against all scores, the classifier on held-out documents."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from segue.llm import mil_quality, threshold_search


def plain_top(rows, every, k):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in sound if i % every == 0}:
        qv = next(v for i, v in sound if i == q)
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in sound if i != q and len(v) == len(qv))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k(spark):
    r = random.Random(4)
    for width, scale in ((6, 1.0), (3, 0.05), (4, 1e6)):
        rows = [(i, [r.gauss(0, scale) for _ in range(width)]) for i in range(400)]
        rows += [(400 + i, rows[i][1]) for i in range(60)]  # ties
        rows += [(500, None), (520, [None] * width), (540, [float("nan")] * width), (560, [float("inf")] + [0.0] * (width - 1)), (580, [0.0] * width), (None, [1.0] * width), (600, [])]
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, v string").repartition(3)
        got = {tuple(x) for x in threshold_search.top_k(df, candidate_block=64, query_block=10).select("query_id", "rank", "vec_id", "score").collect()}
        assert got == plain_top(rows, 20, 20)
    assert threshold_search.top_k(df.limit(0)).collect() == []
    few = threshold_search.top_k(spark.createDataFrame([(20, [1.0]), (21, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(x) for x in few] == [(20, 1, 21, 64 * 128)]


def test_threshold_stops_early():
    x = np.zeros((5000, 4), np.int64)
    x[:, 0] = np.arange(5000)
    ids, scores = threshold_search.SortedLists(np.arange(5000), x).top(-1, np.array([3, 0, 0, 0]), 5)
    assert ids.tolist() == [4999, 4998, 4997, 4996, 4995] and scores[0] == 3 * 4999


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = mil_quality.score(some, mil_quality.train(docs, labels, 1500))
    x = scored.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in x) > 0.98 * len(x)
    good = [r.predicted for r in x if r.quality == 1]
    assert sum(good) > 0.99 * len(good)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x"), (4, "word " * 30000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = mil_quality.score(docs, mil_quality.train(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    nothing = mil_quality.score(docs, mil_quality.train(docs, labels.limit(0))).collect()
    assert {x.score for x in nothing} == {0.5}
    assert mil_quality.score(docs.limit(0), mil_quality.train(docs, labels)).collect() == []


def test_attention_and_gradients_against_plain_sums():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(90)]
    bags = [mil_quality.passages(" ".join(r.choice(vocabulary) for _ in range(n))) for n in (1, 64, 65, 300)]
    y = np.array([0, 1, 1, 0], np.float32)
    model = mil_quality.fit(bags, y, epochs=2, batch=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    p, shown = model.p, []
    for bag in bags:
        hidden, weight = [], []
        for i in range(len(bag.dense)):
            own = bag.grams[bag.starts[i] : bag.starts[i + 1] if i + 1 < len(bag.starts) else None]
            x = np.clip((bag.dense[i] - p["mean"]) / p["scale"], -8, 8)
            h = np.tanh(x @ p["w1"] + sum(p["word"][g] for g in own) / len(own) @ p["w2"] + p["b1"])
            gate = np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))
            hidden.append(h)
            weight.append(np.exp(gate @ p["a"]))
        z = sum(w * h for w, h in zip(weight, hidden, strict=True)) / sum(weight)
        shown.append(1 / (1 + np.exp(-(z @ p["c"] + p["c0"][0]))))
        assert abs(model.score(bag) - shown[-1]) < 1e-9
    assert np.allclose(model.forward(bags)["y"], shown)

    def loss():
        q = model.forward(bags)["y"]
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    grads, rows, each = model.gradients(bags, y)
    for k, g in [*grads.items(), ("word", None)]:
        for _ in range(4):
            at = (r.choice(rows.tolist()), r.randrange(mil_quality.EMBED)) if k == "word" else tuple(r.randrange(n) for n in p[k].shape)
            want = each[rows.tolist().index(at[0]), at[1]] if k == "word" else g[at]
            p[k][at] += 1e-5
            up = loss()
            p[k][at] -= 2e-5
            down = loss()
            p[k][at] += 1e-5
            assert abs((up - down) / 2e-5 - want) < 1e-6
    assert [b.tolist() for b in mil_quality.passages("")] == [[[0.0] * mil_quality.FEATURES], [0], [0]]


def test_words_are_seen():
    """Labels that only a word tells, in texts whose characters and lengths are alike."""
    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ale", "ine", "ort", "ump")]
    docs = [[r.choice(vocabulary) for _ in range(150)] for _ in range(600)]
    labels = np.array([i % 2 for i in range(600)])
    for words, label in zip(docs, labels, strict=True):
        for _ in range(10):
            words[r.randrange(150)] = "tumble" if label else "bulmet"
    bags = [mil_quality.passages(" ".join(w)) for w in docs]
    model = mil_quality.fit(bags[:500], labels[:500], epochs=20)
    assert sum((model.score(b) >= 0.5) == k for b, k in zip(bags[500:], labels[500:], strict=True)) >= 95
