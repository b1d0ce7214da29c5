"""Terms in texts against comparing each with each."""

import random

import pytest

from segue.operators import requests as req


@pytest.mark.parametrize("block", [(4096, 20_000), (7, 5)])
def test_contained(spark, block):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("aabcé") for _ in range(r.randint(0, n)))
    texts = [(i, word(30)) for i in range(60)] + [(60, None), (61, "")]
    patterns = [word(4) for _ in range(30)] + ["", None, "aa", "aa"]
    got = req.contained(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), block)
    want = {(i, p) for i, t in texts for p in patterns if t is not None and p is not None and p in t}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_terms_in_any_case(spark):
    requests = spark.createDataFrame([(1, "Deep HOUSE and dub"), (2, "nothing"), (3, None)], "request_id long, text string")
    vocabulary = spark.createDataFrame([("house",), ("House",), ("DUB",), ("acid",), (None,)], "tag string")
    found = req.matched_terms(requests, vocabulary)
    assert sorted(tuple(x) for x in found.collect()) == [(1, "DUB"), (1, "House"), (1, "house")]
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    near = req.suggest_similar(spark.createDataFrame([("Hous",), ("deep house music",), ("zzz",)], "input string"), vocabulary, spark.createDataFrame([("houseful",)], "tag string"))
    got = sorted(tuple(x) for x in near.collect())
    assert got == [("Hous", "House", 0, 1), ("Hous", "house", 0, 2), ("Hous", "houseful", 1, 3), ("deep house music", "House", 0, 1), ("deep house music", "house", 0, 2)]


def test_empty(spark):
    none = spark.createDataFrame([], "tag string")
    requests = spark.createDataFrame([(1, "x")], "request_id long, text string")
    assert req.matched_terms(requests, none).collect() == [] and req.matched_terms(requests.limit(0), none).collect() == []
