"""A bucket of many unlinked members is compared block by block."""

import numpy as np
from pyspark.sql import functions as F

from segue.llm import minhash


def test_no_task_holds_a_whole_bucket(spark):
    r = np.random.default_rng(2)
    signs = [r.integers(0, 256, 256, dtype=np.uint8) for _ in range(120)]
    rows = [(7, i, i, signs[i if i % 10 else 0].tobytes()) for i in range(120)] + [(7, 200 + i, 200, signs[3].tobytes()) for i in range(30)]
    df = spark.createDataFrame(rows, "bucket long, rep long, component long, low binary").repartition(3).cache()
    held = minhash._dealt(df, 16).groupBy("bucket", "kind", "x", "y").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert held < 75  # two blocks, by a hash that deals unevenly
    same = range(0, 120, 10)
    want = {(a, b) for a in same for b in same if a < b} | {(3, 200)}
    for block in (16, 512):
        assert {(x.a, x.b) for x in minhash._across(df, 0.7, False, block).collect()} == want
        best = {(x.a, x.b) for x in minhash._across(df, 0.7, True, block).collect()}
        assert {a for a, _ in best} >= {*same} - {110} and any(a == 3 and b >= 200 for a, b in best)
