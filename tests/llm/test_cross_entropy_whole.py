"""Cross-entropy difference over every token against direct counts."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from segue.llm import cross_entropy, queries


def test_every_token_counts(spark, tmp_path):
    r = random.Random(4)
    # 3,000 token types, more than any fixed table of 1,024; the last documents differ in rare words alone
    docs = [(i, " ".join(f"w{int(3000 * r.random() ** 3)}" for _ in range(60))) for i in range(300)]
    docs += [(400, "the rare alpha"), (401, "the rare beta"), (402, "the rare alpha"), (403, None), (404, ""), (None, "the rare alpha"), (5, "w1 w2")]
    good = {*range(0, 300, 3), 400}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in good] + [(401, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    seqs = [(i in good, [None, *cross_entropy.tokens(t or "")]) for i, t in docs]
    symbols = len({t for _, s in seqs for t in s[1:]}) + 2

    def model(target):
        pair = Counter(p for k, s in seqs if k == target for p in zip(s, s[1:], strict=False))
        first, second = Counter(), Counter()
        for (a, b), c in pair.items():
            first[a] += c
            second[b] += c
        total = sum(second.values()) + 0.5 * symbols

        def log(a, b):
            share = 0.7 * first[a] / (first[a] + 5)
            return math.log(share * pair[a, b] / max(1, first[a]) + (1 - share) * (second[b] + 0.5) / total)

        return log

    near, far = model(True), model(False)
    want = sorted((-1 if i is None else i, len(s) - 1, sum(far(a, b) - near(a, b) for a, b in zip(s, s[1:], strict=False)) / max(1, len(s) - 1)) for (i, _), (_, s) in zip(docs, seqs, strict=True))

    def same(found):
        got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens, x.difference) for x in found.collect())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want, strict=True))
        return {x[0]: x[2] for x in got}

    by = same(queries.op9_cross_entropy_difference(spark, str(tmp_path)))
    assert by[400] < by[401] and by[400] == by[402] == by[-1]
    # many batches, many ranges of keys, ids that are joined by a shuffle
    same(cross_entropy.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in good], "doc_id long"), few_ids=1, chars=2000))
    assert cross_entropy.cross_entropy_difference(df.limit(0), df.select(F.col("doc_id")).limit(0)).collect() == []
