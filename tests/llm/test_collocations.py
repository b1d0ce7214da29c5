"""Collocations against plain counts of every n-gram."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from segue.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    kept = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, p), a in kept.items():
        if len(p) < 2:
            continue
        if any(100 * v >= 80 * a and la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), v in kept.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort()
    ranks, got = Counter(), []
    for lang, s, a, p, le, r in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            got.append((lang, ranks[lang], p.decode(), -a, le, r, n[lang], -s))
    return sorted(got)


def fixture():
    r = random.Random(11)
    vocabulary = ["the", "of", "New", "york", "Éa", "b", "c", "d e", "x\x00y", "q-r"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(r.randint(0, 60)):
            words += r.choice([["new", "York", "city"], ["in", "spite", "of", "it"], [r.choice(vocabulary)], [r.choice(vocabulary)], ["a", "a", "a"]])
        rows.append((i, "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b "]) for w in words), ["en", "de", None][i % 3]))
    rows += [(None, rows[0][1], "en"), (0, rows[0][1], "en"), (0, rows[1][1], "en"), (0, rows[0][1], "de"), (None, None, None), (None, rows[0][1], "en")]
    rows += [(500, "", "xx"), (501, None, "en"), (502, "a", "yy"), (503, " .,;\n", "en"), (504, "zig zag " * 400, "zz"), (505, rows[5][1], "und")]
    return rows


@pytest.mark.parametrize("bits", [{}, {"batch_words": 50, "filter_bits": 8}, {"batch_words": 30, "print_bits": 4}, {"batch_words": 400, "print_bits": 0, "tag_bits": 0}])
def test_every_phrase(spark, bits):
    rows = fixture()
    df = spark.createDataFrame([(*x, "p", 1) for x in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(4)
    got = sorted(tuple(x) for x in collocations.collocations(df, 12, 40, **bits).collect())
    want = plain(rows, 12, 40)
    assert got == want and len(want) > 60


def test_numbers_beyond_64_bits(spark):
    big = 9 * 10**18
    rows = [("en", 1, "a", big), ("en", 1, "b", big), ("en", 1, "c", big - 3), ("en", 2, "a b", big - 1), ("en", 2, "b c", 7_200_000_000_000_000_000), ("en", 3, "a b c", 7_199_999_999_999_999_999)]
    df = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    got = {x.phrase: (x.score, x.l, x.r) for x in collocations.scored(df).collect()}
    assert got["a b"] == (2_000_000 * (big - 1) // (2 * big), big, big)
    assert got["a b c"][0] == min(2_000_000 * rows[5][3] // (big + rows[4][3]), 2_000_000 * rows[5][3] // (rows[3][3] + big - 3))
    assert {x.phrase for x in collocations.not_contained(collocations.scored(df), df).collect()} == {"a b c", "a b"}


def test_long_and_empty(spark):
    long = "one two three, " * 200_000
    df = spark.createDataFrame([(1, long, "en")], "doc_id long, text string, lang string")
    assert [tuple(x) for x in collocations.collocations(df).collect()] == [("en", 1, "one two three", 200_000, 200_000, 200_000, 600_000, 1_000_000)]
    assert collocations.collocations(df.limit(0)).collect() == []


def test_only_frequent_phrases_leave_a_task(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefghijkl") for _ in range(200)) + " p q r s", "en") for i in range(40)]  # pairs are frequent, longer n-grams of the letters are not
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    texts, often = collocations._texts(df), lambda found: collocations.Filter.of(found.groupBy("fp").agg(F.sum("n").alias("n")).where("n >= 30"), 26).words
    assert texts.columns == ["lang", "text"]
    short = spark.sparkContext.broadcast(often(collocations._first_pass(texts, 500, 64)))
    known = spark.sparkContext.broadcast(short.value | often(collocations._second_pass(texts, short, 500, 64)))
    counted = collocations._third_pass(texts, known, 500, 64).groupBy("phrase").agg(F.sum("n").alias("n")).collect()
    assert {x.phrase: x.n for x in counted if x.phrase.count(" ") > 1} == {"p q r": 40, "q r s": 40, "p q r s": 40}
    assert sum(x.phrase.count(" ") == 1 for x in counted) > 100
