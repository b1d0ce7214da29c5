"""Removed words against looking at every window."""

import hashlib
import random
import re

from segue.llm import word_windows

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, length):
    seen = {}
    for i, t in rows:
        w = SPLIT.findall(t or "")
        if i is not None:
            for p in range(len(w) - length + 1):
                k = tuple(w[p : p + length])
                seen[k] = min(i, seen.get(k, i))
    out = []
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = {p + k for p in range(len(w) - length + 1) if i is not None and seen[tuple(w[p : p + length])] < i for k in range(length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    r = random.Random(13)
    prose = lambda n: [r.choice("abcdeé") * r.randint(1, 3) + r.choice("xyz") for _ in range(n)]
    shared = [prose(n) for n in (49, 50, 51, 75, 120, 400)]
    gaps = [" ", "\n", "\t ", "\x0b", "  "]
    rows = []
    for i in range(120):
        w = prose(r.randint(0, 90))
        if i % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        if i % 10 == 0:
            w = w + w
        rows.append((i * 3, "".join(x + r.choice(gaps) for x in w)))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60, 7)] + [(2000, " ".join(shared[5][:399])), (1999, " ".join(shared[5][1:])), (2001, "same " * 300), (2002, "same " * 120), (2003, "ab cd " * 70), (2004, "x ab cd " * 70)]
    rows += [(None, rows[0][1]), (None, None), (2100, None), (2101, ""), (2102, " \n"), (2103, "short one"), (2104, "short one"), (2105, "a\u00a0b " * 60), (2106, "a b " * 60)]
    rows += [(1, "u " + " ".join(shared[4])), (2, "u " + " ".join(shared[4])), (2, "only here " * 40), (2, "u " + " ".join(shared[4])), (-5, " ".join(shared[3]) + " tail")]
    return rows


def test_removed_words(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, first int, a int, spans string").repartition(6)
    got = sorted((tuple(x)[:4] for x in word_windows.dedup_digests(df).collect()), key=str)
    assert got == plain(rows, 50)
    assert sum(x[2] > 0 for x in got) > 30
    odd = [(i, t) for i, t in rows if i is not None]
    few = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    assert sorted((tuple(x)[:4] for x in word_windows.dedup_digests(few, 7).collect()), key=str) == plain(odd, 7)


def test_rows(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    got = word_windows.dedup_rows(df)
    assert got.columns == df.columns
    kept = sorted(((x.doc_id, hashlib.sha256(" ".join(SPLIT.findall(x.text or "")).encode()).hexdigest()) for x in got.collect()), key=str)
    assert kept == sorted(((i, s) for i, _, _, s in plain(rows, 50)), key=str)
    assert {x.spans for x in got.collect()} == {"keep"}


def test_levels(spark):
    r = random.Random(2)
    prose = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    long, short = prose(2000), prose(60)
    df = spark.createDataFrame([(1, long + " a"), (2, "b " + long), (3, prose(30) + " " + short), (4, short + " " + prose(40)), (5, prose(500)), (6, prose(20))], "doc_id long, text string")
    at = {x.doc_id: (x.longest, x.n_removed) for x in word_windows.dedup_digests(df).collect()}
    assert at[1] == (1600, 0) and at[2] == (1600, 2000) and at[5] == at[6] == (0, 0) and at[4][1] == 60
    assert word_windows.dedup_digests(df.limit(0)).collect() == []


def test_very_long_text(spark):
    words = [f"w{i % 4001}x{i % 977}" for i in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "z " + " ".join(words[1000:200_000]))], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in word_windows.dedup_digests(df).collect()} == {1: 0, 2: 199_000}
