"""Removed bytes against looking at every window in document order."""

import hashlib
import random

import numpy as np

from segue.llm import suffix_dedup


def plain(docs, length):
    """A row for each row: judged by its own text and by those of smaller ids."""
    lowest = {}
    for i, t in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1) if i is not None else ():
            w = raw[p : p + length]
            lowest[w] = min(i, lowest.get(w, i))
    out = []
    for i, t in docs:
        raw, gone, mine = (t or "").encode(), set(), set()
        for p in range(len(raw) - length + 1) if i is not None else ():
            w = raw[p : p + length]
            if w in mine or lowest[w] < i:
                gone |= set(range(p, p + length))
            mine.add(w)
        kept = bytes(b for k, b in enumerate(raw) if k not in gone)
        runs = sum(k in gone and k - 1 not in gone for k in range(len(raw)))
        out.append((i, len(raw), len(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeéè") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (18, 30, 40, 60)]
    docs = []
    for i in range(70):
        parts = [prose(r.randint(0, 30)) for _ in range(3)]
        if i % 3:
            parts.insert(r.randint(0, 3), r.choice(passages))
        if i % 11 == 0:
            parts.append(parts[0] * 3)
        docs.append((i * 5, " ".join(parts)))
    docs += [(401, docs[9][1]), (402, docs[9][1]), (403, docs[9][1][:-7] + "x"), (404, "z" * 700), (405, "y" + "z" * 300), (406, "ab" * 300), (407, "same line. " * 40)]
    docs += [(401, docs[12][1]), (20, docs[9][1]), (20, passages[1] + " own words of this row " + prose(20)), (20, prose(40) + docs[9][1]), (401, prose(50)), (401, passages[1] + prose(3)), (5, docs[9][1]), (5, docs[9][1])]
    docs += [(None, docs[9][1]), (500, None), (501, ""), (502, "short"), (503, passages[3][:99]), (504, passages[3][:100]), (505, passages[3][:101])]
    return docs


def digests(x):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in x.collect()), key=str)


def test_removed_bytes(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in docs], "doc_id long, text string, first int, key binary").repartition(5)
    assert digests(suffix_dedup.dedup_digests(df)) == plain(docs, 100)
    hot = suffix_dedup.repeated_windows(df, hot=2).collect()  # nearly every shared key dealt by windows
    cold = suffix_dedup.repeated_windows(df).collect()
    starts = lambda rows: {(x.doc_id, x.text_hash, x.first + k) for x in rows for k in range(x.size)}
    assert starts(hot) == starts(cold)


def test_levels_and_batches(spark):
    r = random.Random(9)
    words = np.array([bytes(r.choice(b"ab") for _ in range(6)) for _ in range(3000)], "S6")
    levels, seen = suffix_dedup.SuffixLevels(), {}
    for at in range(0, 3000, 37):
        part = words[at : at + 37]
        doc = np.sort(np.array([at // 37 * 3 + r.randint(0, 2) for _ in part]))
        own = np.array([r.randint(0, 1) for _ in part])
        order = np.lexsort((own, doc))
        doc, own = doc[order], own[order]
        got = levels.add(part, doc, own)
        for w, d, o, g in zip(part.tolist(), doc.tolist(), own.tolist(), got, strict=True):
            assert g == (any(e < d for e, _ in seen.get(w, ())) or (d, o) in seen.get(w, ()))
            seen.setdefault(w, set()).add((d, o))
        sizes = [len(x) for x, _ in levels.levels]
        assert sum(sizes) == len(seen) and all(2 * b < a for a, b in zip(sizes, sizes[1:], strict=False))


def assert_rows_that_share_an_id(spark):
    """A text found nowhere else stays, whatever ids other texts have; further columns stay, whatever their names."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(1, a, 7, "x"), (2, a, 7, "y"), (2, b, 8, "z")], "doc_id long, text string, spans long, n_removed string")
    got = suffix_dedup.dedup_rows(df)
    assert got.columns == ["doc_id", "text", "spans", "n_removed"]
    assert sorted((x.doc_id, x.text, x.spans, x.n_removed) for x in got.collect()) == sorted([(1, a, 7, 0), (2, "", 7, len(a)), (2, b, 8, 0)])


def test_very_long_text(spark):
    r = random.Random(5)
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(150_000))
    df = spark.createDataFrame([(1, long), (2, "head " + long[50_000:900_000] + " tail")], "doc_id long, text string")
    removed = {x.doc_id: x.n_removed for x in suffix_dedup.dedup_digests(df).collect()}
    assert removed[1] == 0 and 850_000 <= removed[2] <= 850_002


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (3, None)], "doc_id long, text string").repartition(3)
    assert_rows_that_share_an_id(spark)
    got = sorted((x.doc_id or 0, x.n_removed) for x in suffix_dedup.dedup_digests(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, len(text)), (3, 0)]
    assert suffix_dedup.dedup_digests(df.limit(0)).collect() == []
    texts = {x.doc_id: x.text for x in suffix_dedup.dedup_rows(df.where("doc_id > 1")).collect()}
    assert texts == {2: text, 3: ""}
