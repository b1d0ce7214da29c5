"""Secret scans of very long texts, in time, and against Python where spans are many."""

import random
import re
import time

from segue.llm import secret_scan

TABLE = [1.0 if i % 3 else 4.5 for i in range((len(secret_scan.SYMBOLS) + 1) ** 2)]


def plain(text):
    """All base spans by Python's expressions, and the tokens that touch none."""
    base = []
    for kind, pattern, group, least in secret_scan.BASE:
        base += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    n, out = len(secret_scan.SYMBOLS) + 1, []
    for m in re.finditer(secret_scan.TOKEN, text):
        code = [secret_scan.SYMBOLS.find(c) + 1 for c in m.group()]
        r = sum(TABLE[a * n + b] for a, b in zip(code, code[1:], strict=False))
        if r >= 30 and r >= 2 * (len(code) - 1) and not any(s < m.end() and m.start() < e for s, e, _ in base):
            out.append((m.start(), m.end(), "random"))
    return sorted(base + out, key=lambda x: (x[0], secret_scan.KINDS.index(x[2])))


def masked(text, spans):
    out, at = "", 0
    for s, e, _ in sorted(spans):
        if e > at:
            out += "" if s < at else text[at:s] + "[SECRET]"
            at = e
    return out + text[at:]


def test_many_spans(spark):
    r = random.Random(3)
    alphabet = secret_scan.SYMBOLS + " .é😀\n:"
    texts = []
    for _ in range(300):
        bits = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))), "AKIA" + "Q7" * r.randint(5, 9), "".join(r.choice("0123456789abcdef") for _ in range(r.randint(10, 40))), "password = " + "".join(r.choice(secret_scan.SYMBOLS) for _ in range(r.randint(8, 30))), "".join(r.choice("ABCabc+/") for _ in range(30)), " ", "😀", "é"]
        texts.append("".join(r.choice(bits) for _ in range(r.randint(0, 30))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = secret_scan.scan(df, TABLE)
    said = {x.doc_id: x.spans for x in secret_scan.digests(found).collect()}
    hidden = {x.doc_id: x.text for x in secret_scan.masked(found).collect()}
    for i, t in enumerate(texts):
        spans = plain(t)
        assert said[i] == ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert hidden[i] == masked(t, spans)
    assert sum("random" in x for x in said.values()) > 20


def test_long_texts_in_time(spark):
    token = "".join(random.Random(1).choice(secret_scan.SYMBOLS) for _ in range(1_000_000))
    many = "0123456789abcdef " * 100_000
    mixed = ("AKIAQQQQQQQQQQQQQQ " + "ABCabcABCabcABCabcABCabc ") * 30_000
    df = spark.createDataFrame([(1, token), (2, many), (3, mixed)], "doc_id long, text string").repartition(3)
    secret_scan.digests(secret_scan.scan(df.limit(0), TABLE)).collect()
    began = time.time()
    found = {x.doc_id: x for x in secret_scan.digests(secret_scan.scan(df, TABLE)).collect()}
    hidden = {x.doc_id: x.text for x in secret_scan.masked(secret_scan.scan(df, TABLE)).collect()}
    assert time.time() - began < 90
    assert (found[2].n_hex, found[3].n_access) == (100_000, 30_000)
    assert hidden[2] == "[SECRET] " * 100_000
    assert secret_scan.train(spark.createDataFrame([(token, True), ("ordinary words", False)], "token string, random boolean"))
