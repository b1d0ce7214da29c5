"""Fingerprints against a plain definition, secret spans against Python's regular expressions."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from segue.llm import secret_scan, syncmers


MASK = 2**64 - 1
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mixed(x):
    x = ((x ^ (x >> 32)) * MIX) & MASK
    return x ^ (x >> 29)


def slow_anchors(text, k=20, s=5):
    """The definition, k-mer by k-mer, in whole numbers: the least inner hash stands at the first or the last place."""
    out = []
    for i in range(len(text) - k + 1):
        inner = []
        for j in range(k - s + 1):
            h = 0
            for c in text[i + j : i + j + s]:
                h = (h * STEP + ord(c)) & MASK
            inner.append(mixed(h * STEP & MASK))
        if min(inner) in (inner[0], inner[-1]):
            whole = inner[0]
            for j in range(s, k, s):
                whole = (whole * STEP + inner[j]) & MASK
            out.append((i, mixed(whole) >> 32))
    if not out and text:
        return [(0, int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little"))]
    return out


def slow_likeness(a, b):
    """Occurrences matched by number, and the longest sequence of matches in one order, by a table."""
    def numbered(found):
        seen = {}
        for at, (_, h) in enumerate(found):
            seen[h] = seen.get(h, 0) + 1
            yield (h, seen[h]), at

    if not a or not b:
        return float(len(a) == len(b))
    there = dict(numbered(b))
    order = [there[key] for key, _ in numbered(a) if key in there]
    best = []
    for i, x in enumerate(order):
        best.append(1 + max((best[j] for j in range(i) if order[j] < x), default=0))
    return 2 * max(best, default=0) / (len(a) + len(b))


def test_anchors_are_context_free_and_dense():
    r = random.Random(1)
    for n in (20, 21, 60, 400):
        text = "".join(r.choice("ab é.") for _ in range(n))
        at, hashes = syncmers.anchors(text)
        assert list(zip(at.tolist(), hashes.tolist(), strict=True)) == slow_anchors(text)
        assert all(b - a <= 15 for a, b in zip(at, at[1:], strict=False))
        back = syncmers.unpacked(syncmers.packed((at, hashes)))
        assert back[0].tolist() == at.tolist() and back[1].tolist() == hashes.tolist()
    a, b = syncmers.anchors("x" * 50 + "abcdefghij" * 9), syncmers.anchors("abcdefghij" * 9)
    assert syncmers.likeness(a, a) == 1 and 0 < syncmers.likeness(a, b) == syncmers.likeness(b, a) < 1
    assert syncmers.likeness(syncmers.anchors(""), syncmers.anchors("")) == 1 and syncmers.likeness(a, syncmers.anchors("")) == 0


@pytest.mark.parametrize("per", [3, 10_000])
def test_edit_comparison(spark, per):
    r = random.Random(2)
    docs = [(i * 7, " ".join(r.choice(["the", "naïve", "cat", "zyx"]) + str(r.randint(0, 99)) for _ in range(r.randint(0, 60)))) for i in range(40)]
    docs += [(5, None), (6, ""), (8, "z" * 5000), (9, docs[3][1]), (10, docs[3][1]), (None, "last one")]
    df = spark.createDataFrame([(i, t, t, 1.0) for i, t in docs], "doc_id long, text string, fingerprint string, range double").repartition(4)
    got = {x.doc_id: x for x in syncmers.edit_comparison(df, rows_per_bucket=per).collect()}
    order = sorted(docs, key=lambda d: -1 if d[0] is None else d[0], reverse=True)
    assert len(got) == len(docs)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert x.fingerprint == syncmers.packed(syncmers.anchors(t)) and x.edited_fingerprint == syncmers.packed(syncmers.anchors(e))
        assert x.near_edited == slow_likeness(slow_anchors(t), slow_anchors(e))
        assert x.near_next == slow_likeness(slow_anchors(t), slow_anchors(nxt))
    assert got[9].fingerprint == got[10].fingerprint and got[10].near_next == 1
    assert syncmers.edit_comparison(df.limit(0)).collect() == []
    one = syncmers.edit_comparison(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_secret_spans(spark):
    r = random.Random(3)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "😀", "é", "\n", "abcdefghijkl", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH12", "x", "-", "token = abc", "wJalrXUtnFEMIK7MDENGbPxRfiCY9", "configuration_manager_settings"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "password=token:abcdefghijklmnop"), (903, "secret='" + "a1" * 9000 + "' " * 3), (904, "key wJalrXUtnFEMIK7MDENGbPxRfiCY9zQ end"), (904, "key wJalrXUtnFEMIK7MDENGbPxRfiCY9zQ end"), (905, "call configuration_manager_settings here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hex string")
    words = ["configuration", "manager", "settings", "value", "internationalisation", "document_identifier", "user_name", "printing", "the_quick_brown_fox"]
    words += [w.title() for w in words] + [w.upper() for w in words] + ["Zebra1", "Junior2", "Quality3", "XML4", "KEY7"]
    samples = spark.createDataFrame([(w, False) for w in words * 30] + [(base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode(), True) for i in range(800)], "token string, random boolean")
    model = secret_scan.train(samples)
    scanned = secret_scan.scan(df, model, 12.0, 0.4)  # limits for this small model
    got = secret_scan.digests(scanned).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for x in got:
        want = base(texts[x.doc_id] or "")
        assert [s for s in x.spans.split(",") if s and not s.startswith("random")] == want
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
    by = {x.doc_id: x for x in got}
    assert by[904].spans == "random:4:35" and by[905].spans == "" and by[902].n_assign == 0
    for x in secret_scan.masked(scanned).collect():
        t = texts[x.doc_id] or ""
        hit = sorted(tuple(map(int, s.split(":")[1:])) for s in by[x.doc_id].spans.split(",") if s)
        out, at, open_end = "", 0, -1
        for a, b in hit:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert x.text == out + t[at:]
    assert secret_scan.digests(secret_scan.scan(df.limit(0), model)).collect() == []
    assert secret_scan.train(samples.limit(0)) == [0.0] * len(model)
    assert secret_scan.train(secret_scan.corpus_samples(df.limit(0))) == [0.0] * len(model)


def test_random_strings_and_names(spark):
    """Recall on alphabets of secrets, and false hits on names as programs have them, of a model trained on the given documents."""
    r = random.Random(3)
    words = "load user account session from cache handler request factory abstract bean service http client retry policy default timeout seconds table column index name value parser stream reader writer buffer config manager settings update delete insert query result builder visitor node token scanner version project module package import export".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    four = lambda: [r.choice(words) for _ in range(4)]
    secret = {
        "letters and digits, 20": lambda: some(letters, 20), "letters and digits, 40": lambda: some(letters, 40), "base 64": lambda: base64.b64encode(r.randbytes(24)).decode(),
        "base 32": lambda: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26), "lower case": lambda: some(letters[26:], 30), "hexadecimal": lambda: some("0123456789ABCDEF", 32), "digits": lambda: some("0123456789", 24),
    }
    name = {
        "camel case": lambda: "".join(w.title() for w in four()), "snake case": lambda: "_".join(four()), "capitals": lambda: "_".join(four()).upper(), "dashes": lambda: "-".join(four()),
        "path": lambda: "/usr/" + "/".join(four()), "day": lambda: f"logs/{r.choice(words)}/2024-{r.randint(1, 12):02}-{r.randint(1, 28):02}/{r.choice(words)}", "numbered": lambda: "".join(w.title() for w in four()) + str(r.randint(1, 99)),
    }
    rows = [(k, t) for k, make in (secret | name).items() for t in (make() for _ in range(200)) if len(t) >= 20]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    model = secret_scan.train(secret_scan.corpus_samples(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    hits = {k: [] for k in secret | name}
    for x in secret_scan.digests(secret_scan.scan(df, model)).collect():
        hits[rows[x.doc_id][0]].append(bool(x.spans))
    share = {k: sum(v) / len(v) for k, v in hits.items()}
    assert all(share[k] >= 0.95 for k in secret), share
    assert all(share[k] <= 0.05 for k in name), share


def test_ratios_are_plain_sums(spark):
    import math
    from collections import Counter

    samples = [("abcab", False), ("abc-abc", False), ("bca", False), ("x9Zq", True), ("9Zx", True), ("é9", True)]
    model = secret_scan.train(spark.createDataFrame(samples, "token string, random boolean"))
    number = {c: i + 1 for i, c in enumerate(secret_scan.SYMBOLS)}
    n = len(number) + 1
    counts = {k: Counter((number.get(a, 0), number.get(b, 0)) for t, random_ in samples if random_ == k for a, b in zip(t, t[1:])) for k in (True, False)}
    log = lambda k, a, b: math.log((counts[k][a, b] + 0.5) / (sum(counts[k][a, c] for c in range(n)) + 0.5 * n))
    for token in ("abc9Zé", "x9"):
        want = sum(round(log(True, a, b) - log(False, a, b), 4) for a, b in ((number.get(a, 0), number.get(b, 0)) for a, b in zip(token, token[1:])))
        got = spark.createDataFrame([(token,)], "t string").select(secret_scan.ratio(F.col("t"), model)).first()[0]
        assert abs(got - want) < 1e-9
