"""Near duplicates against comparing all pairs of sets; components against a plain union."""

import random
from itertools import combinations

from segue.llm import components, minhash


def plain_sets(docs, width):
    out = {}
    for i, t in docs:
        words = bytes(t or "", "utf8").lower().split()
        out[i] = frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
    return out


def plain_components(nodes, links):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def fixture():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    for base in range(12):
        text = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.choice([1, 2, 30])):
            copy = list(text)
            for _ in range(r.randint(0, 6) if len(copy) > 20 else r.randint(0, 1)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append((i * 3, (" " if i % 2 else "\t\n").join(copy).upper() if i % 5 == 0 else " ".join(copy)))
            i += 1
    docs += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "One"), (1004, "one"), (1005, "É"), (1006, "é"), (1007, "a\xa0b"), (1008, "word " * 5000)]
    return docs


def test_near_duplicates(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rep int, signature string").repartition(3)
    for width in (4, 5):
        got = {x.doc_id: x for x in minhash.near_duplicates(df, width=width).collect()}
        sets = plain_sets(docs, width)
        links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = plain_components(sets, links)
        assert {i: x.component_id for i, x in got.items()} == want
        assert all(x.kept == (i == want[i]) and x.n_shingles == len(sets[i]) for i, x in got.items())
    assert got[1003].component_id == got[1004].component_id == 1003 and got[1005].kept and got[1006].kept


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z y x w v u"), (2, "a b c d e f")], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 5 and sorted(x.component_id for x in got if x.doc_id) == [1, 1, 1]
    assert [x.component_id for x in got if x.n_shingles and x.doc_id is None] in ([1, None], [None, 1])
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(100, b) for b in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    want = plain_components({n for link in links for n in link if link[0] != link[1]}, [x for x in links if x[0] != x[1]])
    df = spark.createDataFrame([*links, (None, 5)], "a long, b long")
    for given, most in ((df, 500_000), (df.repartition(7), 500_000), (df.repartition(3), 4)):  # one task, links across tasks, and few nodes held at once
        assert {x.node: x.component for x in components.components(given, most).collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_small_blocks_find_the_same_links(spark):
    docs = fixture()
    r = random.Random(8)
    for base in range(2):  # chains of copies, each a little further, in one bucket or another
        text = [f"q{base}_{k}" for k in range(150)]
        for i in range(60):
            text = list(text)
            text[r.randrange(150)] = f"z{base}_{i}"
            docs.append((5000 + 100 * base + i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets = plain_sets(docs, 5)
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = plain_components(sets, links)
    got = minhash.near_duplicates(df, block=4, set_block=3).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_template_that_links_nothing(spark):
    r = random.Random(9)
    shared = [f"t{i}" for i in range(140)]
    docs = [(i, " ".join([*shared, *(f"u{i}_{k}" for k in range(r.randint(44, 60)))])) for i in range(400)]
    docs.append((900, docs[7][1] + " end"))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block=64).collect()}
    assert got == {i: i for i in range(400)} | {900: 7}


def test_prefixes_of_linked_sets_meet(spark):
    docs = fixture()
    sets = plain_sets(docs, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = minhash._sets(df, df.select("doc_id"), 5).where("length(found) > 0")
    tokens = {}
    for x in minhash._prefixes(found, 80).collect():
        tokens.setdefault(x.rep, set()).add(x.bucket)
    assert all(tokens[a] & tokens[b] for a, b in combinations(tokens, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
