"""The manifest against a plain tree over all rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from segue.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, g string, pos int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tagged(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def folded(nodes):
    """The root, and for each node its place and siblings on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
            at[k] = i // 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda i, t, lang, src, n: H(*map(tagged, (i, src, lang, n, t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    roots = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        roots[g] = folded([x[2] for x in groups[g]])
    root, tops = folded([roots[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, own, r), path in zip(groups[g], roots[g][1], strict=True):
            whole = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r[0], r[1].translate(low) if hit and r[1] is not None else r[1], *r[2:5])
            for at, others in whole:
                node = H(*others[:at], node, *others[at:])
            out.append((r[0], own, roots[g][0], root, H(*(x for _, o in whole for x in o)), node, node == root))
    return sorted(out, key=str)


def fixture():
    rows = [(i * 7, f"Text {i} é", ["en", "de", "fr"][i % 3 and i % 2 + 1], "src", i, "h", "g", 1) for i in range(700)]
    rows += [(None, "No id", "en", None, None, None, None, None), (5, None, None, None, None, None, None, 2), (7, "A", None, "s", 1, None, None, None), (7, "A", None, "s", 1, None, None, None)]
    rows += [(9, "", "", "", 0, "", "", 0), (21, "-", "-", "-", 3, "", "", 0), (14, "X", "één", "y", 2, "", "", 0), (33, "W" * 300_000, "zz", "y", 2, "", "", 0)]
    return rows


@pytest.mark.parametrize("rise", [1, 4])
def test_audit(spark, rise):
    # blocks of one level: several stages even of few rows
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(x) for x in merkle.audit(df, rise=rise).collect()), key=str)
    want = plain(rows)
    assert got == want
    assert 0 < sum(not x[-1] for x in got) < len(got) / 2
    nodes = merkle.manifest(df, rise=rise)
    en = nodes.where("g = '=en'")
    leaves = en.where("level = 0").orderBy("nth").collect()
    assert [x.nth for x in leaves] == list(range(len(leaves))) and en.groupBy("level", "nth").count().where("count > 1").count() == 0
    top = en.orderBy(F.desc("level")).first()
    assert top.hash == next(x[2] for x in want if x[1] == leaves[0].hash) == folded([x.hash for x in leaves])[0]


def test_a_version_shares_what_it_does_not_change(spark):
    df = spark.createDataFrame([x[:5] for x in fixture()], SCHEMA.split(", hash")[0])
    at = {x.doc_id: x for x in merkle.versions(df, F.col("doc_id") == 49, F.lit("other")).collect()}
    same, changed = at[7 * 14], at[49]
    assert same.copied[-1] == same.root and changed.copied[-1] != changed.root
    assert len(changed.copied) == len(changed.path) + 1


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA.split(", hash")[0])
    (one,) = merkle.audit(df).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == H()
    assert merkle.audit(df.limit(0)).collect() == []
    assert merkle.manifest(df.limit(0)).collect() == []
