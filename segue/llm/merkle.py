"""A Merkle manifest of a table, as a persistent tree that is copied along paths.

Each row is a leaf. The leaves of a group ascend by id; every ``RUN`` consecutive nodes become one, level by level, until one is
left, the group's root; the roots of the groups, in order, become the root of the table in the same way.

1. Leaves get their places by one sort: a range partition knows how many rows of each group lie before it.
2. Aligned blocks of ``RUN**RISE`` nodes are one row each, and a block's tree is made in the task that holds it. The roots of the
   blocks are the nodes of the next stage, which has that many times fewer rows, until every group is one block.
3. From the top down each block gets the path above it: its place and its siblings on each level. A changed leaf is a version of
   the tree that shares all untouched nodes: only the ancestors are copied, first in its block, then along the path above it, so
   versions meet neither each other nor the upper blocks again.

A null value is told from any text. Rows with one id are leaves of their own, in the order of their digests; a null id comes first;
a null group is a group of its own, before all others. Further columns are ignored, very long texts are hashed where they lie, and an
empty table has no rows. What is changed in a row without an id is decided like in any other; here ``crc32`` of null is null, so it stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.llm.common import mapped, scratch, scratch_dir, written

#: Nodes of a run, and levels of a block.
RUN, RISE = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at:int,others:array<string>>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tagged(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    said = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, with another text if one is given."""
    return F.sha2(F.concat(*(tagged(text if text is not None and c == "text" else F.col(c)) for c in FIELDS)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Tree:
    """The tree over some nodes, of so many levels. A version of it is the list of nodes that it does not share with the tree."""

    def __init__(self, nodes: list[str], rise: int) -> None:
        self.levels = [nodes]
        for _ in range(rise):
            below = self.levels[-1]
            self.levels.append([digest(below[i : i + RUN]) for i in range(0, len(below), RUN)])
        self.root = self.levels[-1][0]

    def path(self, at: int) -> list[tuple[int, list[str]]]:
        """For each level below the root: the node's place in its run, and the run's other nodes."""
        out = []
        for level in self.levels[:-1]:
            first = at // RUN * RUN
            out.append((at - first, level[first:at] + level[at + 1 : first + RUN]))
            at //= RUN
        return out


def copied(node: str, path: list[tuple[int, list[str]]]) -> list[str]:
    """The nodes of the version in which a node is this one: itself and the copies of its ancestors, up to the root."""
    out = [node]
    for at, others in path:
        out.append(digest([*others[:at], out[-1], *others[at:]]))
    return out


def rise_of(n: int, most: int) -> int:
    """Levels until one node is left, of a group of ``n``; a block of a group with several blocks rises all of its levels."""
    rise = 0
    while rise < most and RUN**rise < n:
        rise += 1
    return rise


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 in its group, and ``n``, the group's rows: one range shuffle; ``group`` has no nulls.

    Rows that are alike in all of ``order`` are told apart by their input partition, so that many equal rows need not lie in one range.
    """
    keyed = rows.withColumn("was", F.spark_partition_id())
    ranged = keyed.repartitionByRange(group, *order, "was").sortWithinPartitions(group, *order, "was").select(*rows.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth"))
    held = written(ranged)
    parts = held.groupBy(group, "part").agg(F.count("*").alias("size"), F.min("nth").alias("first"))  # a row for each partition, and one for each group
    every, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(group, "part", F.sum("size").over(every).alias("n"), (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return held.join(offsets, [group, "part"]).select(*rows.columns, (F.col("nth") + F.col("shift")).alias("pos"), "n")


def _blocks(nodes: DataFrame, rise: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """``g, block, n, nodes, own`` (its root) of aligned blocks, from ``g, pos, n, hash``; ``nodes`` holds the hashes, with what is carried, in order."""
    grouped = nodes.groupBy("g", F.floor(F.col("pos") / RUN**rise).cast("long").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", *carried))).alias("nodes"))
    root = F.udf(lambda hashes, n: Tree(hashes, rise_of(n, rise)).root, "string", useArrow=True)  # one call for each block
    return grouped.withColumn("own", root(F.transform("nodes", lambda x: x["hash"]), "n"))


def _levels(nodes: DataFrame, rise: int, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The blocks of each stage, from the leaves up, until every group is one block."""
    levels = [written(_blocks(nodes, rise, carried))]
    while True:
        above = levels[-1].where(F.col("n") > RUN**rise).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / RUN**rise).cast("long").alias("n"), F.col("own").alias("hash"))
        if above.isEmpty():
            return levels
        levels.append(written(_blocks(above, rise)))


def _roots(levels: list[DataFrame], rise: int) -> DataFrame:
    return reduce(DataFrame.unionByName, (x.where(F.col("n") <= RUN**rise).select("g", F.col("own").alias("subroot")) for x in levels))


def _below(blocks: DataFrame, rise: int) -> DataFrame:
    """``g, block, path, subroot, root`` of the blocks under these ones (which have a path), a row for each node."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for g, nodes, n, path, subroot, root in source:
            tree = Tree([x["hash"] for x in nodes], rise_of(n, rise))
            above = [(p["at"], p["others"]) for p in path]
            for i, x in enumerate(nodes):
                yield g, x["pos"], [{"at": a, "others": o} for a, o in tree.path(i) + above], subroot, root

    return mapped(blocks.select("g", "nodes", "n", "path", "subroot", "root"), rows, f"g string, block long, path {PATH}, subroot string, root string", batch=64)


def _with_paths(levels: list[DataFrame], top: DataFrame, rise: int) -> DataFrame:
    """The blocks of leaves with the whole path above each; ``top`` has ``g, path, subroot, root`` of each group."""
    under = None
    for blocks in reversed(levels):
        done = blocks.where(F.col("n") <= RUN**rise).join(top, "g")
        if under is not None:
            done = done.unionByName(blocks.where(F.col("n") > RUN**rise).join(under, ["g", "block"]))
        if blocks is levels[0]:
            return done
        under = written(_below(done, rise))
    raise AssertionError("there is always a stage of leaves")


def _tree(leaves: DataFrame, rise: int, carried: tuple[str, ...]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of leaves and above, and the path of each group's root to the table's."""
    levels = _levels(leaves, rise, carried)
    subroots = placed(_roots(levels, rise).select("g", "subroot", F.lit("").alias("all")), "all", "g").select(F.col("all").alias("g"), "pos", "n", F.col("subroot").alias("hash"), F.col("g").alias("group"))
    ranked = written(subroots)
    over = _levels(ranked.select("g", "pos", "n", "hash"), rise)
    crown = _roots(over, rise).select("g", F.lit(None).cast(PATH).alias("none"), "subroot").select("g", F.coalesce("none", F.array().cast(PATH)).alias("path"), F.lit("").alias("subroot"), F.col("subroot").alias("root"))
    paths = _below(_with_paths(over, crown, rise), rise).select(F.col("block").alias("pos"), "path", "root")
    return levels, ranked.join(paths, "pos").select(F.col("group").alias("g"), "path", F.col("hash").alias("subroot"), "root")


def _leaves(docs: DataFrame, group: str, changed: Column, text: Column) -> DataFrame:
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("hash"), F.when(changed, leaf(text)).alias("edited"))
    return placed(rows, "g", "doc_id", "hash")


def _visited(docs: DataFrame, changed: Column, text: Column, group: str, rise: int, told: Callable[..., tuple], schema: str) -> DataFrame:
    """A row for each leaf: what is ``told`` of its id, hash, group's root, root, path, and the nodes of its version."""
    path = scratch_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        levels, top = _tree(_leaves(docs, group, changed, text), rise, ("doc_id", "edited"))

        def rows(source: Iterator[tuple]) -> Iterator[tuple]:
            for nodes, n, above, subroot, root in source:
                tree = Tree([x["hash"] for x in nodes], rise_of(n, rise))
                upper = [(p["at"], p["others"]) for p in above]
                for i, x in enumerate(nodes):
                    whole = tree.path(i) + upper
                    yield told(x["doc_id"], x["hash"], subroot, root, whole, copied(x["edited"] or x["hash"], whole))

        blocks = _with_paths(levels, top, rise).select("nodes", "n", "path", "subroot", "root")
        return written(mapped(blocks, rows, schema), path, keep=True)


def versions(docs: DataFrame, changed: Column, text: Column, group: str = "lang", rise: int = RISE) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, leaf, subroot, root``, the leaf's ``path`` (place and siblings on each level), and
    ``copied``, the nodes of its version, from the leaf to the root. Where ``changed`` holds the version has ``text`` in place of the row's text."""

    def told(doc_id: int | None, hashed: str, subroot: str, root: str, whole: list, nodes: list[str]) -> tuple:
        return doc_id, hashed, subroot, root, [{"at": a, "others": o} for a, o in whole], nodes

    return _visited(docs, changed, text, group, rise, told, f"doc_id long, leaf string, subroot string, root string, path {PATH}, copied array<string>")


def manifest(docs: DataFrame, group: str = "lang", rise: int = RISE) -> DataFrame:
    """All nodes of the tree below the groups' roots: ``g`` (``=`` and the group, empty for null), ``level``, ``nth`` and ``hash``."""
    path = scratch_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        levels = _levels(_leaves(docs, group, F.lit(False), F.col("text")), rise)

        def told(stage: int):
            def rows(source: Iterator[tuple]) -> Iterator[tuple]:
                for g, block, nodes, n in source:
                    for up, level in enumerate(Tree([x["hash"] for x in nodes], rise_of(n, rise)).levels):
                        if up or not stage:  # the first level of a higher stage was the last one below it
                            for i, x in enumerate(level):
                                yield g, stage * rise + up, block * RUN ** (rise - up) + i, x

            return rows

        return written(reduce(DataFrame.unionByName, (mapped(x.select("g", "block", "nodes", "n"), told(i), "g string, level int, nth long, hash string", batch=4096) for i, x in enumerate(levels))), path, keep=True)


def audit(docs: DataFrame, share: int = 3, rise: int = RISE) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, where ``share`` divides the crc32 of the decimal id
    after a change that makes the letters A to Z of the text small."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % share == 0

    def told(doc_id: int | None, hashed: str, subroot: str, root: str, whole: list, nodes: list[str]) -> tuple:
        return doc_id, hashed, subroot, root, digest([x for _, others in whole for x in others]), nodes[-1], nodes[-1] == root

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _visited(docs, hit, lower_ascii(F.col("text")), "lang", rise, told, schema)
