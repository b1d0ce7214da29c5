"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a document's set is its distinct shingles of ``width`` words (with
fewer words, the whole sequence as one). Two fixed permutations of 32-bit values make all signature coordinates: the
first scatters the shingles, the second is applied after a circular shift by the coordinate's number.

Equal sets form classes, of which one document (the smallest id) goes on. Its bands name buckets. Of the documents that begin
or end its buckets, a member is verified against the two with which it shares the most; components of the verified links
follow. Only the members of buckets that still hold several components go on: those of different components that share one of
their rarest shingles (so many of them that no link can be missed) have their signatures compared, in blocks; the likeliest
pair of each document is verified, and then each document is compared, by full sets, with every member of a component of which
some member agrees in at least ``prune`` of the coordinates (five standard deviations below the threshold). So documents of one
template that are not linked, which fill each other's buckets, meet only in what they have in common beyond it. Every link
counted was found by comparing full sets.

Documents without words, or with a null text, have an empty set and link with nothing; rows with a null id take no part
(their component is null). Repeated rows are one member of a class; ids must tell different texts apart, and where they do not,
one of the texts is compared for all. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from segue.llm.common import id_text, mapped, scratch, scratch_dir, small_batches, tidied, written
from segue.llm.components import components
from segue.llm.merkle import placed

BANDS, ROWS = 32, 4
#: Coordinates of a signature; the bands take the first ``BANDS * ROWS``. The lowest byte of each of them estimates a likeness,
#: never too low, as what agrees in whole agrees there.
COORDINATES = 256
#: Odd multipliers of the hashes.
A64, M64 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and these six characters alone part words
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(width, len(h))))
    for i in range(min(width, len(h))):
        out = (out * A64) ^ h[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * M64
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(found: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """``size`` coordinates: the least second-permuted value after the first permutation and each circular shift.

    Both permutations are of 32-bit values (odd products and exclusive-or shifts can be undone), and all shifts of a
    few hundred shingles are permuted at once.
    """
    first = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    first *= np.uint32(0x85EBCA6B)
    first ^= first >> np.uint32(13)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 256):
        x = first[None, at : at + 256] + shifts
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def bands(sign: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A 64-bit bucket for each band, the band's number included."""
    return [int.from_bytes(hashlib.blake2b(i.to_bytes(2, "little") + b.tobytes(), digest_size=8).digest(), "little", signed=True) for i, b in enumerate(sign[: n_bands * rows].reshape(n_bands, rows))]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_key binary, signature binary, low binary``; no shuffle. ``signature`` has what the bands take, ``low`` a byte of each coordinate."""

    def made(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in source:
            found = shingle_set(text, width)
            sign = signature(found)
            told = (sign[: BANDS * ROWS].tobytes(), sign.astype(np.uint8).tobytes()) if len(found) else (None, None)
            yield doc_id, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), *told

    return mapped(id_text(docs), made, "doc_id long, n_shingles long, set_key binary, signature binary, low binary")


def _buckets(members: DataFrame) -> DataFrame:
    """``bucket, rep`` of each member's bands."""

    def made(source: Iterator[tuple]) -> Iterator[tuple]:
        for rep, sign in source:
            for b in bands(np.frombuffer(sign, np.uint32)):
                yield b, rep

    return mapped(members.select("rep", "signature"), made, "bucket long, rep long", batch=8192)


def _with_few(df: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` whose key is among the ids: broadcast up to ``most`` ids (8 MB, repeats counted), by a shuffle of the distinct ones beyond."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids.distinct(), key, "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``doc_id, found``: the full sets of some documents, made again from their texts.

    They are written, so that what joins them is a plain shuffle on both sides: Spark then splits the tasks of an id with very many pairs.
    """

    def made(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in source:
            yield doc_id, shingle_set(text, width).tobytes()

    wanted = _with_few(id_text(docs), written(ids), "doc_id")
    return written(mapped(wanted.select("doc_id", "text"), made, "doc_id long, found binary").dropDuplicates(["doc_id"]))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach ``100 * intersection >= percent * union``."""
    pairs = written(pairs)
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), width)
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y"))

    def kept(source: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, fa, fb in source:
            x, y = np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64)
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                yield a, b

    with small_batches(docs.sparkSession):  # two sets a row
        return written(mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), kept, "a long, b long"))


def links_to_components(wanted: DataFrame, members: DataFrame, docs: DataFrame, width: int, percent: int, block: int = 256) -> DataFrame:
    """Verified links ``a, b`` between documents and components: one for each ``rep, target`` of ``wanted`` and block that has one.

    ``members`` is ``rep, component``. A component's members are dealt into blocks, and a document goes to each block of its
    targets, where its full set is compared with all the block's at once; no pair without a link leaves the task.
    """
    wanted = written(wanted)
    inside = written(members.join(wanted.select(F.col("target").alias("component")).distinct(), "component", "left_semi").select("component", "rep"))
    sets = _sets(docs, inside.select(F.col("rep").alias("doc_id")).unionByName(wanted.select(F.col("rep").alias("doc_id"))), width).withColumnRenamed("doc_id", "rep")
    blocks = written(inside.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    own = inside.join(blocks, "component").select("component", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "rep")
    asking = wanted.withColumnRenamed("target", "component").join(blocks, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "rep")
    dealt = own.unionByName(asking).join(sets, "rep").select("component", "block", "asks", "rep", "found").repartition("component", "block").sortWithinPartitions("component", "block", "asks", "rep")

    def made(source: Iterator[tuple]) -> Iterator[tuple]:
        at, reps, sets_, flat = None, [], [], None
        for component, number, asks, rep, found in source:
            if at != (component, number):
                at, reps, sets_, flat = (component, number), [], [], None
            mine = np.frombuffer(found, np.uint64)
            if not asks:
                reps.append(rep)
                sets_.append(mine)
                continue
            if flat is None:
                sizes = np.array([len(x) for x in sets_])
                flat, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), sizes)
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            both = np.bincount(owner[hit], minlength=len(sets_))
            linked = np.flatnonzero(100 * both >= percent * (sizes + len(mine) - both))
            if len(linked):
                yield min(rep, reps[linked[0]]), max(rep, reps[linked[0]])

    with small_batches(docs.sparkSession):
        return written(mapped(dealt, made, "a long, b long").distinct())


#: Counters of the sketch that puts shingles in an order, rare ones first, and how many of them go into one row.
SLOTS, CHUNK = 1 << 20, 1 << 14


def _rarities(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each slot of a hash occur: a table of fixed size (4 MB), the only thing that goes to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for found in b.column(0).to_pylist():
                slots, times = np.unique(np.frombuffer(found, np.uint64) & np.uint64(SLOTS - 1), return_counts=True)
                total[slots.astype(np.int64)] += times
        chunks = [(i, c.tobytes()) for i, c in enumerate(total.reshape(-1, CHUNK)) if c.any()]
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*chunks, strict=True)], names=["chunk", "counts"])

    def summed(source: Iterator[tuple]) -> Iterator[tuple]:
        for chunk, group in itertools.groupby(source, key=lambda r: r[0]):
            total = np.zeros(CHUNK, np.int64)
            for _, counts in group:
                total += np.frombuffer(counts, np.int64)
            yield chunk, np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()

    parts = sets.select("found").mapInArrow(tidied(counted), "chunk long, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros((SLOTS // CHUNK, CHUNK), np.int32)
    for r in mapped(parts, summed, "chunk long, counts binary").collect():  # at most SLOTS / CHUNK rows
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``bucket, rep``: the rarest shingles of each set, so many that two sets whose likeness reaches the threshold share one of them.

    Such sets share ``ceil(percent * n / 100)`` shingles at least, ``n`` being the size of either; so in any order of all shingles
    the first ``n - ceil(percent * n / 100) + 1`` of both have one in common. The order is by rarity and then by hash.
    """
    rare = sets.sparkSession.sparkContext.broadcast(_rarities(sets))  # a fixed size

    def made(source: Iterator[tuple]) -> Iterator[tuple]:
        for rep, found in source:
            x = np.frombuffer(found, np.uint64)
            n = len(x) + (-percent * len(x)) // 100 + 1
            first = np.lexsort((x, rare.value[(x & np.uint64(SLOTS - 1)).astype(np.int64)]))[:n]
            yield from ((t, rep) for t in x[first].view(np.int64).tolist())

    return mapped(sets.select(F.col("doc_id").alias("rep"), "found"), made, "bucket long, rep long", batch=8192)


def _dealt(open_buckets: DataFrame, block: int) -> DataFrame:
    """``bucket, rep, component, low, own, mine, kind, x, y``: who meets in which task of a bucket.

    The largest component's members (``own``) and the others are dealt into blocks apart. Each block of the one meets each
    block of the other (kind 0), and the others' blocks meet each other and themselves (kind 1), so a task holds two blocks.
    """
    sizes = open_buckets.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = written(sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("every")))
    count = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    known = open_buckets.join(main, "bucket").withColumn("own", F.col("component") == F.col("main")).withColumn("ms", count(F.col("n"))).withColumn("ks", count(F.col("every") - F.col("n")))
    known = known.withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("ms")).otherwise(F.col("ks"))).cast("int"))
    task = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    mine = F.col("mine")
    of_main = F.transform(F.sequence(F.lit(0), F.col("ks") - 1), lambda k: task(0, mine, k))
    of_others = F.concat(F.transform(F.sequence(F.lit(0), F.col("ms") - 1), lambda m: task(0, m, mine)), F.transform(F.sequence(F.lit(0), F.col("ks") - 1), lambda k: task(1, F.least(mine, k), F.greatest(mine, k))))
    return known.select("bucket", "rep", "component", "low", "own", "mine", F.explode(F.when(F.col("own"), of_main).otherwise(of_others)).alias("task")).select("bucket", "rep", "component", "low", "own", "mine", "task.*")


def _across(open_buckets: DataFrame, prune: float, best: bool, block: int = 512) -> DataFrame:
    """What may be linked across components in one bucket, by signatures, ``bucket, rep, component, low`` given.

    A task holds two blocks of a bucket's members, compared as matrices. With ``best``, the result is the likeliest pair
    ``a, b`` in a task of each member outside the largest component; without, it is ``a``, such a member, and ``b``, a
    component that may hold a link.
    """
    dealt = _dealt(open_buckets, block).repartition("bucket", "kind", "x", "y").sortWithinPartitions("bucket", "kind", "x", "y", F.desc("own"), "rep")

    def pairs(group: list[tuple], kind: int, apart: bool) -> Iterator[tuple]:
        reps = np.array([g[0] for g in group])
        comps = np.array([g[1] for g in group])
        own = np.array([g[3] for g in group])
        mine = np.array([g[4] for g in group])
        signs = np.frombuffer(b"".join(g[2] for g in group), np.uint8).reshape(len(group), -1)
        for i in np.flatnonzero(~own):
            others = comps != comps[i]
            if kind == 0:
                others &= own
            else:
                others &= reps > reps[i]
                if apart:
                    others &= mine != mine[i]  # pairs within a block are compared where it meets itself
            at = np.flatnonzero(others)
            if not len(at):
                continue
            near = (signs[at] == signs[i]).mean(axis=1)
            if near.max() < prune:
                continue
            if best:
                j = at[near.argmax()]
                yield int(min(reps[i], reps[j])), int(max(reps[i], reps[j]))
            else:
                yield from ((int(reps[i]), int(c)) for c in np.unique(comps[at[near >= prune]]))

    def made(source: Iterator[tuple]) -> Iterator[tuple]:
        group, at = [], None
        for bucket, rep, component, sign, own, mine, kind, x, y in source:
            if at != (bucket, kind, x, y):
                if group:
                    yield from pairs(group, at[1], at[2] != at[3])
                group, at = [], (bucket, kind, x, y)
            group.append((rep, component, sign, own, mine))
        if group:
            yield from pairs(group, at[1], at[2] != at[3])

    return mapped(dealt.select("bucket", "rep", "component", "low", "own", "mine", "kind", "x", "y"), made, "a long, b long", batch=8192).distinct()


def _open_members(shared: DataFrame, components_: DataFrame) -> DataFrame:
    """``rep, component`` of the members of buckets that hold several components."""
    labelled = written(_labelled(shared.select("bucket", "rep"), components_))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first != last").select("bucket")
    return written(labelled.join(written(several), "bucket", "left_semi").select("rep", "component").distinct())


def _labelled(members: DataFrame, components_: DataFrame) -> DataFrame:
    """Rows with a ``rep``, with its component, which is itself where it has no link."""
    return members.join(components_.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 512, set_block: int = 256) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept, n_links`` for each row of ``docs``.

    ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest id reachable over links, and
    ``n_links`` the number of verified links that the class has (pairs inside a component that is already known are not verified).
    ``block`` and ``set_block`` bound how many signatures and full sets a task compares at once; results do not depend on them.
    """
    spark = docs.sparkSession
    known_path, placed_path = scratch_dir(spark), scratch_dir(spark)
    with scratch(spark):
        share = percent / 100
        prune = max(0.0, share - 5 * (share * (1 - share) / COORDINATES) ** 0.5)
        known = written(sketches(docs, width), known_path, keep=True)
        classes = written(known.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("signature").alias("signature"), F.max("low").alias("low")).where("rep is not null"))
        buckets = written(_buckets(classes))
        ends = buckets.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high")
        shared = written(buckets.join(ends, "bucket"))
        # Of the documents that begin or end its buckets, a member is first verified against those with which it shares the most.
        # A member has a row for each band, so its rows are dealt by it once and counted where they land.
        dealt = shared.select("rep", "low", "high").repartition("rep").select("rep", F.posexplode(F.array("low", "high")).alias("end", "other")).where("rep != other")
        most = dealt.groupBy("rep", "end", "other").agg(F.count("*").alias("n")).groupBy("rep", "end").agg(F.max_by("other", F.struct("n", "other")).alias("other"))
        stars = most.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        links = verified(stars, docs, width, percent)
        found = components(links)
        open_members = _open_members(shared, found)
        if open_members.limit(1).count():
            prefixes = written(_prefixes(_sets(docs, open_members.select(F.col("rep").alias("doc_id")), width), percent))
            for best in (True, False):
                meeting = _labelled(prefixes, found)
                several = written(meeting.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first != last").select("bucket"))
                open_buckets = written(meeting.join(several, "bucket", "left_semi").join(classes.select("rep", "low"), "rep"))
                if not open_buckets.limit(1).count():
                    break
                with small_batches(spark, 4000):
                    near = written(_across(open_buckets, prune, best, block))
                if best:
                    more = verified(near, docs, width, percent)
                else:
                    more = links_to_components(near.toDF("rep", "target"), _labelled(classes.select("rep"), found), docs, width, percent, set_block)
                if more.limit(1).count():
                    links = links.unionByName(more)
                    found = components(links)
        counted = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        placed = _labelled(classes.select("set_key", "rep"), found).join(counted, "rep", "left")
        placed = written(placed.select("set_key", "rep", "component", "n_links"), placed_path, keep=True)
    return known.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(placed, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "rep", "doc_id")).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def own_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``own``: the id, unless a row with another text has it too; then all but one of these texts get ids of their own, after all others."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash.alias("hash")).where("id is not null")
    several = ids.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low != high")
    more = written(ids.join(several.select("id", "low"), "id").where("hash != low").select("id", "hash").distinct())
    if more.isEmpty():
        return docs.withColumn("own", F.col("doc_id").cast("long"))
    last = ids.agg(F.max("id")).first()[0]
    numbered = placed(more.withColumn("all", F.lit("")), "all", "id", "hash").select("id", "hash", (F.col("pos") + (last + 1)).alias("extra"))
    joined = docs.join(numbered, (docs["doc_id"].cast("long") == numbered["id"]) & (text_hash == numbered["hash"]), "left")
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce("extra", docs["doc_id"].cast("long")).alias("own"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay if one text of each group of near-duplicates does: that with the smallest id.

    Rows with one id and one text are one document, of which one row stays; of texts that share an id each is judged by itself, the further
    ones as if they came after all other ids. Rows without an id all stay. A column ``own`` is not allowed.
    """
    path = scratch_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows = own_ids(docs)
        found = near_duplicates(rows.select(F.col("own").alias("doc_id"), "text"), width, percent).where("doc_id is not null")
        marked = written(found.groupBy(F.col("doc_id").alias("own")).agg(F.count("*").alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept"))
        repeated = rows.join(marked.where("kept").select("own"), "own", "left_semi").dropDuplicates(["own"])
        return written(rows.join(marked.select("own"), "own", "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns)), path, keep=True)
