"""Removal of long repeated byte strings, by a logarithmic family of suffix arrays.

A byte goes if some ``length``-byte string that covers it also starts earlier (in a smaller ``doc_id``, or before it in the
same document). Strings are judged on the input texts in UTF-8 and never cross documents.

1. Each window of ``length`` bytes is named by its anchor, the leftmost least hash among its inner ``GRAM``-byte strings.
   Equal windows have equal anchors at equal places, so windows need comparing only under one anchor hash. Windows in a
   row with one anchor are a segment; its span of bytes is hashed, and equal segments collapse inside a task before
   anything is shuffled, and after the shuffle by anchor hash again. A segment whose anchor hash occurs nowhere else ends here.
2. Where different segments share an anchor hash (the edges of repeated passages, mostly), their windows are compared as
   text. Each shard takes its segments in document order, in batches. A batch gets a suffix array (its windows, sorted to
   ``length`` bytes; equal neighbours are long matches), which is merge-scanned against the sorted arrays of the existing
   levels. What is new becomes a level, and levels merge while the last is as large as the one before.

A key under which very many segments meet (a passage that a third of all documents share) is dealt by single windows
instead. Texts below ``length`` bytes keep everything. A null text is empty. A text is judged by itself and by those of smaller ids:
rows that share an id and differ in text (told apart by a hash of the text) remove nothing from each other, and equal rows get equal results. Rows with
a null id keep everything and remove nothing elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from segue.llm.common import mapped, scratch, scratch_dir, tidied, written

LENGTH, GRAM = 100, 24
#: Odd multipliers of the hashes.
A64, M64 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def segments(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...] | None:
    """First window, windows and anchor hash of each segment."""
    if len(raw) < length:
        return None
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    for s in (1, 2, 4):
        b = b[:-s] | (b[s:] << np.uint64(8 * s))
    m = len(raw) - GRAM + 1
    h = b[:m] * A64
    h ^= h >> np.uint64(32)
    for at in (8, 16):
        h += b[at : at + m]
        h *= M64
        h ^= h >> np.uint64(29)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size < width:  # window minima, by doubling
        by = min(size, width - size)
        least = np.minimum(least[:-by], least[by:])
        size += by
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return first, np.diff(np.r_[first, len(anchor)]), h[anchor[first]].view(np.int64)


def _runs(doc: np.ndarray, of: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of windows, joined where one follows on another in the same text; sorted by document, text and first window."""
    if not len(doc):
        return doc, of, first, size
    order = np.lexsort((first, of, doc))
    doc, of, first, size = doc[order], of[order], first[order], size[order]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]) | (first[1:] != (first + size)[:-1])])
    return doc[head], of[head], first[head], np.add.reduceat(size, head)


#: ``key`` and ``seg`` are null for windows that are already known to repeat.
SEGMENT = "key long, seg long, doc_id long, text_hash long, first int, size int"


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text`` of the rows with an id, a null text made empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where("doc_id is not null")


def _batch(names: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) if isinstance(c, np.ndarray) else c.cast(kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """All segments; equal ones met in one batch of rows are collapsed into the first and removed stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                found: list[tuple[np.ndarray, ...]] = []
                raws: list[bytes] = []
                for doc_id, text_hash, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = text.encode()
                    cut = segments(raw, length)
                    if cut is None:
                        continue
                    first, size, key = cut
                    view = memoryview(raw)
                    seg = np.array([xxhash.xxh3_64_intdigest(view[p:q]) for p, q in zip(first.tolist(), (first + size + length - 1).tolist(), strict=True)], np.uint64)
                    found.append((key, seg.view(np.int64), np.full(len(first), doc_id), np.full(len(first), text_hash), first, size, np.full(len(first), len(raws))))
                    raws.append(raw)
                if not found:
                    continue
                key, seg, doc, own, first, size, of = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((first, own, doc, seg, key))
                key, seg, doc, own, first, size, of = (c[order] for c in (key, seg, doc, own, first, size, of))
                again = np.r_[False, (key[1:] == key[:-1]) & (seg[1:] == seg[:-1])]
                again[again] = [raws[of[i]][first[i] : first[i] + size[i] + length - 1] == raws[of[i - 1]][first[i - 1] : first[i - 1] + size[i - 1] + length - 1] for i in np.flatnonzero(again).tolist()]
                within = again & np.r_[False, (doc[1:] == doc[:-1]) & (own[1:] == own[:-1])]
                same = within & np.r_[False, first[1:] == first[:-1]]
                lowest = doc[np.maximum.accumulate(np.where(again, 0, np.arange(len(doc))))]  # the smallest id of each group, which is in order
                repeated = again & ~same & (within | (doc > lowest))
                stays = ~repeated & ~same
                yield _batch(SEGMENT, key[stays], seg[stays], doc[stays], own[stays], first[stays], size[stays])
                gone = _runs(doc[repeated], own[repeated], first[repeated], size[repeated])
                none = pa.nulls(len(gone[0]), pa.int64())
                yield _batch(SEGMENT, none, none, *gone)

    return _texts(docs).mapInArrow(tidied(run), SEGMENT)


def _judged(cut: DataFrame) -> DataFrame:
    """Per anchor hash: later equal segments are removed stretches (``key`` null); of each kind those that no smaller id and no earlier place of the text has stay open, if there are several kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the last row: key, seg, doc, text, first, and the smallest id of its kind; kinds of its key so far; the key's open rows, while it has one kind
        for b in batches:
            if not b.num_rows:
                continue
            gone = b.column(0).is_null().to_numpy(zero_copy_only=False)
            if gone.any():
                none = pa.nulls(int(gone.sum()), pa.int64())
                yield _batch(SEGMENT, none, none, *(b.column(i).to_numpy()[gone] for i in (2, 3, 4, 5)))
                b = b.filter(pa.array(~gone))
                if not b.num_rows:
                    continue
            key, seg, doc, own, first, size = (b.column(i).to_numpy() for i in range(6))
            last = held[0] if held else (key[0] ^ 1, 0, 0, 0, 0, 0)
            new_key = np.r_[key[0] != last[0], key[1:] != key[:-1]]
            new = new_key | np.r_[seg[0] != last[1], seg[1:] != seg[:-1]]
            within = ~new & np.r_[(doc[0] == last[2]) & (own[0] == last[3]), (doc[1:] == doc[:-1]) & (own[1:] == own[:-1])]
            same = within & np.r_[first[0] == last[4], first[1:] == first[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lowest = np.where(at < 0, last[5], doc[np.maximum(at, 0)])
            repeated = ~same & (within | (~new & (doc > lowest)))
            stays = ~same & ~repeated
            total = np.cumsum(new)
            group = np.cumsum(new_key)  # 0 goes on from the last batch
            starts = np.r_[0, np.flatnonzero(new_key)]
            before = np.r_[-(held[1] if held else 0), total[starts[1:]] - 1]
            kinds = total - before[group]
            ends = np.r_[starts[1:], len(key)] - 1
            several = np.where(ends >= starts, kinds[np.maximum(ends, 0)], 0) > 1
            opened = stays & several[group]
            if repeated.any():
                none = pa.nulls(int(repeated.sum()), pa.int64())
                yield _batch(SEGMENT, none, none, doc[repeated], own[repeated], first[repeated], size[repeated])
            if held and held[2] and (new & (group == 0)).any():
                yield _batch(SEGMENT, *(np.array(c) for c in zip(*held[2], strict=True)))
            if opened.any():
                yield _batch(SEGMENT, key[opened], seg[opened], doc[opened], own[opened], first[opened], size[opened])
            n = int(kinds[-1])
            waiting: list[tuple] = []
            if n == 1:
                mine = np.flatnonzero(stays & (group == group[-1])).tolist()  # one, and a further one for each text that shares the smallest id
                waiting = (held[2] if held and not group[-1] else []) + [(key[i], seg[i], doc[i], own[i], first[i], size[i]) for i in mine]
            held = ((key[-1], seg[-1], doc[-1], own[-1], first[-1], lowest[-1]), n, waiting)

    parts = cut.withColumn("shard", F.coalesce("key", F.xxhash64("doc_id", "first"))).repartition("shard")
    return parts.drop("shard").sortWithinPartitions("key", "seg", "doc_id", "text_hash", "first").mapInArrow(tidied(run), SEGMENT)


class SuffixLevels:
    """Sorted arrays of distinct windows with the smallest id of each, of sizes that at least halve from one to the next."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, windows: np.ndarray, doc: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of a batch's windows (fixed-length byte strings, in order of id, text and place) occur earlier: under a smaller id, in the batch or before it, or in the same text."""
        order = np.argsort(windows, kind="stable")
        ordered, doc_, own_ = windows[order], doc[order], own[order]
        equal = np.r_[False, ordered[1:] == ordered[:-1]]  # a long match with the neighbour in the suffix array
        within = equal & np.r_[False, (doc_[1:] == doc_[:-1]) & (own_[1:] == own_[:-1])]
        heads = np.flatnonzero(~equal)
        fresh, lowest = ordered[heads], doc_[heads].copy()
        known = np.zeros(len(fresh), bool)
        for level, ids in self.levels:
            at = np.minimum(np.searchsorted(level, fresh), len(level) - 1)
            hit = level[at] == fresh
            lowest[hit] = np.minimum(lowest[hit], ids[at[hit]])
            known |= hit
        repeated = within | (doc_ > lowest[np.cumsum(~equal) - 1])
        if not known.all():
            self.levels.append((fresh[~known], lowest[~known]))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            last, ids = self.levels.pop()
            level, before = self.levels[-1]
            at = np.searchsorted(level, last)  # a merge: both are sorted
            self.levels[-1] = np.insert(level, at, last), np.insert(before, at, ids)
        out = np.empty(len(windows), bool)
        out[order] = repeated
        return out


def windows_of(raw: bytes, first: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """The windows at ``first``, ``first + 1`` ... of stretches in a buffer, as fixed-length byte strings."""
    at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)
    return np.ascontiguousarray(view[at]).view(f"S{length}").ravel()


def _compared(judged: DataFrame, docs: DataFrame, length: int, hot: int, batch_windows: int = 1 << 16, shard_windows: int = 250_000) -> DataFrame:
    """Removed stretches ``doc_id, text_hash, first, size`` among open segments, by suffix arrays."""
    spark = docs.sparkSession
    opened = judged.where("key is not null")
    n = opened.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    many = written(opened.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("hot")))  # at most a row per ``hot`` segments
    flagged = opened.join(many, "key", "left").withColumn("place", F.struct("key", "first", "size", F.coalesce("hot", F.lit(False)).alias("hot")))
    placed = flagged.groupBy("doc_id", "text_hash").agg(F.collect_list("place").alias("places"))  # as long as the text

    def cut(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text_hash, text, places in source:
            raw = text.encode()
            for p in places:
                first, size = p["first"], p["size"]
                if p["hot"]:
                    for i in range(first, first + size):
                        window = raw[i : i + length]
                        yield xxhash.xxh3_64_intdigest(window) - 2**63, doc_id, text_hash, i, 1, window
                else:
                    yield p["key"], doc_id, text_hash, first, size, raw[first : first + size + length - 1]

    joined = _texts(docs).join(placed, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places")
    rows = mapped(joined, cut, "shard long, doc_id long, text_hash long, first int, size int, raw binary", batch=4096)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // shard_windows + 1)
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("doc_id", "text_hash", "first")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, last = SuffixLevels(), None

        def judged_batch(held: list[tuple]) -> pa.RecordBatch:
            doc, own, first, size = (np.array(c) for c in list(zip(*held, strict=True))[:4])
            raw = b"".join(h[4] for h in held)
            spans = size + length - 1
            gone = levels.add(windows_of(raw, np.cumsum(spans) - spans, size, length), np.repeat(doc, size), np.repeat(own, size))
            of = np.repeat(np.arange(len(held)), size)[gone]
            at = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))[gone] + first[of]
            runs = _runs(doc[of], own[of], at, np.ones(len(at), np.int64))
            return _batch("doc_id long, text_hash long, first int, size int", *runs)

        held: list[tuple] = []
        n = 0
        for b in batches:
            for _, *at, size, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at == last:
                    continue  # an equal row
                last = at
                held.append((*at, size, raw))
                n += size
                if n >= batch_windows:
                    yield judged_batch(held)
                    held, n = [], 0
        if held:
            yield judged_batch(held)

    return dealt.mapInArrow(tidied(compared), "doc_id long, text_hash long, first int, size int")


def repeated_windows(docs: DataFrame, length: int = LENGTH, hot: int = 20_000) -> DataFrame:
    """``doc_id, text_hash, first, size``: stretches of window starts that repeat an earlier window."""
    path = scratch_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        judged = written(_judged(_cut(docs, length)))
        found = judged.where("key is null").select("doc_id", "text_hash", "first", "size").unionByName(_compared(judged, docs, length, hot))
        return written(found, path, keep=True)


def removed_spans(docs: DataFrame, name: str, length: int = LENGTH, hot: int = 20_000) -> DataFrame:
    """``docs`` with a last column of this name: the starts and ends of removed stretches, packed as ``start * 2**32 + end``, not yet joined."""
    found = repeated_windows(docs, length, hot)
    packed = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.shiftleft(F.col("first").cast("long"), 32) + F.col("first") + F.col("size") + (length - 1)).alias(name))
    mine = (docs["doc_id"].cast("long") == packed["doc_id"]) & (F.xxhash64(docs["text"]) == packed["text_hash"])  # a null text has no stretches
    return docs.join(packed, mine, "left").select(*(docs[c] for c in docs.columns), packed[name])


def kept_parts(raw: bytes, packed: list[int] | None) -> tuple[bytes, int, int]:
    """The remaining bytes, the number of removed bytes and the number of maximal removed runs."""
    if not packed:
        return raw, 0, 0
    spans = np.sort(np.array(packed, np.int64))
    start, end = spans >> 32, np.maximum.accumulate(np.minimum(spans & 0xFFFFFFFF, len(raw)))
    head = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    starts, ends = start[head], end[np.r_[head[1:], len(spans)] - 1]
    sound = starts < len(raw)
    starts, ends = starts[sound].tolist(), ends[sound].tolist()
    kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))
    return kept, len(raw) - len(kept), len(starts)


def dedup_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, spans in source:
            raw = (text or "").encode()
            kept, gone, runs = kept_parts(raw, spans)
            yield doc_id, len(raw), gone, runs, hashlib.sha256(kept).hexdigest()

    return mapped(removed_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "spans", length), rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_rows(docs: DataFrame, length: int = LENGTH, count: str = "n_removed") -> DataFrame:
    """The rows of ``docs``, with all their columns, ``text`` being what remains of it, and the number of removed bytes in a column named ``count``
    (in place of one of that name).

    Bytes of characters that were cut in two go as well.
    """
    given = docs.drop(count)
    joined = removed_spans(given, "_".join(["spans", *given.columns]), length)  # a name that no column has
    text, spans, names = joined.columns.index("text"), len(joined.columns) - 1, [*given.columns, count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                done = [kept_parts((t or "").encode(), s) for t, s in zip(b.column(text).to_pylist(), b.column(spans).to_pylist(), strict=True)]
                columns = list(b.columns)
                columns[text] = pa.array([d[0].decode("utf-8", "ignore") for d in done], pa.string())
                columns[spans] = pa.array([d[1] for d in done], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(tidied(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + f", `{count}` long")
