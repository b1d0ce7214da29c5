"""Removal of long repeated passages of words, by doubling the length of windows level by level.

A word goes if a window of ``length`` consecutive words that covers it also starts in a document with a smaller id. Windows are judged
on the input, and never cross documents.

1. Rows with the same words are one text, whose id is the smallest; a row with a greater id loses all its words, if they fill a window.
2. First level, half of ``length``: each window of ``length`` words is stood for by the least of the windows of half its length inside it
   (by a hash of the words; the leftmost of equal ones), so a repeated window has a repeated representative, and some 7 in 100 starts
   are representatives. Those whose words occur under one id alone end here.
3. Second level, ``length``: windows whose representative survived are extended to ``length`` words, at every start, as the edges of a
   passage count. They are named by 128 bits, and the smallest id of each name decides.
4. Further levels: representatives that were repeated at one length alone are extended to twice that length (a name is the pair of
   the names of its halves), until none survives. They tell how long the repeated passage is (``longest``).

Names are counted with a combine before the shuffle, and names that recur are joined back by a join that Spark can split, so a passage that
a third of all documents hold is not one task's. A text is sent once, and only texts with candidates go on.

A null text has no words. Rows without an id keep everything and remove nothing elsewhere. Rows that share an id never remove each
other's words; each row is judged by its own words. Equal rows get equal results. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from segue.llm.common import mapped, scratch, scratch_dir, written

LENGTH = 50
#: Odd multipliers of the two lanes of a name.
LANES = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)))
SPANS = "array<struct<start:int,end:int>>"


class _Names(dict):
    """Hashes of words, of one lane; what is remembered is bounded."""

    def __init__(self, lane: int, most: int = 200_000) -> None:
        super().__init__()
        self.lane, self.most = lane, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = name = xxhash.xxh3_64_intdigest(word, self.lane)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8."""
    return text.split()


def paired(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """Names of pairs of names."""
    by, again = LANES[lane]
    h = a * by + b
    h ^= h >> np.uint64(32)
    h *= again
    return h ^ (h >> np.uint64(29))


def windows(names: np.ndarray, length: int, lane: int) -> np.ndarray:
    """The name of the window at each start, by doubling; the last two stretches may overlap."""
    if len(names) < length:
        return names[:0]
    size = 1
    while 2 * size <= length:
        names = paired(names[:-size], names[size:], lane)
        size *= 2
    return paired(names[: -(length - size)], names[length - size :], lane) if size < length else names


def representatives(half: np.ndarray, inside: int) -> np.ndarray:
    """For each window, the start of the least of the ``inside`` windows of half its length in it, the leftmost of equal ones."""
    if len(half) < inside:
        return np.zeros(0, np.int64)
    least = (half & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(half), dtype=np.uint64)
    size = 1
    while size < inside:
        by = min(size, inside - size)
        least = np.minimum(least[:-by], least[by:])
        size += by
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _signed(x: np.ndarray) -> list[int]:
    return np.ascontiguousarray(x).view(np.int64).tolist()


def _marked(docs: DataFrame, length: int) -> DataFrame:
    """For each row: hash of the text, digest of the words, their number, the digest of all kept, and the representatives with their names."""
    half, inside = length // 2, length - length // 2 + 1

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        names = _Names(0)
        for doc_id, text_hash, text in source:
            words = words_of(text)
            joined = b" ".join(words)
            whole = xxhash.xxh3_128_intdigest(joined)
            starts = named = []
            if len(words) >= length and doc_id is not None:
                at = windows(names.of(words), half, 0)
                chosen = np.unique(representatives(at, inside))
                starts, named = chosen.tolist(), _signed(at[chosen])
            yield doc_id, text_hash, (whole & 0xFFFFFFFFFFFFFFFF) - 2**63, (whole >> 64) - 2**63, len(words), hashlib.sha256(joined).hexdigest(), starts, named

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return mapped(texts, rows, "doc_id long, text_hash long, a long, b long, n_words int, whole string, starts array<int>, names array<long>")


def _recurring(rows: DataFrame, *name: str) -> DataFrame:
    """The names that occur under several ids, with the smallest (``low``); written, so that Spark can split what is joined with them."""
    return written(rows.groupBy(*name).agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select(*name, "low"))


def _extended(docs: DataFrame, live: DataFrame, length: int) -> DataFrame:
    """For each text with a surviving representative: its bytes, and its windows (start, names, whether it is a representative itself)."""
    half, inside = length // 2, length - length // 2 + 1

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        lanes = _Names(0), _Names(1)
        for first, a, text, survived in source:
            words = words_of(text)
            if (xxhash.xxh3_128_intdigest(b" ".join(words)) & 0xFFFFFFFFFFFFFFFF) - 2**63 != a:
                continue  # another text of the same id
            one, two = (names.of(words) for names in lanes)
            chosen = representatives(windows(one, half, 0), inside)
            starts = np.flatnonzero(np.isin(chosen, survived))
            if not len(starts):
                continue
            marks = np.isin(starts, survived)
            yield first, a, text, starts.tolist(), _signed(windows(one, length, 0)[starts]), _signed(windows(two, length, 1)[starts]), marks.tolist()

    texts = docs.select(F.col("doc_id").cast("long").alias("first"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    joined = texts.join(live, "first").select("first", "a", "text", "live")
    return mapped(joined, rows, "first long, a long, text binary, starts array<int>, one array<long>, two array<long>, marks array<boolean>", batch=64)


def _doubled(state: DataFrame, size: int) -> DataFrame:
    """The same texts with names of twice the length, where both halves are there; ``live`` are the representatives that can go on."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for first, a, at, names, live in source:
            order = np.argsort(np.array(at, np.int64), kind="stable")
            starts, named = np.array(at, np.int64)[order], np.array(names, np.int64).view(np.uint64)[order]
            then = np.minimum(np.searchsorted(starts, starts + size), len(starts) - 1)
            both = starts[then] == starts + size
            following = starts[both]
            going = np.flatnonzero(np.isin(following, live))
            if len(going):
                doubled = _signed(paired(named[both], named[then[both]], 0))
                yield first, a, following.tolist(), doubled, following[going].tolist(), [doubled[i] for i in going.tolist()]

    return mapped(state.select("first", "a", "starts", "names", "live"), rows, "first long, a long, starts array<int>, names array<long>, tried array<int>, tried_names array<long>", batch=64)


def _alive(rows: DataFrame) -> DataFrame:
    """``first, a, live``: of the rows (first, a, start, name) those whose name recurs, by text."""
    return rows.join(_recurring(rows, "name"), "name", "left_semi").groupBy("first", "a").agg(F.collect_set("start").alias("live"))


def _longest(judged: DataFrame, length: int) -> DataFrame:
    """``first, a, longest``: how far the representatives of each text could be doubled."""
    state = written(judged.where("exists(windows, x -> x.mark)").select(
        "first", "a", F.col("windows.start").alias("starts"), F.col("windows.one").alias("names"), F.expr("filter(windows, x -> x.mark).start").alias("live")))
    size, reached = length, state.select("first", "a", F.lit(length).alias("longest"))
    while True:
        tried = written(_doubled(state, size))
        live = written(_alive(tried.select("first", "a", F.inline(F.arrays_zip(F.col("tried").alias("start"), F.col("tried_names").alias("name"))))))
        if live.isEmpty():
            return reached.groupBy("first", "a").agg(F.max("longest").alias("longest"))
        size *= 2
        reached = reached.unionByName(live.select("first", "a", F.lit(size).alias("longest")))
        state = tried.join(live, ["first", "a"])


def _kept(words: list[bytes], starts: list[int], length: int) -> tuple[list[tuple[int, int]], list[bytes]]:
    """The removed stretches of words, and the words that stay."""
    at = np.unique(np.array(starts, np.int64))
    head = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + length])
    spans = list(zip(at[head].tolist(), (at[np.r_[head[1:], len(at)] - 1] + length).tolist(), strict=True))
    stay = [w for p, q in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(words)], strict=True) for w in words[p:q]]
    return spans, stay


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, text_hash`` (``xxhash64(text)``), ``n_words, n_removed, kept_sha256``, ``spans`` (start and
    end of each stretch of removed words), and ``longest``: the greatest length, in doublings of ``length``, at which a representative
    window of the text recurs under another id (of a later copy: that of the text; 0 if none)."""
    path = scratch_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        marked = written(_marked(docs, length))
        texts = written(marked.where("doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        chosen = written(marked.join(texts.select(F.col("first").alias("doc_id"), "a", "b"), ["doc_id", "a", "b"], "left_semi").where("size(starts) > 0").select(F.col("doc_id").alias("first"), "a", "starts", "names"))
        live = written(_alive(chosen.select("first", "a", F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("names").alias("name"))))))
        opened = written(_extended(docs, live, length))
        rows = opened.select("first", "a", F.inline(F.arrays_zip(F.col("starts").alias("start"), "one", "two", F.col("marks").alias("mark"))))
        hits = rows.join(_recurring(rows, "one", "two"), ["one", "two"]).select("first", "a", F.struct("start", "one", "mark", (F.col("first") > F.col("low")).alias("gone")).alias("window"))
        judged = written(hits.groupBy("first", "a").agg(F.collect_set("window").alias("windows")))
        longest = _longest(judged, length)

        def cut(source: Iterator[tuple]) -> Iterator[tuple]:
            for first, a, text, gone in source:
                words = words_of(text)
                spans, stay = _kept(words, gone, length)
                yield first, a, len(words) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest(), [{"start": s, "end": e} for s, e in spans]

        gone = judged.where("exists(windows, x -> x.gone)").select("first", "a", F.expr("filter(windows, x -> x.gone).start").alias("gone"))
        done = mapped(opened.select("first", "a", "text").join(gone, ["first", "a"]), cut, f"first long, a long, n_removed int, kept string, spans {SPANS}").dropDuplicates(["first", "a"])
        told = texts.join(longest, ["first", "a"], "left").join(done, ["first", "a"], "left")
        late = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= length)
        own = F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("first"))
        every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
        none = F.array().cast(SPANS)
        out = marked.drop("starts", "names").join(told, ["a", "b"], "left").select(
            "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"),
            F.when(late, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
            F.when(late, F.sha2(F.lit(""), 256)).when(own, F.coalesce("kept", "whole")).otherwise(F.col("whole")).alias("kept_sha256"),
            F.when(late, every).when(own, F.coalesce("spans", none)).otherwise(none).alias("spans"),
            F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.coalesce("longest", F.lit(0)), F.when((F.col("first") < F.col("last")) & (F.col("n_words") >= length), F.lit(length)).otherwise(0))).alias("longest"),
        )
        return written(out, path, keep=True)


def dedup_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, longest`` for each row."""
    return repeated_passages(docs, length).select("doc_id", "n_words", "n_removed", "kept_sha256", "longest")


def dedup_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` being the words that remain, joined by one space; texts of which nothing goes stay as they are."""
    found = repeated_passages(docs, length).where("n_removed > 0").select(F.col("doc_id").cast("long").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_hash"])
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bounds = F.concat(F.array(F.lit(0)), F.col("_spans.end")), F.concat(F.col("_spans.start"), F.array(F.size(words)))
    stay = F.array_join(F.flatten(F.transform(F.arrays_zip(bounds[0].alias("p"), bounds[1].alias("q")), lambda z: F.slice(words, z["p"] + 1, z["q"] - z["p"]))), " ")
    joined = docs.join(found, (docs["doc_id"].cast("long") == found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"]), "left")
    return joined.select(*(F.when(F.col("_spans").isNotNull(), stay).otherwise(docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns))
