"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the least hash among its inner substrings of length ``s`` is at its first or last
place. That depends on the k-mer alone, so an anchor survives any change outside its own ``k`` characters, and two
consecutive anchors are never more than ``k - s`` apart. A fingerprint is the Base64 text of the anchors' 32-bit hashes (4
bytes each, little-endian) and then of their distances (1 byte each). A text that is not empty but has no anchor (shorter
than ``k``, as a rule) has one, the whole text; the empty text (or null) has none.

The likeness of two fingerprints is ``2 m / (a + b)``, with ``m`` the anchors in common: the i-th occurrence of a hash
matches the i-th in the other, and of the matches the longest sequence in the same order in both counts. Two empty
fingerprints have likeness 1, an empty one and another 0.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from segue.llm.common import id_text, mapped

K, S = 20, 5
#: Odd multipliers of the hashes.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and 32-bit hashes of a text's closed syncmers."""
    if k % s or not 0 < k - s < 256:
        raise ValueError("k must be a multiple of s, and k - s below 256")
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(codes)
    if n >= k:
        h = codes[: n - s + 1].copy()
        for i in range(1, s):
            h *= STEP
            h += codes[i : n - s + 1 + i]
        h = _mixed(h * STEP)
        w = k - s + 1
        least, size = h, 1
        while size < w:  # window minima, by doubling
            by = min(size, w - size)
            least = np.minimum(least[:-by], least[by:])
            size += by
        at = np.flatnonzero((h[: len(least)] == least) | (h[w - 1 :] == least))
        if len(at):
            whole = h[at]
            for i in range(s, k, s):
                whole = whole * STEP + h[at + i]
            return at, (_mixed(whole) >> np.uint64(32)).astype(np.uint32)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(text.encode(), digest_size=4).digest(), "<u4")


def packed(found: tuple[np.ndarray, np.ndarray]) -> str:
    at, hashes = found
    return base64.b64encode(hashes.astype("<u4").tobytes() + np.diff(at, prepend=0).astype(np.uint8).tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    n = len(raw) // 5
    return np.cumsum(np.frombuffer(raw[4 * n :], np.uint8).astype(np.int64)), np.frombuffer(raw[: 4 * n], "<u4")


def _keyed(hashes: np.ndarray) -> np.ndarray:
    """Each hash with the number of its occurrence."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    number = np.arange(len(hashes)) - np.repeat(first, np.diff(np.r_[first, len(hashes)]))
    out = np.empty(len(hashes), np.uint64)
    out[order] = ordered.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(_keyed(a[1]), _keyed(b[1]), assume_unique=True, return_indices=True)
    j = j[np.argsort(i)]
    m = len(j)
    if (j[1:] < j[:-1]).any():
        chain: list[int] = []
        for x in j.tolist():
            at = bisect_left(chain, x)
            chain[at : at + 1] = [x]
        m = len(chain)
    return 2.0 * m / (len(a[0]) + len(b[0]))


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of whole texts; no shuffle."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in source:
            yield doc_id, len(text), packed(anchors(text, k, s))

    return mapped(id_text(docs), rows, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many characters from the start of the following text, or by all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def edit_comparison(docs: DataFrame, rows_per_bucket: int = 1500, most_ranges: int = 65_536, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of each text and of its edited text, compared with each other and with the next document's.

    The next document has the next smaller ``doc_id``; after the last comes the first. Null ids come last and equal ids
    by text. Texts are dealt once, by ranges of ids: each range also gets the first document of the range that follows,
    so no window spans the table. The driver sees one id per range, ``most_ranges`` at most; beyond that ranges grow, and Spark
    sorts each on disk.
    """
    spark, texts = docs.sparkSession, id_text(docs)
    ids = texts.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    n = ids.count()
    ranges = max(1, min(most_ranges, n // rows_per_bucket))
    bounds = sorted(set(ids.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    cuts = np.array(bounds[::-1])

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts[::-1], key.to_numpy().astype(float), side="right")).astype(np.int32))

    firsts = {r["range"]: r["first"] for r in ids.select(range_of("key").alias("range"), "key").groupBy("range").agg(F.max("key").alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}  # the first document of a range also goes to the range before; the very first to the last
    keyed = texts.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "doc_id", "text").withColumn("range", range_of("key"))
    lead = spark.createDataFrame([(k_, r) for k_, r in before.items()], "key long, before int") if before else None
    if lead is None:
        dealt = keyed.select("range", F.lit(False).alias("lead"), "key", "doc_id", "text")
    else:
        also = F.broadcast(lead)  # a row per range, most_ranges at most
        copies = F.filter(F.array(F.struct("range", F.lit(False).alias("lead")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(True).alias("lead")))), lambda x: x.isNotNull())
        dealt = keyed.join(also, "key", "left").select(F.inline(copies).alias("range", "lead"), "key", "doc_id", "text")
    parts = max(1, min(ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 8)))
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "lead", F.desc("key"), "text")

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for at, lead, _, doc_id, text in source:
            if held is None and lead:
                continue  # a further document with the same id
            found = anchors(text, k, s)
            if held is not None and held[0] == at:
                _, own_id, own, marks = held
                other = edited(own, text)
                changed = anchors(other, k, s)
                yield own_id, len(own), hashlib.sha256(other.encode()).hexdigest(), packed(marks), packed(changed), likeness(marks, changed), likeness(marks, found)
            held = None if lead else (at, doc_id, text, found)

    return mapped(dealt, rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
