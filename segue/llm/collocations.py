"""Phrases whose words keep together, mined by Rabin-Karp fingerprints.

Texts are lower-cased (A to Z), split into pieces at punctuation and line ends, and pieces into words at spaces and tabs; phrases are of
two to ``LONGEST`` words inside a piece. Everything is counted for each language.

1. Tasks read documents in batches. Prefix sums of a polynomial over the hashes of the words give the fingerprint of every n-gram by one
   subtraction. A first pass counts the fingerprints of words and pairs of words; those that are frequent set bits in a filter of a
   fixed size, which is all that is sent to every task. A second pass counts those of longer n-grams if all pairs inside may be frequent
   (a part of a frequent phrase is frequent, so none is lost), and the frequent ones set their bits too.
2. A third pass counts n-grams that may be frequent by the filter (a full one lets more through, and results stay the same). Each batch gives
   a count for each fingerprint, after comparing the words of all its occurrences with those of the first, and that n-gram as text.
3. Spark adds up what has one text, in the task and after the shuffle, so no result rests on a fingerprint alone. N-grams that the filter tells to be
   infrequent are never written out as text, and texts are not shuffled.

The empty n-gram counts the words of a language. A null text is empty and a null language is ``und``; rows without an id, rows
that share one and equal rows all count, each by itself; further columns are ignored; an empty table has no phrases. A text may be as
long as memory for one text allows; a batch holds one text at least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from segue.llm.common import scratch, scratch_dir, tidied, written

LONGEST = 4
#: The break between pieces, a byte that UTF-8 never has.
BREAK = b"\xff"
#: What ends a piece, and the letters that become small.
ENDS, LETTERS = b".,;:!?\n\x0b\x0c\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TABLE = bytes.maketrans(LETTERS + ENDS, LETTERS.lower() + BREAK * len(ENDS))
#: The base of the polynomial (odd, so that it has an inverse), and multipliers that spread the bits.
BASE, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text: bytes) -> list[bytes]:
    """Words and breaks of a text in UTF-8."""
    return text.translate(TABLE).replace(BREAK, b" " + BREAK + b" ").split()


class _Ids(dict):
    """Numbers of words in one batch; 0 is the break."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})
        self.words = [BREAK]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 2**64)):
        powers = np.full(n, base, np.uint64)
        powers[:1] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


class Grams:
    """The n-grams of a batch of documents."""

    def __init__(self, docs: list[str], ids: list[np.ndarray], of: _Ids, bits: int = 64) -> None:
        self.of, self.ids = of, np.concatenate(ids)
        langs: dict[str, int] = {}
        lang = np.array([langs.setdefault(x, len(langs)) for x in docs], np.int32)
        self.lang, self.langs = np.repeat(lang, [len(x) for x in ids]), pa.array(list(langs))
        self.seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in langs], np.uint64)
        self.mask = np.uint64(2**bits - 1)
        forth, self.back = _powers(len(self.ids))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(of.hashes()[self.ids] * forth)])
        self.breaks = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.ids == 0, dtype=np.int32)])

    def whole(self, size: int) -> np.ndarray:
        """Where an n-gram of so many words starts."""
        last = len(self.ids) - size + 1
        return np.flatnonzero(self.breaks[size : size + last] == self.breaks[:last]) if last > 0 else np.zeros(0, np.int64)

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the n-grams at these starts, of their language."""
        h = self.prefix[at + size]
        h -= self.prefix[at]
        h *= self.back[at]
        h ^= (self.seeds + np.uint64(size))[self.lang[at]]
        h *= SPREAD
        h ^= h >> np.uint64(32)
        h *= SPREAD
        h ^= h >> np.uint64(29)
        return h & self.mask

    def counted(self, at: np.ndarray, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First start and count of each n-gram; those that share a fingerprint but not their words are told apart."""
        order = np.argsort(prints, kind="stable")
        prints, at = prints[order], at[order]
        head = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(at) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[head, len(at)])
        model = np.repeat(at[head], counts)
        same = self.lang[at] == self.lang[model]
        for j in range(size):
            same &= self.ids[at + j] == self.ids[model + j]
        firsts = at[head]
        if same.all():
            return firsts, counts
        mixed = np.unique(np.searchsorted(head, np.flatnonzero(~same), "right") - 1)
        sound = np.setdiff1d(np.arange(len(head)), mixed)
        more: dict[tuple, list[int]] = {}
        for g in mixed.tolist():
            for p in at[head[g] : head[g] + counts[g]].tolist():
                more.setdefault((int(self.lang[p]), *self.ids[p : p + size].tolist()), []).append(p)
        return np.r_[firsts[sound], np.array([v[0] for v in more.values()], np.int64)], np.r_[counts[sound], np.array([len(v) for v in more.values()], np.int64)]


def _batches(source: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[Grams]:
    docs, ids, of, n = [], [], _Ids(), 0
    for b in source:
        for at in range(0, b.num_rows, 256):
            for lang, text in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                tokens = tokens_of(text)
                docs.append(lang)
                ids.append(np.fromiter(map(of.__getitem__, (*tokens, BREAK)), np.int32, len(tokens) + 1))
                n += len(tokens) + 1
                if n >= words:
                    grams = [Grams(docs, ids, of, bits)]
                    docs, ids, of, n = [], [], _Ids(), 0
                    yield grams.pop()
    if docs:
        yield Grams(docs, ids, of, bits)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _rows(columns: dict[str, np.ndarray | pa.Array], step: int = 50_000) -> Iterator[pa.RecordBatch]:
    whole = pa.table({k: pa.array(v, pa.int64()) if isinstance(v, np.ndarray) else v for k, v in columns.items()})
    yield from whole.to_batches(step)


#: The bits of a fingerprint that the first two passes and the filter use.
PART = np.uint64(2**48 - 1)


def _first_pass(texts: DataFrame, words: int, bits: int) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in _batches(source, words, bits):
            for size in (1, 2):
                prints, n = np.unique(grams.prints(grams.whole(size), size) & PART, return_counts=True)
                yield from _rows({"fp": prints.view(np.int64), "n": n})
            del grams, prints, n  # before the next is gathered

    return texts.mapInArrow(tidied(run), "fp long, n long")


#: Where the two places of a fingerprint in the filter begin.
SHIFTS = 0, 22


class Filter:
    """A Bloom filter of ``2**bits`` bits: two places for each fingerprint."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, prints: np.ndarray) -> np.ndarray:
        found, prints = np.ones(len(prints), bool), prints & PART
        for shift in SHIFTS:
            at = (prints >> np.uint64(shift)) & self.mask
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    @staticmethod
    def of(prints: DataFrame, bits: int) -> Filter:
        """The bits are set by Spark; ``2**bits / 64`` numbers reach the driver at most."""
        places = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(2**bits - 1)) for s in SHIFTS]
        at = prints.select(F.explode(F.array(*places)).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
        out = np.zeros(2**bits // 64, np.uint64)
        out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
        return Filter(out)


def _within(grams: Grams, known: Filter) -> np.ndarray:
    """Whether a pair of words starts there that may be frequent."""
    at = grams.whole(2)
    pairs = np.zeros(len(grams.ids), bool)
    pairs[at[known.has(grams.prints(at, 2))]] = True
    return pairs


def _of_pairs(grams: Grams, pairs: np.ndarray, size: int) -> np.ndarray:
    """Where an n-gram starts of which each pair of words may be frequent."""
    at = grams.whole(size)
    return at[np.logical_and.reduce([pairs[at + j] for j in range(size - 1)])]


def _second_pass(texts: DataFrame, frequent: Broadcast, words: int, bits: int) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(frequent.value)
        for grams in _batches(source, words, bits):
            pairs = _within(grams, known)
            for size in range(3, LONGEST + 1):
                prints, n = np.unique(grams.prints(_of_pairs(grams, pairs, size), size) & PART, return_counts=True)
                yield from _rows({"fp": prints.view(np.int64), "n": n})
            del grams, pairs, prints, n

    return texts.mapInArrow(tidied(run), "fp long, n long")


def _third_pass(texts: DataFrame, frequent: Broadcast, words: int, bits: int) -> DataFrame:
    """``lang, phrase, n``: each batch's n-grams that may be frequent, the empty one for all its words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(frequent.value)
        for grams in _batches(source, words, bits):
            pairs, written_as = _within(grams, known), pa.array(grams.of.words, pa.binary())
            for size in range(LONGEST + 1):
                at = grams.whole(1) if size < 2 else _of_pairs(grams, pairs, size)
                if size == 0:
                    lang, n = np.unique(grams.lang[at], return_counts=True)
                    phrases = pa.array([""] * len(lang), pa.string())
                else:
                    prints = grams.prints(at, size)
                    may = known.has(prints)
                    firsts, n = grams.counted(at[may], size, prints[may])
                    lang = grams.lang[firsts]
                    phrases = pc.binary_join_element_wise(*(written_as.take(pa.array(grams.ids[firsts + j])) for j in range(size)), b" ").cast(pa.string())
                    del prints, may, firsts
                yield from _rows({"lang": grams.langs.take(pa.array(lang)), "phrase": phrases, "n": n})
            del grams, pairs, written_as, at, lang, phrases, n

    return texts.mapInArrow(tidied(run), "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, least: int = 30, batch_words: int = 1_200_000, filter_bits: int = 26, print_bits: int = 64, tag_bits: int = 32) -> DataFrame:  # noqa: ARG001
    """``lang, size, phrase, f``: all n-grams of one to four words that occur ``least`` times or more, and, with no words, each
    language's number of words (if it reaches ``least``). The filter takes ``2**filter_bits`` bits in each task; fingerprints have ``print_bits``.
    ``tag_bits`` is taken but not needed any more, as n-grams of different batches are told apart by their text."""
    spark, path, texts = docs.sparkSession, scratch_dir(docs.sparkSession), _texts(docs)
    with scratch(spark):
        often = lambda found: Filter.of(written(found.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fp")), filter_bits).words
        short = spark.sparkContext.broadcast(often(_first_pass(texts, batch_words, print_bits)))
        known = spark.sparkContext.broadcast(short.value | often(_second_pass(texts, short, batch_words, print_bits)))
        short.destroy()
        counted = _third_pass(texts, known, batch_words, print_bits).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
        out = written(counted.select("lang", size.cast("byte").alias("size"), "phrase", "f"), path, keep=True)
        known.destroy()
        return out


def _decimal(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of the phrases of two words and more, by the cut with the lowest score (the first of equal ones)."""
    words = F.split("phrase", " ")
    cuts = phrases.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")})
    parts = phrases.where(F.col("size").between(1, LONGEST - 1))
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # Spark's ``div`` of decimals is exact; it rounds towards zero, which is the floor here
    valued = both.withColumns({"over": _decimal("a") * F.lit(2_000_000).cast("decimal(19,0)"), "under": _decimal("l") + _decimal("r")}).withColumn("score", F.expr("over div under"))
    best = valued.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def not_contained(candidates: DataFrame, phrases: DataFrame, percent: int = 80) -> DataFrame:
    """The candidates that no longer phrase holds which occurs at least ``percent`` in 100 times as often."""
    words = F.split("phrase", " ")
    longer = phrases.where("size >= 3").select("lang", "size", "f", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inside = longer.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = F.col("longer").isNull() | (_decimal("longer") * 100 < _decimal("a") * percent)
    return candidates.join(most, ["lang", "phrase"], "left").where(kept).drop("longer")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, **batches: int) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``, by score, count and phrase."""
    path = scratch_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        phrases = frequent_phrases(docs, least, **batches)
        left = not_contained(scored(phrases), phrases)
        order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
        some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        words = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
        return written(best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), path, keep=True)
