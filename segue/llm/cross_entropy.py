"""Cross-entropy difference scoring with two matched n-gram language models.

Tokens are lower-cased runs of letters and digits and single other characters, white space aside. Both models share one
vocabulary, have the same form (bigrams, interpolated with smoothed unigrams) and count every text of their corpus whole:
the target model the documents given as in-domain, the background model all others. The score is the mean over a document's
tokens of the background model's log-probability minus the target model's, so lower scores are nearer to the target.

Every token of the documents is in the vocabulary, and every document is counted. Counts of pairs and of tokens are summed by ranges
of keys and grow with the input. Tokens and pairs are told apart by 64-bit hashes. A document's own tokens are part of the model
that it is scored against, so documents that occur often are near to it.

A null or empty text has no tokens and the score 0; equal texts have equal scores; an empty table gives an empty result, and
a target without documents a uniform model.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from segue.llm.common import id_text, mapped, written

#: Differences of log-probabilities are summed as whole numbers of this part.
UNIT = 2**30
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _marked(docs: DataFrame, target_ids: DataFrame, few_ids: int) -> DataFrame:
    """``doc_id, text, target`` for each row."""
    ids = target_ids.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    few = ids.limit(few_ids + 1).count() <= few_ids  # 8 MB or less is broadcast, more is joined by a shuffle
    marked = id_text(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left")
    if not few:
        marked = written(marked)  # rows keep their order when they are read again
    return marked.withColumn("target", F.coalesce("target", F.lit(False)))


def _hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each token, the start mark (0) in front."""
    found = tokens(text)
    return np.fromiter(itertools.chain((0,), map(xxhash.xxh3_64_intdigest, found)), np.uint64, len(found) + 1)


def _packed(x: np.ndarray) -> bytes:
    """64-bit values, their highest bytes first, which are mostly zeros and compress well."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _counted(seqs: list[np.ndarray], target: list[bool]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted distinct pairs, first tokens and second tokens of a batch, each with its counts in target and background.

    Then, for each token of the batch, the place of its pair, and for each pair the places of its two tokens.
    """
    a, b = (np.concatenate([s[cut] for s in seqs]) for cut in (slice(None, -1), slice(1, None)))
    marked = np.repeat(np.array(target, bool), [len(s) - 1 for s in seqs])
    pairs, at, of = np.unique(((a << np.uint64(1)) | (a >> np.uint64(63))) ^ b, return_index=True, return_inverse=True)
    nt = np.bincount(of[marked], minlength=len(pairs))
    nb = np.bincount(of, minlength=len(pairs)) - nt
    found, places = [(pairs, nt, nb)], [of]
    for side in (a, b):
        keys, place = np.unique(side[at], return_inverse=True)
        found.append((keys, *(np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64) for n in (nt, nb))))
        places.append(place)
    return found, tuple(places)


def _parts(keys: np.ndarray, n: int) -> list[int]:
    """Where each of ``n`` equal ranges of keys begins in sorted ``keys``, and the end."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64)).tolist()


def _batches(source: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of a task in batches of about so many characters, each with a number of its own."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for b in source:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(row)
            size += len(row[1])
            if size > chars:
                yield number, held
                number, held, size = number + 1, [], 0
    if held:
        yield number, held


def _requests(marked: DataFrame, n_parts: tuple[int, int, int], chars: int) -> DataFrame:
    """``batch, part, keys, nt, nb``: what each batch has of each range of keys."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _batches(source, chars):
            found, _ = _counted([_hashes(r[1]) for r in rows], [r[2] for r in rows])
            first = 0
            for (keys, nt, nb), n in zip(found, n_parts, strict=True):
                cuts = _parts(keys, n)
                out = [(number, first + p, _packed(np.diff(keys[x:y], prepend=np.uint64(0))), _packed(nt[x:y]), _packed(nb[x:y])) for p, (x, y) in enumerate(itertools.pairwise(cuts)) if x < y]
                first += n
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["batch", "part", "keys", "nt", "nb"])

    return marked.mapInArrow(made, "batch long, part long, keys binary, nt binary, nb binary")


def _replies(requests: DataFrame) -> DataFrame:
    """``batch, part, known, nt, nb, types, t, b``: the counts over all batches for the keys that a batch asked for, in order.

    ``known`` is a sum over these keys. A row of batch -1 has, for its part, the number of keys and the sums of all counts.
    """

    def answers(part: int, group: list[tuple]) -> Iterator[tuple]:
        keys = [np.cumsum(_unpacked(g[1]), dtype=np.uint64) for g in group]
        found, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = []
        for i in (2, 3):
            total.append(np.zeros(len(found), np.int64))
            np.add.at(total[-1], of, np.concatenate([_unpacked(g[i]) for g in group]).astype(np.int64))
        at = 0
        for (batch, *_), own in zip(group, keys, strict=True):
            mine = of[at : at + len(own)]
            at += len(own)
            yield batch, part, int(own.sum(dtype=np.uint64).view(np.int64)), _packed(total[0][mine]), _packed(total[1][mine]), 0, 0, 0
        yield -1, part, 0, b"", b"", len(found), int(total[0].sum()), int(total[1].sum())

    def made(source: Iterator[tuple]) -> Iterator[tuple]:
        for part, group in itertools.groupby(source, key=lambda r: r[1]):
            yield from answers(part, [(r[0], *r[2:]) for r in group])

    dealt = requests.repartition("part").sortWithinPartitions("part", "batch")
    return mapped(dealt, made, "batch long, part long, known long, nt binary, nb binary, types long, t long, b long")


def _differences(found: list, places: tuple, counts: list[tuple[np.ndarray, np.ndarray]], totals: list[int], symbols: int, weight: float = 0.7) -> np.ndarray:
    """The difference of log-probabilities for each pair of a batch; a bigram's share is ``weight`` of what its first token was seen, less for rare ones, and smoothed unigrams have the rest."""
    logs = []
    for k in (0, 1):
        pair, first, second = counts[0][k], counts[1][k][places[1]], counts[2][k][places[2]]
        share = weight * first / (first + 5.0)
        logs.append(np.log(share * pair / np.maximum(first, 1) + (1 - share) * (second + 0.5) / (totals[k] + 0.5 * symbols)))
    return logs[1] - logs[0]


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, few_ids: int = 1_000_000, chars: int = 10_000_000) -> DataFrame:
    """``doc_id, n_tokens, difference`` for each row, by models over every token of ``docs``.

    Texts are taken in batches of about ``chars`` characters. A batch asks for the counts of its distinct pairs and tokens,
    a range of keys at a time; a task has one range of all batches, sums it and answers each batch in the order of its keys.
    A frequent pair is one key of a batch, so no key has more rows than there are batches. Batches then meet their answers.
    """
    marked = _marked(docs, target_ids, few_ids)
    n = 1 + (marked.agg(F.sum(F.length("text"))).first()[0] or 0) // chars
    n_parts = (n, 1 + n // 4, 1 + n // 4)
    answers = written(_replies(_requests(marked, n_parts, chars)))
    types, t, b = answers.where((F.col("batch") == -1) & (F.col("part") >= n_parts[0] + n_parts[1])).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "t", "b"))).first()
    symbols = types + 2  # the start mark and a token never seen are symbols too
    bounds = list(itertools.accumulate(n_parts, initial=0))

    def numbered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _batches(source, chars):
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                ids, texts, marks = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), number)), pa.array(np.arange(at, at + len(part)) + 2**40), pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(marks, pa.bool_())],
                    names=["batch", "part", "doc_id", "text", "target"],
                )

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for number, group in itertools.groupby(source, key=lambda r: r[0]):
            got: list[tuple] = []
            held: list[tuple] = []
            for r in group:
                (held if r[1] >= 2**40 else got).append(r)
            if not held:
                continue
            seqs = [_hashes(r[3]) for r in held]
            found, places = _counted(seqs, [r[4] for r in held])
            counts = []
            for i, (keys, *_) in enumerate(found):
                mine = [r for r in got if bounds[i] <= r[1] < bounds[i + 1]]
                if sum(r[5] for r in mine) % 2**64 != int(keys.sum(dtype=np.uint64)):
                    raise RuntimeError(f"batch {number} has other texts than before")
                counts.append(tuple(np.concatenate([_unpacked(r[k]) for r in mine]).astype(np.float64) if mine else np.zeros(0) for k in (6, 7)))
            d = np.round(_differences(found, places, counts, [t, b], symbols) * UNIT).astype(np.int64)[places[0]]
            ends = np.cumsum([0, *(len(s) - 1 for s in seqs)])
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(d)])[ends]
            for r, m, s in zip(held, np.diff(ends).tolist(), np.diff(sums).tolist(), strict=True):
                yield r[2], m, s / m / UNIT if m else 0.0

    texts = marked.mapInArrow(numbered, "batch long, part long, doc_id long, text string, target boolean")
    met = texts.unionByName(answers.where("batch >= 0").select("batch", "part", "known", "nt", "nb"), allowMissingColumns=True)
    dealt = met.repartition("batch").sortWithinPartitions("batch", "part")
    return mapped(dealt.select("batch", "part", "doc_id", "text", "target", "known", "nt", "nb"), rows, "doc_id long, n_tokens long, difference double")
