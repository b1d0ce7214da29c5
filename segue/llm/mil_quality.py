"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Each passage is encoded by the mean of learned vectors of its words and word
pairs (lower-cased, hashed into ``BUCKETS`` rows) beside numbers about its characters and words; a hidden layer and gated
attention (a tanh and a sigmoid branch, multiplied) weight the passages of a bag, and the weighted representation gives the
score. All weights, word vectors included, are learned together from document labels, in NumPy, on a bounded sample
(``sample_docs``, a documented parameter); every document is scored over its whole text, on the executors.

A null or empty text is a bag of one passage without words. Labels that are null, or that disagree for one document, teach
nothing. With labels of one class alone the score is a constant near that class; without any it is one half. Rows are
scored alone, so repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from segue.llm.common import hash_bound, id_text, mapped, tidied

WORDS = 64
HIDDEN, GATE = 24, 12
BUCKETS, EMBED = 1 << 15, 16
#: Byte classes: each of these strings is one, and so are lower case, upper case, digits, white space, bytes of longer characters and the rest.
SINGLE = ("*", "&", "#", "$", "%", "|", "!", ".", ",", "?", ":;", "'\"", "<>", "{}[]()", "/\\", "=+", "@", "_-")


def _classes() -> np.ndarray:
    out = np.full(256, len(SINGLE), np.int64)
    for i, chars in enumerate(SINGLE):
        out[list(chars.encode())] = i
    for i, some in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, *range(9, 14)), range(128, 256)), len(SINGLE) + 1):
        out[list(some)] = i
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
FEATURES = N_CLASSES + 5


class Bag(NamedTuple):
    """The passages of a document: a row of numbers for each, and buckets of words and word pairs with the place where each passage's begin."""

    dense: np.ndarray
    grams: np.ndarray
    starts: np.ndarray


def passages(text: str) -> Bag:
    raw = text.encode()
    words = raw.split()
    if not words:
        return Bag(np.zeros((1, FEATURES), np.float32), np.zeros(1, np.uint16), np.zeros(1, np.int32))
    codes = np.frombuffer(raw, np.uint8)
    space = CLASS[codes] == CLASS[32]
    starts = ~space & np.r_[True, space[:-1]]
    of = np.maximum(np.cumsum(starts) - 1, 0) // WORDS
    n = -(-len(words) // WORDS)
    counts = np.bincount(of * N_CLASSES + CLASS[codes], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float32)
    size = np.minimum(WORDS, len(words) - WORDS * np.arange(n)).astype(np.float32)
    again = np.array([False, *(a == b for a, b in zip(words, words[1:], strict=False))])
    at = np.arange(0, len(words), WORDS)
    kinds = np.array([len(set(words[i : i + WORDS])) for i in at], np.float32)
    total = counts.sum(axis=1)
    further = np.stack([np.add.reduceat(again, at) / size, kinds / size, np.log1p(size), total / size / 10, np.full(n, np.log1p(len(words)) / 10)], axis=1)
    h = np.fromiter(map(zlib.crc32, raw.lower().split()), np.uint32, len(words))
    two = h * np.uint32(0x9E3779B1) + np.r_[h[1:], h[:1] * 0]  # the last word's pair is with none
    grams = np.stack([h ^ (h >> np.uint32(16)), two ^ (two >> np.uint32(15))], axis=1).ravel() % BUCKETS
    return Bag(np.concatenate([counts / total[:, None], further], axis=1).astype(np.float32), grams.astype(np.uint16), (2 * at).astype(np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class AttentionModel:
    """``score(bag)``; parameters are a dictionary of arrays."""

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = parameters

    def forward(self, bags: list[Bag]) -> dict[str, np.ndarray]:
        """Scores ``y`` of bags, and all that the gradients need."""
        p = self.p
        sizes = np.array([len(b.dense) for b in bags])
        starts = np.cumsum(np.r_[0, sizes[:-1]])
        grams = np.concatenate([b.grams for b in bags])
        begins = np.concatenate([b.starts + o for b, o in zip(bags, np.cumsum([0, *(len(b.grams) for b in bags[:-1])]), strict=True)])
        held = np.diff(np.r_[begins, len(grams)])
        mean = np.add.reduceat(p["word"][grams], begins) / held[:, None]
        dense = np.clip((np.concatenate([b.dense for b in bags]) - p["mean"]) / p["scale"], -8, 8)
        h = np.tanh(dense @ p["w1"] + mean @ p["w2"] + p["b1"])
        v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (v * u) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"grams": grams, "held": held, "mean": mean, "dense": dense, "h": h, "v": v, "u": u, "a": a, "z": z, "starts": starts, "sizes": sizes, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def gradients(self, bags: list[Bag], y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean cross-entropy: by each small array, then the rows of ``word`` that occur and theirs."""
        p, f = self.p, self.forward(bags)
        starts, sizes = f["starts"], f["sizes"]
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), sizes))
        gated = de[:, None] * p["a"]
        dv, du = gated * f["u"] * (1 - f["v"] ** 2), gated * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        out = {"w1": f["dense"].T @ dh, "w2": f["mean"].T @ dh, "b1": dh.sum(axis=0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "a": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dy, "c0": dy.sum(keepdims=True)}
        of = np.repeat(np.arange(len(f["held"])), f["held"])
        order = np.argsort(f["grams"], kind="stable")
        ordered = f["grams"][order]
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        each = (dh @ p["w2"].T) / f["held"][:, None]
        return out, ordered[heads], np.add.reduceat(each[of[order]], heads)

    def score(self, bag: Bag) -> float:
        return float(self.forward([bag])["y"][0])


def fit(bags: list[Bag], labels: np.ndarray, epochs: int = 5, least_steps: int = 200, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> AttentionModel:
    """Adam on the cross-entropy of document labels, some bags at a time, for ``epochs`` rounds or ``least_steps`` steps, whichever is more; the rate falls in a straight line. Word vectors change only where they occur."""
    r = np.random.default_rng(seed)
    p = {k: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in (("w1", (FEATURES, HIDDEN)), ("w2", (EMBED, HIDDEN)), ("v", (HIDDEN, GATE)), ("u", (HIDDEN, GATE)), ("a", (GATE,)), ("c", (HIDDEN,)))}
    p |= {"word": (0.05 * r.normal(size=(BUCKETS, EMBED))).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "c0": np.zeros(1, np.float32), "mean": np.zeros(FEATURES, np.float32), "scale": np.ones(FEATURES, np.float32)}
    if not bags:
        return AttentionModel(p | {"c": p["c"] * 0})
    dense = np.concatenate([b.dense for b in bags])
    p |= {"mean": dense.mean(axis=0), "scale": dense.std(axis=0) + 1e-3}
    model, y = AttentionModel(p), labels.astype(np.float32)
    moments = {k: (np.zeros_like(p[k]), np.zeros_like(p[k])) for k in ("w1", "w2", "b1", "v", "u", "a", "c", "c0", "word")}
    epochs = max(epochs, -(-least_steps // -(-len(bags) // batch)))
    steps, t = epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        for some in np.array_split(r.permutation(len(bags)), -(-len(bags) // batch)):
            t += 1
            grads, rows, each = model.gradients([bags[i] for i in some], y[some])
            now = rate * (1 - (t - 1) / steps)
            for k, g in [*grads.items(), ("word", each)]:
                at = rows if k == "word" else slice(None)
                m, s = moments[k]
                g = g + decay * p[k][at]
                m[at] += 0.1 * (g - m[at])
                s[at] += 0.001 * (g * g - s[at])
                p[k][at] -= now * (m[at] / (1 - 0.9**t)) / (np.sqrt(s[at] / (1 - 0.999**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000) -> AttentionModel:
    """A model from at most ``sample_docs`` labelled documents whose ``crc32`` of the id, modulo 3, is not 1, taken in the order of a hash of the id."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    told = told.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    at = F.xxhash64("doc_id")
    bound = hash_bound(2 * sample_docs, told.count())  # two thirds of all ids may pass, and labels may repeat
    near = told if bound is None else told.where(at <= bound)
    agreed = near.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).where("quality = high")
    some = agreed.select("doc_id", "quality").orderBy(at, "doc_id").limit(sample_docs)  # bounded, so it can be broadcast

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, quality in source:
            b = passages(text)
            yield doc_id, quality, b.dense.tobytes(), b.grams.tobytes(), b.starts.tobytes()

    found = mapped(id_text(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality"), rows, "doc_id long, quality int, dense binary, grams binary, starts binary").collect()
    found.sort(key=lambda f: (f["doc_id"], f["dense"], f["grams"]))
    bags = [Bag(np.frombuffer(f["dense"], np.float32).reshape(-1, FEATURES), np.frombuffer(f["grams"], np.uint16), np.frombuffer(f["starts"], np.int32)) for f in found]
    return fit(bags, np.array([f["quality"] for f in found]))


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in source:
            s = min(1.0, max(0.0, model.score(passages(text))))
            yield doc_id, None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 3 == 1, s, int(s >= 0.5)

    return mapped(id_text(docs), rows, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score one half or more."""
    text = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield part.filter(pa.array([model.score(passages(t or "")) >= 0.5 for t in part.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidied(kept), docs.schema)
