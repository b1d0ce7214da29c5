"""Hierarchical multi-length packing of tokenized documents.

Each partition is packed on its own as a stream, so nothing is shuffled and memory is bounded by
``block_tokens``. A document longer than the window gives full windows first; what is left of it, and each
shorter document, is routed to the smallest context tier that holds it. Tiers are packed from the longest
to the shortest: a window opens with the longest waiting piece, its gap is filled with whole pieces from the
same or shorter tiers, longest fit first, and if none fits, with a cut of one. Windows are thus full; what
cannot fill one waits for the next block, and at the end of a partition it is laid out in sequences of powers
of two, so that no sequence needs padding. Sequences of one tier form step groups of equal token counts.

A document is its ids and then the end id; a null or empty text is the end id alone. Repeated rows are
documents of their own. An empty table gives an empty result. ``sequence_id`` is the partition's number times
2**32 plus a count, hence the same when a lost task runs again over the same input split.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from segue.llm.common import id_text, mapped

#: Fixed value: the published splitting pattern of byte-level BPE vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
TWO_SPACES = re.compile(r"\s\s")
#: How many words a Python worker remembers the ids of (about 90 MB).
CACHED_WORDS = 350_000


class ByteTokenizer:
    """Ids of a ``tokenizers`` byte-level BPE file, special tokens in texts being ordinary text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        ranks = {bytes(byte_of[c] for c in "".join(p)): spec["vocab"]["".join(p)] for p in [*([c] for c in byte_of), *merges]}
        if [spec["vocab"]["".join(m)] for m in merges] != sorted(spec["vocab"]["".join(m)] for m in merges):
            raise ValueError("ids do not follow the order of merges")
        self.encode_plain = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self)

    def packed(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers. Around single spaces and line ends the pattern always splits, so words are looked up one by one."""
        if not text or TWO_SPACES.search(text):
            return array("I", self.encode_plain(text)).tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join([array("I", self.encode_plain(first)).tobytes(), *map(self.words.__getitem__, rest)])


class _Words(dict):
    """What follows a space (or begins with a line end) to its packed ids; the first distinct words stay, up to a bound."""

    def __init__(self, tokenizer: ByteTokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.tokenizer.encode_plain(word if word[:1] == "\n" else " " + word)).tobytes()
        if len(self) < CACHED_WORDS and len(word) < 40:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


class Packer:
    """Windows over a stream of (document number, token count); yields (tier, pieces), a piece being (document number, start, length)."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = sorted(tiers)
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), by length

    def add(self, doc: int, tokens: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        window = self.tiers[-1]
        full = tokens - tokens % window
        for start in range(0, full, window):
            yield window, [(doc, start, window)]
        if tokens > full:
            insort(self.waiting, (tokens - full, doc, full))

    def packed(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows out of what waits, the longest tier first; less than a window of its tier may stay."""
        waiting, total = self.waiting, sum(w[0] for w in self.waiting)
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0], strict=True):
            while waiting and waiting[-1][0] > below and total >= tier:
                gap, pieces = tier, []
                while gap:
                    at = bisect_right(waiting, (gap, 1 << 62, 0)) - 1
                    length, doc, start = waiting.pop(at) if at >= 0 else waiting.pop(0)
                    if length > gap:  # none fits: the shortest is cut
                        insort(waiting, (length - gap, doc, start + gap))
                        length = gap
                    pieces.append((doc, start, length))
                    gap -= length
                total -= tier
                yield tier, pieces

    def rest(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """What still waits, in sequences of powers of two."""
        left = sum(w[0] for w in self.waiting)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            gap, pieces = size, []
            while gap:
                length, doc, start = self.waiting.pop()
                if length > gap:
                    self.waiting.append((length - gap, doc, start + gap))
                    length = gap
                pieces.append((doc, start, length))
                gap -= length
            left -= size
            yield size, pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), step_tokens: int = 32768, block_tokens: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id`` (and ``ids`` if asked for).

    ``tiers`` are powers of two, the largest being the window. ``step_id`` numbers groups of ``step_tokens`` tokens: the
    sequences of one group have one length, save in the last groups of a partition.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        tokenizer, base = byte_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 32
        end = int(end_id).to_bytes(4, "little")
        packer, held, count, number = Packer(tiers), {}, 0, 0  # held: document number to [doc_id, its packed ids, tokens not yet laid out]
        steps: dict[int, list[int]] = {}  # tier to [its open step group, tokens in it]
        next_step = 0

        def laid(sequence: tuple[int, list[tuple[int, int, int]]], last: bool) -> Iterator[tuple]:
            nonlocal count, next_step
            tier, pieces = sequence
            group = steps.get(0 if last else tier)
            if group is None or group[1] + tier > step_tokens:
                group = steps[0 if last else tier] = [next_step, 0]
                next_step += 1
            group[1] += tier
            offset = 0
            for doc, start, length in pieces:
                entry = held[doc]
                ids = entry[1][4 * start : 4 * (start + length)]
                row = (entry[0], start, length, zlib.crc32(ids), len(entry[1]) // 4, base + count, offset, tier, base + group[0])
                yield (*row, list(array("I", ids))) if with_ids else row
                offset += length
                entry[2] -= length
                if not entry[2]:
                    del held[doc]
            count += 1

        block = 0
        for doc_id, text in source:
            packed = tokenizer.packed(text) + end
            tokens = len(packed) // 4
            held[number] = [doc_id, packed, tokens]
            for s in packer.add(number, tokens):
                yield from laid(s, False)
            number += 1
            block += tokens
            if block >= block_tokens:
                for s in packer.packed():
                    yield from laid(s, False)
                block = 0
        for s in packer.packed():
            yield from laid(s, False)
        for s in packer.rest():
            yield from laid(s, True)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
    return mapped(id_text(docs), rows, schema + ", ids array<int>" * with_ids)
