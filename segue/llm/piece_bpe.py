"""SentencePiece BPE encoding and decoding, by backtracking over longest vocabulary matches.

Merging is never simulated over a text. A text is cut before each run of space marks and around characters
that are no piece (no piece holds such a place inside, so no merge crosses it); within a cut, the longest
match at each position is tried first, a token is accepted only if it is compatible with the token before it (merging
the two tokens' joined text from characters gives these two tokens back), shorter matches follow, and
positions from which no encoding exists are marked in a bitfield so that they are tried once only. A
sequence of pairwise compatible tokens is what merging by priority gives, and it is unique.

Texts: null counts as empty (``[begin, end]``, decoded to the empty text). Equal texts have equal
results; rows are independent, so ties, repeated rows and clashing extra columns need no rule.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from segue.llm.common import id_text, mapped

SPACE = "▁"
#: How many words a Python worker remembers the encoding of (about 100 MB).
CACHED_WORDS = 300_000


class PieceModel:
    """The pieces of a ``.model`` file and exact encoding with them; the library only reads the file."""

    def __init__(self, path: str) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.pieces = [lib.id_to_piece(i) for i in ids]
        self.score = {self.pieces[i]: lib.get_score(i) for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.plain = [None if i in self.byte_of else p.replace(SPACE, " ") if p in self.score else "" for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.score))
        self.token: dict[str, int] = {}
        self.matcher = ahocorasick.Automaton()
        for p in self.score:
            if self.merged(p) == [p]:  # a piece that merging cannot reach is never a token
                self.matcher.add_word(p, self.id_of[p])
                self.token[p] = self.id_of[p]
        self.matcher.make_automaton()
        self.known_chars = {p for p in self.token if len(p) == 1}
        self.known_run = re.compile("[{0}]+|[^{0}]+".format("".join(map(re.escape, self.known_chars))))
        self.compatible: dict[int, bool] = {}
        self.lines_apart = not any("\n" in p for p in self.score)
        self.words = _Words(self)

    def merged(self, text: str) -> list[str]:
        """Merging by its definition: the best-scored adjacent pair first, the leftmost of equals. Only for one or two tokens' text."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined text from characters gives these two tokens back."""
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            pair = [self.pieces[left], self.pieces[right]]
            known = self.compatible[key] = self.merged("".join(pair)) == pair
        return known

    def encode_cut(self, cut: str) -> list[int]:
        """Ids of a text of characters that are pieces themselves: longest matches, each fitting the one before it, with backtracking."""
        token, known, reach, longest, n = self.token, self.compatible, self.matcher.longest_prefix, self.longest, len(cut)
        found: list[int] = []
        open_ = None  # the bitfield: 0 where no encoding goes on from; made when the first position fails
        pos = 0
        for last, i in self.matcher.iter_long(cut):  # as far as the longest matches fit, they are what backtracking would take
            if found and not (known.get(found[-1] << 20 | i) or self.fits(found[-1], i)):
                break
            found.append(i)
            pos = last + 1
        if pos == n:
            return found
        size = reach(cut[pos : pos + longest])
        while pos < n:
            while size:
                i = token.get(cut[pos : pos + size])
                if i is not None and (open_ is None or open_[pos + size]) and (not found or known.get(found[-1] << 20 | i) or self.fits(found[-1], i)):
                    break
                size -= 1
            if size:
                found.append(i)
                pos += size
                if pos < n:
                    size = reach(cut[pos : pos + longest])
            else:
                open_ = open_ or bytearray(b"\x01") * (n + 1)
                open_[pos] = 0
                if not found:
                    raise ValueError("the vocabulary has no encoding for a known character")
                size = len(self.pieces[found.pop()])
                pos -= size
        return found

    def encode_piece(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already the space mark; no mark is added. A character that is no piece becomes its UTF-8 bytes."""
        if self.known_chars.issuperset(text):
            return self.encode_cut(text)
        out: list[int] = []
        for cut in self.known_run.findall(text):
            if cut[0] in self.known_chars:
                out += self.encode_cut(cut)
            else:
                out += [self.byte_ids[b] for b in cut.encode()]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end; an empty text has these two alone."""
        return list(array("I", self.packed(text)[0]))

    def packed(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, begin and end included, and the text decoded from them."""
        begin, end = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        if not text:
            return begin + end, ""
        apart = self.lines_apart and "\n" in text
        parts = (text.replace("\n", " \n") if apart else text).split(" ")
        if SPACE in text or "" in parts or text[0] == "\n" or " \n" in text:  # runs of marks merge among themselves: one word from the run on
            found = [self.word(SPACE, p[1:]) for p in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        else:  # if no piece holds a line end, a word may begin with one in place of a mark
            found = [self.words[p] for p in parts]
        return b"".join((begin, *[f[0] for f in found], end)), "".join([f[1] for f in found])[1:]

    def word(self, lead: str, word: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of a mark and what follows it, or of a line end and what follows it."""
        ids = self.encode_piece(lead + word)
        return array("I", ids).tobytes(), (" " if lead else "") + self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, runs of byte ids are UTF-8 (a wrong byte gives U+FFFD), marks are spaces, the first one goes."""
        plain = self.plain
        out = [plain[i] for i in ids]
        if None not in out:
            text = "".join(out)
            return text[1:] if text.startswith(" ") else text
        out = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(plain[i])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


class _Words(dict):
    """Word (what follows one space mark) to its packed ids and their decoded text; the first distinct words stay, up to a bound."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[bytes, str]:
        found = self.model.word("" if word[:1] == "\n" and self.model.lines_apart else SPACE, word)
        if len(self) < CACHED_WORDS and len(word) < 40:
            self[word] = found
        return found


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string``: ids with begin and end, and the text decoded from them. No shuffle; ``model_path`` must exist on every node."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        model = piece_model(model_path)
        for doc_id, text in source:
            packed, decoded = model.packed(text)
            yield doc_id, list(array("I", packed)), decoded

    return mapped(id_text(docs), rows, "doc_id long, ids array<int>, decoded string", batch=64)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As ``encode_documents``, with counts and SHA-256 digests in place of ids and text, so that ids never leave the Python workers."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        model = piece_model(model_path)
        for doc_id, text in source:
            packed, decoded = model.packed(text)
            yield doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return mapped(id_text(docs), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
