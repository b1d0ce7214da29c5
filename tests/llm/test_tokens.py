"""Encoding against the library, packing against the tokens themselves."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from segue.llm import packing, piece_bpe

MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
PARTS = [*"abetT \n\t.,▁é😀字ñ012<>/{}='", "  ", "    ", "▁▁", "the ", "ing", "<s>", "\0", "‍", "ß", "\n\n", " \n", "import ", "'ll", "<|endoftext|>"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)] + [" " * k + s for k in range(40) for s in ("", "a", "\n")]


def test_piece_encoding_equals_the_library():
    ours, lib = piece_bpe.piece_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts(5000, 1):
        ids = lib.encode(t, add_bos=True, add_eos=True)
        packed, decoded = ours.packed(t)
        assert list(np.frombuffer(packed, "<u4")) == ids, repr(t)
        assert decoded == lib.decode(ids) == ours.decode(ids), repr(t)


def test_byte_tokens_equal_the_library():
    ours, lib = packing.byte_tokenizer(BYTES), Tokenizer.from_file(BYTES)
    lib.encode_special_tokens = True
    for t in texts(5000, 2):
        assert list(np.frombuffer(ours.packed(t), "<u4")) == lib.encode(t, add_special_tokens=False).ids, repr(t)


def rows(spark, values):
    return spark.createDataFrame([(i, t, "x", t) for i, t in values], "doc_id long, text string, ids string, start string")


def test_encoding_query_on_odd_rows(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    values = [(1, "the cat"), (1, "the cat"), (2, ""), (3, None), (None, "x"), (4, "ab " * 50000), (5, "z" * 3000)]
    got = sorted(map(tuple, piece_bpe.encode_digests(rows(spark, values), MODEL).collect()), key=str)
    want = []
    for i, t in values:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert piece_bpe.encode_documents(rows(spark, []), MODEL).collect() == []
    full = piece_bpe.encode_documents(rows(spark, values[:1]), MODEL).first()
    assert full.ids == lib.encode("the cat", add_bos=True, add_eos=True) and full.decoded == "the cat"


def test_packing_lays_out_each_token_once(spark):
    lib = Tokenizer.from_file(BYTES)
    r = random.Random(3)
    values = [(i, " ".join(r.choice(["the", "cat", "naïve", "\n", "x9"]) for _ in range(r.choice([0, 3, 300, 900, 5000])))) for i in range(80)] + [(90, None), (91, "a"), (91, "a")]
    got = packing.pack_documents(rows(spark, values).repartition(3), BYTES, block_tokens=4000, with_ids=True).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append(p)
        assert p.length > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # a power of two: no padding
    for i, t in values:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(docs[i], key=lambda p: p.start)
        if i != 91:
            assert [x for p in pieces for x in p.ids] == ids and {p.doc_tokens for p in pieces} == {len(ids)}
    assert sum(p.length for p in docs[91]) == 4
    steps = defaultdict(set)
    for p in got:
        steps[p.step_id].add((p.sequence_id, p.tier))
    assert all(sum(t for _, t in s) <= 32768 for s in steps.values())
    assert packing.pack_documents(rows(spark, []), BYTES).collect() == []
