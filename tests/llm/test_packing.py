"""Packing of token pieces against the tokenizer itself and the laws of a packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from feedloom.llm import packing
from feedloom.llm.words import text_bytes


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


def test_ids_are_the_tokenizers(tokenizer):
    """Words looked up one by one give what the tokenizer gives for whole texts."""
    rng = random.Random(1)
    signs = "aB's.,1 ̸́̇é×'tLl≠\x1c\x0b ΣIİ日😀\n\t<|>½"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["Don't YOU'LL the's", "", None, "3.14 x²", "<|endoftext|>", "a <|endoftext|>b", "İ̸ İ"]
    plain = [t for t in texts if "<|endo" not in (t or "")]
    for some in (plain, texts):
        ids, begin = packing.Tokens(packing.vocabulary_path()).of(*text_bytes(pa.array(some, pa.string())))
        for i, text in enumerate(some):
            assert ids[begin[i] : begin[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def _check(found: packing.Slots, counts: np.ndarray) -> None:
    room = len(counts) - 1
    filled, seen = defaultdict(list), defaultdict(int)
    for size, rank, n, each, first, start in sorted(found.rows, key=lambda r: (r[0], r[1])):
        assert rank == seen[size]  # ranks of a size follow each other
        seen[size] += n
        for i in range(n):
            filled[first + i // each].append((start + i % each * size, size))
    assert dict(seen) == {s: int(n) for s, n in enumerate(counts) if n}
    assert sorted(filled) == list(range(found.n_sequences))
    for parts in filled.values():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at <= room


@pytest.mark.parametrize("seed", range(6))
def test_slots(seed):
    rng = np.random.default_rng(seed)
    room = (64, 100, 333)[seed % 3]
    counts = np.zeros(room + 1, np.int64)
    for _ in range((5, 60, 400, 3000)[seed % 4]):
        counts[int(np.clip(rng.gamma(2, room / 6), 1, room))] += int(rng.integers(1, 9))
    found = packing.slots(counts)
    _check(found, counts)
    tokens = int(counts @ np.arange(room + 1))
    assert found.n_sequences <= 1.03 * tokens / room + 6


def test_slots_of_odd_tables():
    for counts in ([0] * 9, [0] * 8 + [5], [0, 7] + [0] * 7, [0, 0, 0, 0, 0, 3, 0, 0, 0], [0, 0, 0, 0, 10**12, 0, 0, 0, 0]):
        found = packing.slots(np.array(counts))
        assert found.n_sequences == -(-sum(counts) // (8 // next((s for s, n in enumerate(counts) if n), 8)))
    # where sizes match in pairs, configurations find the pairs
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 55, 45, 51, 49]] = [30, 30, 20, 20, 10, 10]
    assert packing.slots(counts).n_sequences == 60


def test_pack(make_docs, tokenizer):
    rng = random.Random(7)
    words = ["tion", "the", "Ériger", "x9", "and,", "über", "123"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(int(rng.expovariate(1 / 30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, text(700)), (202, text(3)), (None, "the"), (203, "the"), (203, "the")]
    docs = make_docs(rows).withColumnRenamed("u", "offset")
    packed = packing.pack(docs, sequence=128)
    got = packed.collect()
    by_doc = defaultdict(list)
    for doc_id, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 128):
            part = ids[i : i + 128]
            by_doc[doc_id].append((i // 128, i, len(part), np.array(part, "<u4").tobytes()))
    found, places = defaultdict(list), defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        places[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by_doc.items()}
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    tokens = 0
    for key, parts in places.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
        tokens += at
        assert whole[key] == b"".join(ids for *_, ids in sorted(parts))
    assert len(places) == len(whole) <= tokens / 128 + 2
    crc = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.digest(packed).collect()}
    assert crc == {(r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in got}
    assert packing.pack(docs.limit(0)).isEmpty()
