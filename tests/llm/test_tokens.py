"""Operators 7 and 2 against the tokenizers library, and packing's rules."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, packing

from .edge_rows import EDGE

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load(PATH))


POOL = ["a", "B", "é", "e\u0301", "Σ", "İ", "ß", "'s", "'S", "'re", "'LL", "''", " ", "\n", "\t", "\x85", "\x1c", "\u3000", "1", "½", "Ⅷ", "٣", "_", "--",
        "💩", "日", "\u200b", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "ﬁ", "ǅ", "\u180e", "가", "the", "ing", "</w>", "\x00", "न", "ि"]


def test_encode_and_decode_equal_the_library(own, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 15))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, "!?" * 2000, "é" * 777] + [t or "" for _, t in EDGE]
    for text, ids in zip(texts, own.encode_many(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:50]
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_texts_are_cut_without_a_trace(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH", 50)
    texts = ["word's don't " * 40, "x" * 300 + " y", "", "<|endoftext|>a b " * 20]
    assert [x.tolist() for x in own.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_heap_and_scan_give_the_same_merges(own):
    for word in ["abcabcabc" * 6, "thethethe", "zzzzzzzzzzzz"]:
        parts = [int(own.inner[b]) for b in word[:-1].encode()] + [int(own.last[ord(word[-1])])]
        rows, size = own.merge_rows(np.array([parts], np.int32))
        assert own.merge_long(parts) == rows[0, : size[0]].tolist()


def test_digests_of_odd_rows(odd, own, library):
    import hashlib

    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_digests(odd(EDGE), PATH).collect()}
    want = set()
    for i, t in EDGE:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.bpe_digests(odd([]), PATH).count() == 0


def test_encode_decode_frames_round_trip(odd, library):
    encoded = bpe.bpe_encode(odd(EDGE), PATH)
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(encoded, PATH).collect() if r["doc_id"]}
    assert back == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids) for i, t in EDGE if i}


def _pieces(rows, library, capacity):
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            yield i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())


def test_packing_holds_every_piece_once_and_gapless(odd, library):
    rows = EDGE + [(1000 + i, "word " * (i % 300)) for i in range(400)]
    got = packing.pack(odd(rows), PATH, with_ids=True).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"]) == sorted(x for x in _pieces(rows, library, 2048) if x[0])
    assert len(got) == len(list(_pieces(rows, library, 2048)))
    bins = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(odd([]), PATH).count() == 0


def _sequential(lengths, capacity):
    """Best-two-fit piece by piece."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while (fit := [x for x in left if x <= gap]):
            own.append(fit[-1])
            left.remove(fit[-1])
            gap -= fit[-1]
        small = min(own)
        best = max(((a + b, a, b) for i, a in enumerate(left) for b in left[:i] if a + b <= gap + small), default=(0, 0, 0))
        if gap and len(own) > 1 and best[0] > small:
            own.remove(small)
            left.append(small)
            for x in best[1:]:
                left.remove(x)
                own.append(x)
            left.sort()
        bins.append(sorted(own))
    return sorted(bins)


def test_patterns_equal_packing_piece_by_piece():
    for seed in range(30):
        rng = random.Random(seed)
        capacity = rng.choice([12, 40, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
        plan = packing.best_two_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins = sorted(sorted(s for s, m in pattern for _ in range(m)) for pattern, repeats in plan for _ in range(repeats))
        assert bins == _sequential(lengths, capacity), (seed, capacity)
