"""Operator 7: BPE encoding and decoding with a contiguous rank array.

A text is normalised, split at special tokens and into words; a word is a row
of byte symbols, the last marked as the word's end. Beside its parts lie the
ranks of adjacent pairs: the lowest rank is found by a scan, its boundary
deleted and the two neighbouring ranks looked up again, until no pair merges.
Texts are worked on ``BATCH`` characters at a time: their distinct words are
merged once, all words of one length together as the rows of two arrays (parts
and ranks), each row by its own scan, delete and refresh. Words beyond
``LONG_WORD`` symbols, where scans would cost the square of the length, take
the same merges from a heap.

The vocabulary file is read by the driver and broadcast - its size is fixed -
so executors need no copy of it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import batches, pick, ship

VOCABULARY = "word_bpe_49k.json"
LONG_WORD = 64                   # symbols; longer words are merged by heap
BATCH = 1 << 19                  # characters worked on at a time
NONE = np.int32(2**31 - 1)       # the rank of a pair that doesn't merge
WHITE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def load(path: str) -> dict:
    """What the encoder needs of a vocabulary file: token strings, merges by rank, special tokens, word-end suffix."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    return {"vocab": model["vocab"], "merges": [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]],
            "special": {t["content"]: t["id"] for t in file["added_tokens"]}, "suffix": model["end_of_word_suffix"] or ""}


def _byte_symbols() -> list[str]:
    """Printable Latin-1 bytes stand for themselves; the rest for the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """White space, letter, number or other, by code point; made once for each Python process."""
    if not _kinds:
        kind = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0xD800)) + " " * 0x800 + "".join(chr(c) for c in range(0xE000, 0x110000))
        for group, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
            for m in regex.finditer(group, every):
                kind[m.start() : m.end()] = value
        kind[0xD800:0xE000] = OTHER
        _kinds.append(kind)
    return _kinds[0]


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of words: runs of letters, single numbers, runs of anything else but white space.

    A lone apostrophe before s, t, m, d, re, ve or ll takes these letters with
    it; what follows of the letters is a word of its own.
    """
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds()[codes]
    new = np.ones(len(codes), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(codes))
    solid = kind[starts] != WHITE
    starts, ends = starts[solid], ends[solid]
    at = np.flatnonzero((codes[starts] == 0x27) & (ends - starts == 1))
    at = at[at + 1 < len(starts)]
    at = at[(starts[at + 1] == ends[at]) & (kind[starts[at + 1]] == LETTER)]
    if len(at):
        padded = np.append(codes, 0)
        one, two = padded[starts[at + 1]], padded[starts[at + 1] + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b)) & (ends[at + 1] - starts[at + 1] >= 2)
        taken = np.where(short, 1, np.where(pair, 2, 0))
        ends[at] += taken
        starts[at + 1] += taken
        left = starts < ends
        starts, ends = starts[left], ends[left]
    return starts, ends


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``count[i]`` numbers for each i, in one array."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(total)


class Encoder:
    """Texts to ids and ids to text, for the vocabulary that ``load`` returns."""

    def __init__(self, data: dict):
        vocab, suffix = data["vocab"], data["suffix"]
        self.special = data["special"]
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(data["merges"])}
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_rank = order.astype(np.int32)                          # merges are listed by rank
        self.merged = np.array([new for _, new in self.pairs.values()], np.int32)
        strings = [(self.token.get(i, "") + " ").encode("utf-8") if i in self.token else b"" for i in range(max(self.token) + 1)]
        self.string_bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.string_size = np.array([len(x) for x in strings], np.int64)
        self.string_start = np.cumsum(self.string_size) - self.string_size

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words of equal length, one a row. Returns (parts, number of parts left in each row)."""
        rows, width = parts.shape
        size = np.full(rows, width)
        out = parts.copy()
        alive = np.arange(rows)
        rank = self.ranks(parts[:, :-1], parts[:, 1:]) if width > 1 else np.zeros((rows, 0), np.int32)
        while len(alive) and rank.shape[1]:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(alive)), at]
            done = low == NONE
            if done.any():
                ended = alive[done]
                out[ended, : parts.shape[1]] = parts[done]
                size[ended] = parts.shape[1]
                keep = ~done
                alive, parts, rank, at, low = alive[keep], parts[keep], rank[keep], at[keep], low[keep]
                if not len(alive):
                    break
            row, n = np.arange(len(alive)), parts.shape[1]
            column = np.arange(n - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
            parts[row, at] = self.merged[low]
            column = np.arange(n - 2)
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), axis=1)
            right = np.flatnonzero(at < n - 2)
            rank[right, at[right]] = self.ranks(parts[right, at[right]], parts[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(parts[left, at[left] - 1], parts[left, at[left]])
        out[alive, : parts.shape[1]] = parts
        size[alive] = parts.shape[1]
        return out, size

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, lowest rank first and of equal ones the leftmost, by a heap over a linked list."""
        pairs, n = self.pairs, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], alive[j] = pairs[pair][1], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (parts[k], parts[after[k]])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], k, p))
        return [p for p, a in zip(parts, alive) if a]

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each)."""
        length = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(length) - length
        parts = self.inner[raw]
        parts[first + length - 1] = self.last[raw[first + length - 1]]
        size = np.zeros(len(words), np.int64)
        for n in np.unique(length):
            which = np.flatnonzero(length == n)
            if n > LONG_WORD:
                for w in which:
                    got = self.merge_long(parts[first[w] : first[w] + n].tolist())
                    parts[first[w] : first[w] + len(got)] = got
                    size[w] = len(got)
                continue
            places = first[which][:, None] + np.arange(n)
            merged, size[which] = self.merge_rows(parts[places])
            parts[places] = merged
        return parts[spread(first, size)], size

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a few plain (normalised, lower-case) texts of about ``BATCH`` characters together."""
        codes = T.code_points("\n".join(texts))
        starts, ends = word_bounds(codes)
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        _, sample, inverse = np.unique(T.run_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
        ids, size = self.merge_words([whole[s:e].encode("utf-8", "surrogatepass") for s, e in zip(starts[sample].tolist(), ends[sample].tolist())])
        first = np.cumsum(size) - size
        count = size[inverse]
        flat = ids[spread(first[inverse], count)].astype(np.uint32)
        edge = np.cumsum([len(t) + 1 for t in texts])
        upto = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, edge)]
        return np.split(flat, upto[:-1])

    def encode_many(self, texts):
        """The ids of each text, in order, as unsigned 32-bit integers; texts may come from any iterable."""
        group, width, owners, parts, done = [], 0, [], {}, 0

        def flush():
            nonlocal width
            for owner, ids in zip(owners, self._encode_group(group)):
                parts[owner[0]][owner[1]] = ids
            group.clear()
            owners.clear()
            width = 0

        i = -1
        for i, text in enumerate(texts):
            parts[i] = own = []
            for part in self.split.split(text) if self.split else [text]:
                if part in self.special:
                    own.append(np.array([self.special[part]], np.uint32))
                    continue
                for piece in _stretches(part):
                    if not piece.isascii() and not unicodedata.is_normalized("NFC", piece):
                        piece = unicodedata.normalize("NFC", piece)
                    # lower() has a rule for a word's last sigma, which lower case by character has not
                    piece = piece.replace("\u03a3", "\u03c3").lower()
                    owners.append((i, len(own)))
                    own.append(None)
                    group.append(piece)
                    width += len(piece)
                    if width >= BATCH:
                        flush()
            if not group:
                while done <= i:
                    got = parts.pop(done)
                    yield got[0] if len(got) == 1 else np.concatenate([np.zeros(0, np.uint32), *got])
                    done += 1
        if group:
            flush()
        while done <= i:
            got = parts.pop(done)
            yield got[0] if len(got) == 1 else np.concatenate([np.zeros(0, np.uint32), *got])
            done += 1

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def _strings(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, each followed by a blank; ids without a token give nothing."""
        ids = ids[ids < len(self.string_size)].astype(np.int64)
        return self.string_bytes[spread(self.string_start[ids], self.string_size[ids])].tobytes()

    def decode(self, ids) -> str:
        """Token strings joined by blanks, special ones included; unknown ids are left out."""
        return self._strings(np.asarray(ids, np.int64))[:-1].decode("utf-8")

    def decoded_sha256(self, ids: np.ndarray) -> str:
        out, step = hashlib.sha256(), 1 << 20
        for at in range(0, len(ids), step):
            part = self._strings(ids[at : at + step])
            out.update(part if at + step < len(ids) else part[:-1])
        return out.hexdigest()


def _stretches(text: str):
    """Cuts long texts at white space, which no word spans; a longer run without any stays whole."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + BATCH)
        while end < n and text[end] not in " \n":
            end += 1
        yield text[at:end]
        at = end


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, made once."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class Shared:
    """A broadcast vocabulary with an id that workers can key on."""

    def __init__(self, spark, path: str):
        self.broadcast = spark.sparkContext.broadcast(load(path))
        self.id = f"{spark.sparkContext.applicationId}:{id(self.broadcast)}:{path}"

    @property
    def value(self):
        return self.broadcast.value


def _digest(shared):
    def run(chunks):
        enc = encoder(shared)
        for b in batches(chunks, 1024):
            found = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), enc.decoded_sha256(ids)) for ids in enc.encode_many(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Defined results: null counts as empty and has no ids; a null doc_id stays
    null; repeated rows give equal results; an empty table gives no rows; other
    columns than doc_id and text are not read. One pass without a shuffle.
    """
    ship(docs.sparkSession)
    rows = _texts(docs)
    return rows.mapInArrow(_digest(Shared(docs.sparkSession, path)), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(shared):
    def run(chunks):
        enc = encoder(shared)
        for b in batches(chunks):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([ids.astype(np.int64) for ids in enc.encode_many(b.column("text").to_pylist())], pa.list_(pa.int64()))], names=["doc_id", "ids"])
    return run


def _decode(shared):
    def run(chunks):
        enc = encoder(shared)
        for b in batches(chunks):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])
    return run


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document; null counts as empty."""
    ship(docs.sparkSession)
    rows = _texts(docs)
    return rows.mapInArrow(_encode(Shared(docs.sparkSession, path)), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<bigint>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    ship(encoded.sparkSession)
    rows = pick(encoded, doc_id="doc_id", ids="ids")
    return rows.mapInArrow(_decode(Shared(encoded.sparkSession, path)), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
