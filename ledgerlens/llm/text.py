"""Vectorised text features: code points, character classes, words and their hashes, all by numpy.

A word's hash depends on its characters alone: with an odd base B, the sum of
``c[i] * B**i`` over a word, times the inverse of ``B**start``, is the same
wherever the word stands (arithmetic modulo 2**64, where odd numbers have
inverses). One cumulative sum over the text so hashes all its words at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np

SPACE, MARK, LETTER, DIGIT = 0, 1, 2, 3
TABLE = 0x20000                 # code points from here on are CJK extensions, private use and tags: taken as letters
CHUNK = 1 << 20                 # characters worked on at a time; longer texts are cut between words
BASE = 0x9E3779B97F4A7C15

_tables: dict[str, np.ndarray] = {}


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower-case code) by code point, made once for each Python process."""
    if not _tables:
        kind, lower = np.zeros(TABLE + 1, np.uint8), np.arange(TABLE + 1, dtype=np.uint32)
        for code in range(TABLE):
            ch = chr(code)
            group = unicodedata.category(ch)[0]
            kind[code] = LETTER if group in "LM" else DIGIT if group == "N" else SPACE if ch.isspace() or group in "ZC" else MARK
            low = ch.lower()
            if low != ch:
                lower[code] = ord(low[0])
        kind[TABLE] = LETTER
        _tables.update(kind=kind, lower=lower)
    return _tables["kind"], _tables["lower"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(codes: np.ndarray) -> np.ndarray:
    return tables()[0][np.minimum(codes, TABLE)]


def lowered(codes: np.ndarray) -> np.ndarray:
    low = tables()[1][np.minimum(codes, TABLE)]
    return np.where(codes < TABLE, low, codes) if codes.size and codes.max() >= TABLE else low


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown as needed."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            grown = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                grown.append(np.cumprod(step))
        _powers[:] = grown
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``codes[start:end]`` that depends on its characters alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(codes))
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts])


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _pieces(text: str):
    """(offset, piece): cuts at white space, so that no word is split; a longer run of other characters stays whole."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n and not text[end].isspace():
            back = next((i for i in range(end, max(at, end - 4096), -1) if text[i].isspace()), 0)
            if back:
                end = back
                break
            end = min(n, end + CHUNK)
        yield at, text[at:end]
        at = end


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the maximal runs of letters, marks and digits, in lower case."""
    found = []
    for at, piece in _pieces(text):
        codes = lowered(code_points(piece))
        starts, ends = _runs(classes(codes) >= LETTER)
        found.append((run_hashes(codes, starts, ends), starts + at, ends + at))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))


def tokens(text: str) -> np.ndarray:
    """Hashes of the runs of letters and digits, case kept, and of the runs of marks between them, in order."""
    found = []
    for _, piece in _pieces(text):
        codes = code_points(piece)
        kind = classes(codes)
        kind = np.where(kind >= LETTER, np.uint8(LETTER), kind)
        edge = np.flatnonzero(np.diff(np.concatenate(([255], kind, [255]))))
        starts, ends = edge[:-1], edge[1:]
        solid = kind[starts] != SPACE
        found.append(run_hashes(codes, starts[solid], ends[solid]))
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(BASE) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)
