"""Operator 12 against brute force: every pair of words by edit distance."""
import collections
import random
import re
import zlib

import pytest

from ledgerlens.llm import variants as V

from .edge_rows import EDGE, LONG


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def _expected(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {w: [x for x in words if _one_edit(w, x)] for w in words}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), c, len(near[w]), words[form[w]] if form[w] else None) for w, c in words.items()}


def _rows(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def _check(odd, rows):
    got = _rows(V.variants(odd(rows)))
    assert len(got) == len(set(got)) and set(got) == _expected(rows)
    return {r[0]: r for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_by_brute_force(odd, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcàé") for _ in range(rnd.randint(4, 7))) for _ in range(400)]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice((6, 40, 400))]).title() for _ in range(60))) for i in range(200)]
    got = _check(odd, rows)
    assert sum(r[4] > 0 for r in got.values()) > 20 and any(r[1] for r in got.values())


def test_long_chains_reach_their_root(odd):
    # letters change one place after another and counts double: one chain of forms, ten steps long
    word, rows = "a" * 12, []
    for k in range(10):
        rows += [(k, " ".join(["b" * k + word[k:]] * (3 << k)))]
    got = _check(odd, rows)
    assert max(len({r[2] for r in got.values()}), 1) <= 3


def test_letters_many_times_and_ties(odd):
    _check(odd, [(i, t) for i, t in enumerate(["zzzzzzzz zzzzzzzzz zzzzzzz"] * 3 + ["stain stair"] * 3 + ["staid"] * 8 + ["staip"] * 8 + ["ÿÿÿÿÿ ÿÿÿÿÀ"] * 4)])


def test_odd_rows(odd):
    _check(odd, EDGE)
    _check(odd, [(i, "") for i in range(3)])
    assert V.variants(odd([])).count() == 0
    _check(odd, [(1, "x" * 50000)] * 4 + [(2, LONG)])


def test_ids_of_other_types(spark):
    rows = [("a", "color colour colour colour color color"), ("b", "colour colour colour")]
    assert set(_rows(V.variants(spark.createDataFrame(rows, "doc_id string, text string")))) == _expected(rows)
    rows = [(1, "color colour colour colour color color"), (2, "colour colour colour")]
    assert set(_rows(V.variants(spark.createDataFrame(rows, "doc_id int, text string")))) == _expected(rows)
