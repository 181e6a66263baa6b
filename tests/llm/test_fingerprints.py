"""Operator 13 against a plain Python form, and its defined results on odd tables."""
import hashlib
import random
import struct
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import fingerprints as P

from .edge_rows import EDGE


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _xx(text):
    return _signed(xxhash.xxh64_intdigest(text.encode(), seed=42))


def _terms(text):
    return sorted({_xx(t) for t in regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())})


def _fingerprint(text, places):
    every = _terms(text)
    kept = [t for t in every if t % (1 << P.BITS) in places] or every
    if not kept:
        return "x%X" % (_xx(text) % (1 << 64)) if text else ""
    level = max(5, (len(kept) - 1).bit_length())
    out = [str(level)]
    for at in (level, level + 1):
        hashes = []
        for s in range(32):
            h, own = 42, [t for t in kept if (t % (1 << 64) >> P.BITS) % (1 << at) == s]
            for t in own:
                h = xxhash.xxh64_intdigest(struct.pack("<q", t), seed=h)
            hashes.append("%08X" % (h % (1 << 32)) if own else "")
        out.append(",".join(hashes))
    return ":".join(out)


def _likeness(a, b):
    if a == b:
        return 1.0
    sets = []
    for f in (a, b):
        parts = f.split(":")
        sets.append({int(parts[0]): parts[1].split(","), int(parts[0]) + 1: parts[2].split(",")} if len(parts) == 3 else {})
    common = max(set(sets[0]) & set(sets[1]), default=None)
    if common is None:
        return 0.0
    pairs = [(x, y) for x, y in zip(sets[0][common], sets[1][common]) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def _expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, _xx(r[1])), reverse=True)
    n, df = len(rows), Counter(t for _, text in rows for t in _terms(text))
    places = {t % (1 << P.BITS) for t, c in df.items() if max(2, n / 4096) <= c <= max(2, n / 16)}
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        f, e, x = (_fingerprint(t, places) for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e, _likeness(f, e), _likeness(f, x)))
    return Counter(out)


def _got(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in df.collect())


@pytest.mark.parametrize("partitions", ["1", "7", "200"])
def test_equals_the_plain_form(spark, odd, partitions):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    rows = [(rnd.randint(-500, 10**9), " ".join(rnd.choices(words, k=rnd.choice((1, 3, 30, 200, 800))))) for _ in range(150)]
    rows += [(i, rows[0][1]) for i in range(5)] + EDGE[:5] + EDGE[6:]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = _got(P.fingerprints(odd(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == _expected(rows)


def test_near_texts_are_alike_and_strangers_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = P.fingerprints(docs).agg(F.avg("near_edited").alias("near"), F.avg("near_next").alias("far"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("told")).first()
    assert row["near"] > 0.35 and row["far"] < 0.01 and row["told"] > 0.95


def test_odd_rows(odd):
    assert _got(P.fingerprints(odd(EDGE))) == _expected(EDGE)
    assert P.fingerprints(odd([])).count() == 0
    for rows in ([(1, "a single text of its own")], [(1, None)], [(None, "no id"), (None, "none either")], [(1, "twice")] * 6):
        assert _got(P.fingerprints(odd(rows))) == _expected(rows)


def test_ids_of_other_types(spark):
    rows = [("b", "one two three four"), ("a", "five six seven"), (None, "eight")]
    got = _got(P.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")))
    order = {"b": 2, "a": 1, None: None}
    expected = {(next(k for k, v in order.items() if v == r[0]), *r[1:]): n for r, n in _expected([(order[i], t) for i, t in rows]).items()}
    assert got == Counter(expected)
    assert P.fingerprints(spark.createDataFrame([(1, "x y"), (2, "y z")], "doc_id int, text string")).count() == 2


def test_no_python_and_one_shuffle_of_the_texts(spark, odd):
    docs = odd([(i, f"text {i}") for i in range(20)])
    plan = P.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
