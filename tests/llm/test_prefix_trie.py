"""Operator 11 against a plain trie of Python dicts."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from ledgerlens.llm import prefix_trie as P

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: Further columns whose names differ in case alone or clash with those used inside.
ODD = T.StructType([T.StructField(n, k) for n, k in (("Turn", T.StringType()), ("shard", T.StringType()), ("conv_id", T.LongType()), ("turn", T.LongType()),
                                                     ("role", T.StringType()), ("text", T.StringType()), ("owner", T.LongType()), ("TEXT", T.StringType()))])


def _table(spark, rows):
    return spark.createDataFrame([("x", "y", *r, 7, "z") for r in rows], ODD)


def _expected(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + seq[h:])
    members, ends = {}, {}
    for c, seq in built.items():
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            kids[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return {(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items()}


def _check(spark, rows, **sizes):
    got = [tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(_table(spark, rows), **sizes).collect()]
    assert len(got) == len(set(got)) and set(got) == _expected(rows)
    return got


def _random(seed, convs, longest, kinds):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-50, 5 * convs), convs):
        for k in range(rnd.choice((1, 2, longest))):
            rows.append((c, k, rnd.choice(("user", "assistant")), f"téxt {rnd.randrange(kinds)}" * rnd.randint(1, 2)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,segment,rows_in_shard", [(1, 64, 1 << 15), (2, 2, 16), (3, 3, 7), (4, 1, 5)])
def test_random_conversations_over_many_shards_and_segments(spark, seed, segment, rows_in_shard):
    got = _check(spark, _random(seed, 150, 12, 2), segment=segment, rows_in_shard=rows_in_shard)
    assert max(r[1] for r in got) >= 12 and sum(r[3] > 2 for r in got) > 10


def test_one_conversation_of_a_third_of_all_rows_and_many_copies(spark):
    rows = [(c, k, "user", f"same {k}") for c in range(300) for k in range(3)] + [(1000, k, "user", f"long {k % 7}") for k in range(500)] + [(1001, k, "user", f"long {k % 7}") for k in range(450)]
    _check(spark, rows, rows_in_shard=64)


def test_odd_rows(spark):
    assert P.prefix_trie(_table(spark, [])).count() == 0
    assert P.prefix_trie(_table(spark, [(None, 1, "user", "of no conversation")])).count() == 0
    _check(spark, [(7, 0, "user", "alone")])
    _check(spark, [(c, None, None, None) for c in (0, 1, 2, 3, 4, 4)] + [(c, 1, "user", "x" * 100000) for c in (3, 4)])
    rows = [(c, t, r, x) for c in range(12) for t, r, x in ((None, "user", "a"), (0, None, "b"), (0, "user", "b"), (0, "user", ""), (0, "user", None), (-5, "user", "c"), (9, "userx", ""), (9, "user", "x"))]
    _check(spark, rows + rows)
    _check(spark, [(c, 0, "user", "t") for c in (5, 6, 7, 8, 9, -5, -6, -7, 2**62)])


def test_ids_of_type_int(spark):
    rows = [(c, k, "user", f"t{k}") for c in range(9) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert {tuple(r[c] for c in COLUMNS) for r in P.prefix_trie(df).collect()} == _expected(rows)
