"""Operators 3 and 10 against brute force, with collisions forced and on odd tables."""
import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import exact_dedup as X
from ledgerlens.llm import near_dedup as N
from ledgerlens.llm import text as T
from ledgerlens.llm.components import components

from .edge_rows import EDGE


def _expected_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hash_bits,capacity", [(64, 1 << 16), (3, 4), (10, 2)])
def test_exact_dedup_is_exact_even_where_hashes_collide(odd, hash_bits, capacity):
    rows = EDGE + [(100 + i, f"text {i % 70}") for i in range(200)]
    got = X.exact_dedup(odd(rows), capacity=capacity, hash_bits=hash_bits).collect()
    assert sorted(map(tuple, got), key=repr) == _expected_exact(rows)


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h")
    leaves = X.directory(keys, 50)
    assert len(leaves) > 100 and sum(2.0**-d for _, d in leaves) == 1.0
    counted = X._with_bucket(keys, leaves, spark).groupBy("bucket").count().collect()
    assert all(r["bucket"] is not None and r["count"] <= 50 for r in counted) and sum(r["count"] for r in counted) == 5000


def test_owners_hold_key_ranges_and_compare_without_a_further_exchange(spark, odd):
    """The aggregation by text adds no exchange to the one by ranges that makes the owners."""
    rows = [(i, "hot" if i % 3 else f"text {i % 40}") for i in range(600)]
    keyed = X._with_bucket(X._entries(odd(rows), 64), [(0, 0)], spark)
    hot = keyed.where("text = 'hot'").select("h").distinct()
    entries = X.chains(keyed, hot)
    assert sorted((r["keep_id"], r["group_size"]) for r in entries.collect()) == sorted(
        (max(i for i, u in rows if u == t), sum(u == t for _, u in rows)) for t in {t for _, t in rows})
    plan = entries._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    above = plan[: plan.index("rangepartitioning(bucket")]
    assert above.count("Exchange") == 1 and "text" in above


def test_empty_tables(odd):
    assert X.exact_dedup(odd([])).count() == 0 and N.near_dedup(odd([])).count() == 0
    assert X.drop_copies(odd([])).count() == 0 and N.drop_near_copies(odd([])).count() == 0


def test_drop_copies_keeps_columns_and_one_row_of_each_text(odd):
    docs = odd(EDGE)
    kept = X.drop_copies(docs)
    assert kept.schema.names == docs.schema.names
    texts = [r[2] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in EDGE})


def _similarity(a, b):
    def bag(t):
        w = re.findall(r"[^\W_]+", t.lower())
        n = min(5, len(w))
        return collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def _corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for copy in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4]) if copy else 0):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def test_near_dedup_equals_components_of_all_pairs(odd):
    rows = _corpus()
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in rows:
        for j, b in rows:
            if i < j and _similarity(a, b) >= N.SIMILARITY:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = N.near_dedup(odd(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i, _ in rows}
    sizes = collections.Counter(find(i) for i, _ in rows)
    assert all(r["group_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_near_dedup_on_odd_rows(odd):
    got = N.near_dedup(odd(EDGE)).collect()
    assert len(got) == len(EDGE)
    same = [r for r in got if r["class_id"] == 7]
    assert len(same) == 4 and {r["group_size"] for r in same} == {4} and [r["doc_id"] for r in same if r["kept"]] == [7]
    for r in got:
        if r["doc_id"] in (1, 2, 3, 4):
            assert (r["class_id"], r["group_size"], r["kept"]) == (r["doc_id"], 1, True)


def test_a_large_family_without_a_common_text_is_one_group(odd):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = N.near_dedup(odd(rows)).collect()
    assert {r["class_id"] for r in got} == {0} and {r["group_size"] for r in got} == {120}


@pytest.mark.parametrize("size", [3, 60, 3000])
def test_signatures_estimate_weighted_similarity(size):
    rng = np.random.default_rng(size)
    seen = []
    for _ in range(40):
        x = rng.integers(0, 2**63, int(1.25 * size) + 1).astype(np.uint64)
        a, b = x[:size], x[len(x) - size:]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        seen.append((N.signature(np.sort(a)) == N.signature(np.sort(b))).mean() - true)
    assert abs(np.mean(seen)) < 0.06


def test_repeated_shingles_weigh_by_occurrence():
    once, twice = (N.cells(T.words("a b c d e " * n)[0]) for n in (4, 8))
    assert len(twice) > len(once) and set(once) <= set(twice)


def test_components_of_paths_and_stars(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 301), (301, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 300: 300, 301: 300}


def _templates(n):
    """Sets of 16 cells: eleven of a template and five of their own, or of few choices; among them some that reach the similarity."""
    rng = np.random.default_rng(8)
    own = [np.concatenate([np.arange(11), 1000 + 5 * i + np.arange(5)]) for i in range(n)]
    own += [np.append(own[7 * i][:15], 10**6 + i) for i in range(50)]                       # one cell changed: 15 / 17
    own += [np.append(own[7 * i][:13], 2 * 10**6 + 3 * i + np.arange(3)) for i in range(50)]    # three: 13 / 19
    own += [np.append(np.arange(11), 500 + rng.choice(12, 5, replace=False)) for _ in range(300)]     # common cells alone
    return [np.sort(c).astype(np.int32) for c in own]


def test_large_open_family_finds_the_pairs_of_all(spark, tmp_path):
    own = _templates(5000)
    nodes = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(own)], "uid long, cells array<int>")
    left = spark.createDataFrame([(0, i, 1, i) for i in range(len(own))], "band long, uid long, weight long, label long")
    got = {(min(r), max(r)) for r in map(tuple, N._between(left, nodes, str(tmp_path / "b")).collect())}
    at = np.arange(len(own))
    assert got == {(int(x), int(y)) for x, y in zip(*np.nonzero(N._alike(own, at, at))) if x < y} and len(got) >= 50


def test_chunks_of_short_texts_are_compared_in_bounded_memory():
    own = _templates(8000)
    text = [{"uid": i, "label": i, "chunk": 0, "cells": c.tolist()} for i, c in enumerate(own)]
    kind = pa.list_(pa.struct([("uid", pa.int64()), ("label", pa.int64()), ("chunk", pa.int32()), ("cells", pa.list_(pa.int32()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([text], kind)], names=["i", "j", "texts"])
    del text
    tracemalloc.start()
    found = sum(b.num_rows for b in N._meet([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 50 and peak < 500 << 20
