"""Operators 6 and 8, the registration and the pipeline."""
import collections

import numpy as np
import pytest

from ledgerlens.llm import ann, entry, url_filter
from ledgerlens.llm.common import table


def _exact(ids, vecs, q):
    s = vecs @ vecs[ids.index(q)]
    order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:20]
    return [(ids[i], s[i]) for i in order]


def _recall(spark, ids, vecs):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vecs)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(frame).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in (i for i in ids if i % 20 == 0):
        want = _exact(ids, vecs, q)
        own = got[q]
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1)) and all(a[2] >= b[2] for a, b in zip(own, own[1:]))
        for _, v, s in own:
            assert abs(s - vecs[ids.index(v)] @ vecs[ids.index(q)]) < 1e-9
        hit += len({v for v, _ in want} & {v for _, v, _ in own})
        total += len(want)
    return hit / total


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = rng.standard_normal((2500, 24)).astype(np.float32).astype(np.float64)
    assert _recall(spark, list(range(2500)), vecs) >= 0.9


def test_nodes_alone_in_their_leaves_have_neighbours_and_are_found(spark):
    rng = np.random.default_rng(5)
    cone = rng.standard_normal(16) + 0.02 * rng.standard_normal((1500, 16))
    vecs = np.concatenate([cone, 3 * rng.standard_normal((60, 16))]).astype(np.float32).astype(np.float64)
    ids = [7 * i + 1 if i < 1500 else 20 * i for i in range(len(vecs))]          # every outlier is a query
    assert _recall(spark, ids, vecs) >= 0.9


def test_search_goes_on_while_better_nodes_are_unexpanded(spark, tmp_path):
    ids = list(range(36))                                # each node leads to the next three, better ones, alone
    vecs = np.array([[1.0, i] for i in ids], "<f4")
    graph = spark.createDataFrame([(i, [j for j in range(i + 1, i + 4) if j < 36], [1.0]) for i in ids], ann.LIST)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes()), bytearray()) for i, v in zip(ids, vecs)], ann.NODE)
    found = ann.search(graph, nodes, spark.createDataFrame([(0,)], "id long"), len(ids), 4, str(tmp_path / "s")).collect()
    assert len(found) == 1 and sorted(found[0]["nbr"]) == ids


def test_descent_goes_on_while_neighbours_change(spark, tmp_path):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 48)))], "id long, embedding array<float>")
    nodes = frame.mapInArrow(ann._encode(4), ann.NODE).cache()
    graph = {r["id"]: r["nbr"] for r in ann.build_graph(nodes, 3000, str(tmp_path / "g")).collect()}
    codes = sorted(nodes.collect())
    x = ann._decode([r["code"] for r in codes])
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    hit = [len(set(graph[i]) & set(np.argsort(-sim[i])[:20])) / 20 for i in range(3000)]
    assert np.mean(hit) >= 0.99


def _members(rows):
    """Rows (at, id, vector, floor, new, own) as the descent sends them to a list."""
    import pyarrow as pa

    code = lambda v: np.array([1], "<f4").tobytes() + np.array(v, np.int8).tobytes()
    at, ids, vecs, floor, new, own = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids), pa.array([code(v) for v in vecs]), pa.array(floor, pa.float32()), pa.array(new), pa.array(own)],
                                      names=["at", "id", "code", "floor", "new", "own"])


def test_pairs_that_met_before_are_not_compared_again():
    low = float("-inf")
    x = {1: [1, 0], 2: [2, 0], 3: [3, 1], 4: [0, 5]}
    rows = [(7, i, x[i], low, i == 3, i != 4) for i in (1, 2, 3, 4)] + [(7, 3, x[3], low, False, False)]        # 3 in both directions
    rows += [(8, i, x[i], low, False, True) for i in (1, 2)] + [(9, 4, x[4], low, True, True)]                   # none new; one alone
    rows += [(10, i, x[i], 5.5, True, False) for i in (1, 2, 3)]                                                 # floors
    told, used = collections.defaultdict(dict), {}
    for size in (2, 100):
        whole = _members(rows)
        got = [r for b in ann._compare(8)(whole.slice(k, size) for k in range(0, len(rows), size)) for r in b.to_pylist()]
        pairs = sorted((r["id"], n, s) for r in got for n, s in zip(r["nbr"], r["sim"]))
        assert pairs == [(1, 3, 3.0), (2, 3, 6.0), (2, 3, 6.0), (3, 1, 3.0), (3, 2, 6.0), (3, 2, 6.0), (3, 4, 5.0), (4, 3, 5.0)]
        assert [(r["id"], sorted(r["used"])) for r in got if r["used"]] == [(7, [1, 2, 3])]


def test_descent_compares_only_what_is_new(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 32)))], "id long, embedding array<float>")
    nodes = frame.mapInArrow(ann._encode(4), ann.NODE).cache()
    rounds, real = [], ann.stored
    monkeypatch.setattr(ann, "stored", lambda df, path: rounds.append((path, real(df, path))) or rounds[-1][1])
    ann.build_graph(nodes, 1500, str(tmp_path / "g"))
    graphs = [t.collect() for path, t in rounds if "/graph-" in path]
    left = [sum(sum(r["new"]) for r in g) / sum(len(r["nbr"]) for r in g) for g in graphs]
    assert len(graphs) > 3 and left[0] == 1 and left[-1] < 0.01
    for before, after in zip(graphs, graphs[1:]):
        old = {r["id"]: set(r["nbr"]) for r in before}
        for r in after:                                  # all that a node had before has been compared from it
            assert {n for n, new in zip(r["nbr"], r["new"]) if new} == set(r["nbr"]) - old[r["id"]] and r["fresh"] == sum(r["new"])


def test_many_queries_share_copies_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKED", 3)
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(9)
    vecs = rng.standard_normal((300, 6)).astype(np.float32).astype(np.float64)
    assert _recall(spark, list(range(300)), vecs) == 1


def test_tasks_follow_the_nodes_not_the_shuffle_partitions(spark):
    rows, most = spark.range(1000).withColumnRenamed("id", "at"), spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        parts = [p for p in ann._together(rows, "at", 1000).rdd.glom().map(lambda p: [r["at"] for r in p]).collect()]
        assert len(parts) <= most and sorted(sum(parts, [])) == list(range(1000)) and all(p == sorted(p) for p in parts)
        assert most < ann._together(rows, "at", 30 * ann.BLOCK).rdd.getNumPartitions() <= 30
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_copies_ties_and_unsound_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(4).astype(np.float32).tolist()
    rows = [(i, base) for i in range(60)] + [(60 + i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(10)]
    rows += [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [float("nan"), 1.0, 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0, 1.0]), (None, base), (200, [1.0]), (40, base)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, VEC_ID string")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(frame).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {0, 20, 40, 60}
    nearer = [v for v, x in rows if 60 <= (v or 0) < 70 and np.dot(x, base) > np.dot(base, base)]
    for q in (0, 20, 40):
        copies = [v for v in got[q] if v < 60]
        assert set(nearer) <= set(got[q]) and copies == [i for i in range(60) if i != q][: len(copies)] and len(got[q]) == 20


def test_few_or_no_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.nearest(make([])).count() == 0 and ann.nearest(make([(0, [1.0, 2.0])])).count() == 0
    assert [tuple(r) for r in ann.nearest(make([(0, [1.0, 2.0]), (1, [0.5, 0.5])])).collect()] == [(0, 1, 1, 1.5)]


def _judge(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = max(((len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[1], best and best[2]


URLS = ["http://Example.COM/en/x?y", "https://www.example.com/en/1#z", "http://a.example.com/EN/", "ftp://net/es/1", "http://x.net/fr/", "http://x.net/de/", "http://xnet/es/",
        "http://example.com", "http://example.com?/en/", None, "", "no scheme", "://x.com/", "http://ÄB.com/a", "a://b://c.com/d", "http://x.com/a\nb?c", "http://u@example.com:80/en/"]


def test_rules_equal_the_plain_reading(spark):
    rows = [(i, u, None, "extra") for i, u in enumerate(URLS)] + [(None, "http://x.net/es/", "<a href='http://y.org/'>", None), (0, URLS[0], None, None)]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string, HOST string")).collect()
    assert len(got) == len(rows)
    for r in got:
        url = dict((i, u) for i, u, *_ in rows)[r["page_id"]]
        host, path, rule, verdict = _judge(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_trust_and_distrust_equal_dense_iteration(spark):
    rng = np.random.default_rng(3)
    hosts = [f"h{i}.org" for i in range(12)] + [f"b{i}.net" for i in range(4)] + [f"g{i}.com" for i in range(4)]
    pages, links = [], collections.Counter()
    for k in range(200):
        src = hosts[rng.integers(len(hosts))]
        out = [hosts[j] for j in rng.integers(0, len(hosts), rng.integers(0, 4))]
        pages.append((k, f"http://{src}/es/{k}", " ".join(f'<a class=x href="http://{d.upper()}/p">' for d in out) + '<a href="/own">'))
        for d in out:
            if d != src:
                links[src, d] += 1
    rules = [("block", "net", "/es/"), ("allow", "com", "/")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, block_from=0.1).collect()}
    n, at = len(hosts), {h: i for i, h in enumerate(hosts)}
    w = np.zeros((n, n))
    for (s, d), c in links.items():
        w[at[s], at[d]] = c
    own = w.sum(axis=1) == 0
    w[own, own.nonzero()[0]] = 0
    w = np.where(own[:, None], np.eye(n), w / np.maximum(w.sum(axis=1, keepdims=True), 1))
    used = {p[1].split("/")[2] for p in pages} | {d for _, d in links}
    allow = np.array([float(h.endswith(".com") and h in {p[1].split("/")[2] for p in pages}) for h in hosts])
    block = np.array([float(h.endswith(".net") and h in {p[1].split("/")[2] for p in pages}) for h in hosts])
    t, d = allow.copy(), block.copy()
    for _ in range(20):
        t, d = 0.15 * allow + 0.85 * (t @ w), 0.15 * block + 0.85 * (w @ d)
    bad = {h for h in hosts if d[at[h]] >= 0.1 and d[at[h]] > t[at[h]]}
    assert used and any(h.endswith(".org") for h in bad)
    for k, url, _ in pages:
        host = url.split("/")[2]
        want = "allow" if host.endswith(".com") else "block" if host.endswith(".net") or host in bad else "allow"
        assert got[k] == want, host


def test_propagation_ends_by_convergence(spark):
    links = lambda other: " ".join([f'<a href="http://{other}/">'] * 99 + ['<a href="http://b.net/">'])
    pages = [(0, "http://h0.org/", links("h1.org")), (1, "http://h1.org/", links("h0.org")), (2, "http://b.net/es/", "")]
    w = np.array([[0, 0.99, 0.01], [0.99, 0, 0.01], [0, 0, 1]])
    block = np.array([0.0, 0.0, 1.0])
    d = np.linalg.solve(np.eye(3) - 0.85 * w, 0.15 * block)
    after_20 = block
    for _ in range(20):
        after_20 = 0.15 * block + 0.85 * (w @ after_20)
    assert after_20[0] < 0.053 < d[0]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["verdict"] for r in url_filter.url_filter(frame, [("block", "net", "/es/")], block_from=0.053).collect()} == {"block"}
    with pytest.raises(RuntimeError):
        url_filter.url_filter(frame, [("block", "net", "/es/")], rounds=3)


def test_all_operators_are_registered():
    import __spark_entry__ as E

    names = [q for q in E.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_exact_dedup_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, entry.op3_exact_dedup(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert got == sorted(con.execute(entry.SQL["op3_exact_dedup"]).fetchall())


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as P
    from ledgerlens.llm import pii

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    names, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, sf).cache()
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == names, name
        if name == "exact_dedup":
            texts = [r["text"] for r in before.collect()]
            assert sorted(r["text"] for r in docs.collect()) == sorted(set(texts))
        if name == "pii":
            assert seen[-1] == seen[-2]
            assert all(not [x for x in pii.find(r["text"]) if x[2] in pii.BASE_KINDS] for r in docs.collect())
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] <= seen[5]
