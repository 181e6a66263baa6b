"""Repeated ids, ids of other types, and plain forms of the two text classifiers."""
import collections

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import ann, language, near_dedup, quality, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_near_copies_that_share_an_id_leave_one_row(odd):
    text = " ".join(WORDS * 4)
    rows = [(1, text + " one"), (1, text + " two"), (1, text + " one"), (2, text + " three"), (3, "a text of its own that is unlike the others")]
    got = near_dedup.near_dedup(odd(rows)).collect()
    assert len(got) == len(rows) and {r["group_size"] for r in got} == {4, 1}
    kept = {(r["doc_id"], r["text_hash"]) for r in got if r["kept"]}
    assert collections.Counter(i for i, _ in kept) == {1: 1, 3: 1}
    left = near_dedup.drop_near_copies(odd(rows))
    assert sorted(r["doc_id"] for r in left.select("doc_id").collect()) == [1, 3]


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_quality_takes_ids_of_any_type(spark, kind):
    make = str if kind == "string" else int
    docs = spark.createDataFrame([(make(i), ("good words here " if i % 2 else "spam spam click ") * 5) for i in range(60)], f"doc_id {kind}, text string")
    labels = spark.createDataFrame([(make(i), i % 2, 0) for i in range(60)], f"doc_id {kind}, quality int, toxic int")
    got = {int(r["doc_id"]): r["score"] for r in quality.quality(docs, labels).collect()}
    assert len(got) == 60 and min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))


def test_quality_equals_plain_updates(spark):
    rnd = np.random.default_rng(3)
    texts = {i: " ".join(rnd.choice(WORDS, 12)) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in texts], "doc_id long, quality int, toxic int")
    import struct
    import zlib

    def h(i, last):
        """Spark's xxhash64 of a long and a second value."""
        seed = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
        data = last.encode() if isinstance(last, str) else struct.pack("<q", last)
        if isinstance(last, int):
            return _int_hash(last, seed)
        x = xxhash.xxh64_intdigest(data, seed=seed)
        return x - (1 << 64) if x >> 63 else x

    def _int_hash(value, seed):
        x = xxhash.xxh64_intdigest(struct.pack("<i", value), seed=seed)
        return x - (1 << 64) if x >> 63 else x

    learn = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 0]
    shards = collections.defaultdict(list)
    for i in learn:
        shards[h(i, "shard") % quality.SHARDS].append(i)
    z, n = np.zeros(quality.DIM + 1), np.zeros(quality.DIM + 1)
    for k in range(quality.ROUNDS):
        moves = []
        for own in shards.values():
            zs, ns = z.copy(), n.copy()
            for i in sorted(own, key=lambda i: h(i, k)):
                quality.follow(zs, ns, *quality.features(texts[i]), float(i % 3 == 0))
            moves.append((zs - z, ns - n))
        hits = sum((m[1] != 0).astype(int) for m in moves)
        z, n = z + sum(m[0] for m in moves) / np.maximum(hits, 1), n + sum(m[1] for m in moves) / np.maximum(hits, 1)
    w = quality.leader(z, n)
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    for i, text in texts.items():
        bucket, value = quality.features(text)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(w[bucket] @ value))), rel=1e-9)


def test_language_equals_plain_counts(odd):
    rows = [(i, f"{w} {w[::-1]} {i}", lang) for i, (w, lang) in enumerate((w, lang) for lang, part in (("en", WORDS[:7]), ("de", WORDS[7:14]), ("fr", WORDS[14:])) for w in part)]
    import zlib
    counts, docs = collections.defaultdict(lambda: np.zeros(language.DIM)), collections.Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang] += language.ngram_counts(text)
            docs[lang] += 1
    names = sorted(docs)
    logs = {x: np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * language.DIM)) for x in names}
    for r in language.language(odd(rows)).collect():
        own = language.ngram_counts(next(t for i, t, _ in rows if i == r["doc_id"]))
        score = np.array([np.log(docs[x] / sum(docs.values())) + own @ logs[x] for x in names])
        post = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert r["lang_pred"] == names[int(score.argmax())] and r["score"] == pytest.approx(post.max(), rel=1e-9)


def test_an_id_with_several_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    rows += [(20, rng.standard_normal(8).tolist()), (21, rng.standard_normal(8).tolist()), (20, rows[20][1])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    asked = collections.Counter(r["query_id"] for r in got)
    assert asked == {0: 20, 20: 40, 40: 20} and all(r["vec_id"] != r["query_id"] for r in got)


def test_tolerance_is_a_share_of_the_seeds_mass(spark, tmp_path):
    n = 2000
    hosts = spark.range(n).selectExpr("concat('h', id) AS host", "1.0 * 1e6 AS allow", "0.0 AS block")
    links = spark.range(n).selectExpr("concat('h', id) AS src", f"concat('h', (id * 7 + 1) % {n}) AS dst", "1.0 AS w")
    scores = url_filter.propagate(hosts, links, str(tmp_path / "p"), 0.5, 60, 1e-6)
    assert scores.count() == n and scores.agg({"trust": "sum"}).first()[0] == pytest.approx(n * 1e6, rel=1e-4)


@pytest.mark.parametrize("block", [1, 2])
def test_languages_in_blocks_score_as_in_one(odd, block):
    rows = [(10 * k + i, f"{w} {w[::-1]} {i}", f"l{k}") for k, w in enumerate(WORDS[:5]) for i in range(8)] + [(900, "alpha", None), (901, None, "l1"), (902, "12", "l2")]
    rows += [(2000 + i, "same", f"t{i % 3}") for i in range(30)]                  # ties go to the first by name
    one = {r["doc_id"]: r for r in language.language(odd(rows)).collect()}
    got = language.language(odd(rows), block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] == one[r["doc_id"]]["lang_pred"] and r["score"] == pytest.approx(one[r["doc_id"]]["score"], rel=1e-9)
    assert one[901]["lang_pred"] == "und" == one[902]["lang_pred"] and language.language(odd([]), block).count() == 0


def test_scoring_batches_do_not_change_likelihoods(monkeypatch):
    rng = np.random.default_rng(2)
    texts, priors, logs = [" ".join(WORDS[:k]) for k in range(12)] + [None], rng.random(3), rng.random((language.DIM, 3))

    def scored():
        return {p: row for places, logp in language.log_likelihoods(texts, priors, logs) for p, row in zip(places, logp)}

    whole = scored()
    monkeypatch.setattr(language, "CELLS", 50)
    parts = scored()
    assert sorted(whole) == sorted(parts) == list(range(1, 12))
    for p, row in parts.items():
        assert row == pytest.approx(whole[p]) and row == pytest.approx(priors + language.ngram_counts(texts[p]) @ logs)


def test_many_rules_are_joined_and_judge_as_the_expression(spark):
    rng = np.random.default_rng(4)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org", ""]
    paths = ["/", "/en/", "/en/x", "/es/", ""]
    rules = [(("allow", "block")[rng.integers(2)], hosts[rng.integers(6)], paths[rng.integers(5)]) for _ in range(18)]
    rows = [(i, f"http://{('www.', '')[i % 2]}{hosts[rng.integers(7)]}{paths[rng.integers(5)]}{('', 'p', '?q')[i % 3]}", None) for i in range(150)]
    rows += [(900, None, None), (901, "no host", None), (902, "http://", None), (902, "http://", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    pick = lambda df: sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    joined = pick(url_filter.judged(frame, rules, inline=0))
    assert joined == pick(url_filter.judged(frame, rules)) and len(joined) == len(rows)
    many = rules + [("block", f"h{i}.example", "/") for i in range(url_filter.INLINE_RULES)]
    assert pick(url_filter.url_filter(frame, many)) == pick(url_filter.url_filter(frame, rules))
