"""Operators 1, 4, 5 and 9: held-out accuracy, brute force, odd rows."""
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import language, pii, quality, toxicity
from ledgerlens.llm import text as T
from ledgerlens.llm.common import table

from .edge_rows import EDGE, LONG

SF = "/root/testdata/sf0.01"


def _fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_language_on_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language.language(docs).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (_fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_reads_the_text_alone_and_handles_odd_rows(odd):
    teach = [(100 + i, "the cat and the dog", "en") for i in range(30)] + [(200 + i, "der hund und die katze", "de") for i in range(30)]
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language.language(odd([(i, t, "zz" if i and i < 3 else None) for i, t in EDGE] + teach)).collect()}
    und = {(1, "und", False), (2, "und", False), (3, "und", False), (4, "und", False), (10, "und", False), (None, "und", False)}
    assert und <= got and {x[1] for x in got} == {"und", "en", "de"}
    assert {r["lang_pred"] for r in language.language(odd([(1, "abc", None)])).collect()} == {"und"}
    assert language.language(odd([])).count() == 0


def test_ngrams_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = "Ab c, d3  éß\n" * 50 + "  xyz"
    whole = language.ngram_counts(text)
    monkeypatch.setattr(T, "CHUNK", 17)
    assert (language.ngram_counts(text) == whole).all()


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    text = ("Alpha beta, ALPHA\n" * 30) + "gamma"
    h, s, e = T.words(text)
    assert [text[a:b].lower() for a, b in zip(s, e)] == re.findall(r"\w+", text.lower())
    assert len(set(h.tolist())) == 3
    monkeypatch.setattr(T, "CHUNK", 16)
    h2, s2, e2 = T.words(text)
    assert (h == h2).all() and (s == s2).all() and (e == e2).all()
    assert len(T.words("x" * 100)[0]) == 1


def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.quality(docs, labels).collect()
    assert all(r["held_out"] == (_fold(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    toxic = [r["predicted"] for r in held if truth[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in held if truth[r["doc_id"]] == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def test_scores_of_odd_rows_and_without_labels(odd, labels):
    for run, teach in ((quality.quality, labels([])), (toxicity.toxicity, labels([])),
                       (quality.quality, labels([(5, None, None), (6, 1, 0), (7, 0, 1), (7, 1, 1), (None, 1, 1)])),
                       (toxicity.toxicity, labels([(5, None, None), (6, 1, 0), (7, 0, 1), (7, 1, 1), (None, 1, 1)]))):
        got = run(odd(EDGE), teach).collect()
        assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
        assert run(odd([]), teach).count() == 0
    assert {r["score"] for r in quality.quality(odd(EDGE), labels([])).collect()} == {0.5}
    assert {r["score"] for r in toxicity.toxicity(odd(EDGE), labels([])).collect()} == {0.5}


def _all_maximal(score):
    """Maximal scoring segments by definition: the best segment, then the same left and right of it."""
    def inside(lo, hi):
        best = max(((sum(score[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        return inside(lo, best[3]) + [(best[3], best[4], best[0])] + inside(best[4], hi)
    return inside(0, len(score))


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        score = np.array([rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 100 for _ in range(rng.randint(0, 18))])
        got, want = toxicity.segments(score), _all_maximal(score.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_lambda_solves_its_equation():
    s, w = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    lam = toxicity.solve_lambda(s, w)
    assert abs(w @ np.exp(lam * s) - 1) < 1e-6


def _luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def _base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == 3 or _luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    pool = list("abZ09155@@..%+- ()é٣\n") + ["a@b.c", "1.2.3.4", "255.", "4111 1111 1111 1111", "5-", "+1 (301) 555-0346", "@x.y@", "000"]
    for _ in range(20000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert [(s, pii.KINDS.index(k), e) for s, e, k, _ in pii.find(t) if k in pii.BASE_KINDS] == _base_spans(t), t


@pytest.mark.parametrize("number", ["BE68 5390 0754 7034", "BE68539007547034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947",
                                    "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00"])
@pytest.mark.parametrize("after", ["", " EUR", " EUR 100", " BIC", " BANK", " 100", " 1000 EUR", " 2024 BANK 12345", " DE89 3704 0044 0532 0130 00", ", x"])
def test_account_numbers_before_capital_and_digit_tokens(number, after):
    for before in ("", "IBAN ", "AB12 CDEF GHIJ "):
        text = before + number + after
        assert [text[s:e] for s, e in pii.ibans(text)] == [number] + ([after[1:]] if after.startswith(" DE") else [])
        assert number not in pii.redact(text, pii.find(text))


def test_added_kinds_need_their_checksum_or_word():
    assert [k for *_, k, _ in pii.find("IBAN DE89 3704 0044 0532 0130 00.")] == ["iban"]
    assert pii.find("DE88 3704 0044 0532 0130 00") == []
    assert [k for *_, k, _ in pii.find("her SSN is 078-05-1120")] == ["ssn"] and pii.find("no. 078-05-1120") == []
    text = "mail a.b@c.de or 4111 1111 1111 1111"
    assert pii.redact(text, pii.find(text)) == "mail <EMAIL> or <CARD>"


def test_pii_rows_and_redaction_of_odd_tables(odd):
    import hashlib

    docs = odd(EDGE + [(50, "x a@b.co y +1 (301) 555-0346"), (51, LONG + " 10.0.0.1")])
    got = {r["doc_id"]: r for r in pii.pii(docs).collect()}
    assert got[50]["spans"] == "email:2:8,phone:11:28" and got[50]["base_sha256"] == hashlib.sha256(got[50]["spans"].encode()).hexdigest()
    assert got[51]["n_ip"] == 1 and got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    out = pii.redacted(docs)
    assert out.schema.names == docs.schema.names
    rows = {r[1]: r for r in out.collect()}
    assert rows[50][2] == "x <EMAIL> y <PHONE>" and rows[50][5] == len(rows[50][2]) and rows[1][2] is None
    assert pii.pii(odd([])).count() == 0 and pii.redacted(odd([])).count() == 0


def test_long_runs_take_linear_time():
    import time

    for text in ("9" * 300000, "a" * 300000 + "@" * 1000, "+1" * 100000, "+1" + " " * 300000, "1." * 100000, "@a" * 100000):
        began = time.time()
        pii.find(text)
        assert time.time() - began < 20
