"""Operator 4: personal data. Patterns propose spans, checksums confirm them, nearby words adjust their scores.

The base kinds - email, ip, card, phone - are fixed by their patterns and
checks: every span that passes stays, with a score that says how sure it is. The
method adds spans of further kinds, which stay if their score reaches
``ADD_FROM``: iban (mod-97) and ssn (a form too common to stand without a word
that names it).

All patterns run in time linear in the text. A match of the email pattern holds
exactly one ``@`` and begins at the start of the run before it, so the search
goes from one ``@`` to the next; a match of the ip pattern can't begin inside a
run of digits, so only starts of runs are tried.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, pick, ship

# The patterns' character sets and the kinds' order.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Lengths of the countries' account numbers.
IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items() for c in cs.split()}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Words (parts of words, lower case) that make a kind likelier, or less likely, within WINDOW characters.
FOR = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
}
AGAINST = {
    "email": ("example",), "ip": ("version", "release"), "card": ("isbn", "order", "serial"),
    "phone": ("version", "isbn"), "iban": ("serial",), "ssn": ("part no", "serial", "sku"),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
CHECKED, NEAR, AWAY = 0.5, 0.3, -0.2
WINDOW = 40
ADD_FROM = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The account number's check: four places moved to the end, letters as numbers from 10, remainder 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    at, after = text.find("@"), 0            # a match may not begin before `after`
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        after = domain.end() if domain else at + 1
        if domain:
            yield start, after
        at = text.find("@", max(after, at + 1))


def ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            yield m.span()


def ibans(text: str):
    """The match may hold words after the number, or begin before it: at each start the spans that end at a token's end are
    tried, that of the country's length first, then the longest; there are at most ten, of bounded length."""
    m = IBAN.search(text)
    while m:
        found, length = m.group(), IBAN_LENGTH.get(m.group()[:2])
        ends = [len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] == " ")]
        plains = {end: found[:end].replace(" ", "") for end in ends}
        end = next((e for e in sorted(ends, key=lambda e: (len(plains[e]) != length, -e)) if 15 <= len(plains[e]) <= 34 and mod97(plains[e])), None)
        if end:
            yield m.start(), m.start() + end
        m = IBAN.search(text, m.start() + (end or 1))


def ssns(text: str):
    for m in SSN.finditer(text):
        yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}
CONFIRMED = {"card", "iban"}                 # kinds that a checksum has confirmed


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
    value = PRIOR[kind] + (CHECKED if kind in CONFIRMED else 0.0)
    value += NEAR if any(w in near for w in FOR[kind]) else 0.0
    value += AWAY if any(w in near for w in AGAINST[kind]) else 0.0
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every span, by start, then by the kinds' order."""
    out = []
    for rank, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text):
            value = score(text, kind, start, end)
            if kind in BASE_KINDS or value >= ADD_FROM:
                out.append((start, rank, end, kind, value))
    return [(s, e, k, v) for s, _, e, k, v in sorted(out)]


def redact(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one, named for the first."""
    out, at, stop = [], 0, 0
    for start, end, kind, _ in spans:
        if start >= stop:
            out += [text[at:start], f"<{kind.upper()}>"]
        stop = max(stop, end)
        at = stop
    out.append(text[at:])
    return "".join(out)


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)


def _detect(chunks):
    for b in batches(chunks):
        found = [find(t) for t in b.column("text").to_pylist()]
        base = [_join([x for x in f if x[2] in BASE_KINDS]) for f in found]
        counts = [pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k in BASE_KINDS]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
             pa.array([_join(f) for f in found], pa.string()), pa.array([[x[3] for x in f] for f in found], pa.list_(pa.float64()))],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "span_scores"])


def pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, span_scores.

    The counts and the digest are those of the base kinds. Defined results:
    null counts as empty and has no spans (the digest of nothing); spans of
    different kinds may overlap; a null doc_id stays null; repeated rows give
    equal results; an empty table gives no rows; other columns than doc_id and
    text are not read. One pass without a shuffle.
    """
    ship(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_detect, f"doc_id {dict(rows.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, span_scores array<double>")


def _redactor(at: int):
    def run(chunks):
        for b in batches(chunks):
            texts = [t if t is None else redact(t, find(t)) for t in b.column(at).to_pylist()]
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return run


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind, columns unchanged; ``n_chars``, if present, follows the text. The pipeline's form."""
    ship(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    out = plain.mapInArrow(_redactor(at), ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)))
    if "n_chars" in names:
        k = names.index("n_chars")
        out = out.withColumn(f"c{k}", F.when(F.col(f"c{at}").isNull(), F.col(f"c{k}")).otherwise(F.length(f"c{at}")).cast(docs.dtypes[k][1]))
    return out.toDF(*names)
