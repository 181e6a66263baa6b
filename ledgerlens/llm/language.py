"""Operator 1: language identification. Multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and reduced to its letters, with one blank for each run
of anything else; its n-grams of 1 to 3 characters are hashed into ``DIM``
buckets. Training counts n-grams by language over all training rows: tasks
count into dense arrays and send one row for each (language, bucket) they saw.
The matrix of log probabilities - ``DIM`` numbers a language - is broadcast in
blocks of at most ``BLOCK`` languages; documents are scored in batches, as a
sparse matrix of counts times a block. Where there are several blocks, a pass
over the documents for each carries the best language so far and the sum of the
likelihoods.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import batches, pick, remainder, scratch, ship, stored

DIM = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
BLOCK = 400                      # languages scored in one pass: bounds a broadcast to 400 x 32768 x 8 bytes
FLUSH = 16                       # languages a task counts at a time, and that the driver fetches at a time
CELLS = 1 << 21                  # numbers of a scoring batch; a single text may need more, at most DIM x BLOCK
MODULUS, HELD_OUT = 4, 2
UNKNOWN = "und"
DOCS = -1                        # the bucket under which a language's documents are counted


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts by bucket, or None for a text without a letter."""
    total, seen = None, False
    tail = np.zeros(0, np.uint32)
    for at in range(0, len(text), T.CHUNK):
        codes = T.code_points(text[at : at + T.CHUNK])
        letter = T.classes(codes) == T.LETTER
        seen = seen or bool(letter.any())
        codes = np.where(letter, T.lowered(codes), np.uint32(32))
        codes = np.concatenate([tail, codes])
        keep = codes != 32
        keep[:1] |= len(tail) > 0
        keep[1:] |= codes[:-1] != 32
        codes = codes[keep]
        hashed = []
        with np.errstate(over="ignore"):
            for n in ORDERS:
                h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
                for k in range(n):
                    h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x01000193)
                # grams that lie in the carried tail were counted with the chunk before
                h = h[max(0, len(tail) - n + 1) :] if len(tail) else h
                hashed.append((h ^ (h >> np.uint32(15))) & np.uint32(DIM - 1))
        counts = np.bincount(np.concatenate(hashed), minlength=DIM)
        total = counts if total is None else total + counts
        tail = codes[-(max(ORDERS) - 1) :].copy()
    return total if seen and _has_letter(text) else None


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:256]) or any(c.isalpha() for c in text)


def _count(chunks):
    counts: dict[str, np.ndarray] = {}

    def flush():
        for lang, c in counts.items():
            hit = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array((hit - 1).astype(np.int32)), pa.array(c[hit])], names=["lang", "bucket", "n"])
        counts.clear()

    for b in batches(chunks):
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            got = ngram_counts(text)
            if got is None:
                continue
            if lang not in counts and len(counts) >= FLUSH:
                yield from flush()
            own = counts.setdefault(lang, np.zeros(DIM + 1, np.int64))   # place 0: documents
            own[0] += 1
            own[1:] += got
    yield from flush()


def train(docs: DataFrame, block: int = BLOCK):
    """Yields models (languages in order, log priors, log probabilities by bucket and language) of ``block`` languages each.

    They count all rows outside the held-out fold; without any such row there
    is one model of no language.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = (pick(docs, doc_id="doc_id", text="text", lang="lang").where("lang IS NOT NULL AND text IS NOT NULL")
            .where(remainder(F.col("doc_id"), MODULUS) != HELD_OUT).select("text", "lang"))
    counted = stored(rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")),
                     f"{scratch(spark, 'language')}/counts")
    prior = {r["lang"]: r["n"] for r in counted.where(F.col("bucket") == DOCS).collect()}
    total = max(1, sum(prior.values()))
    for at in range(0, max(1, len(prior)), block):
        langs = sorted(prior)[at : at + block]
        counts = np.zeros((DIM, len(langs)))
        for first in range(0, len(langs), FLUSH):
            some = langs[first : first + FLUSH]
            got = counted.where((F.col("bucket") != DOCS) & F.col("lang").isin(some)).toPandas()
            counts[got["bucket"].to_numpy(int), got["lang"].map({x: first + k for k, x in enumerate(some)}).to_numpy(int)] = got["n"].to_numpy(float)
        logs = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * DIM))
        yield langs, np.log(np.array([prior[x] for x in langs], float) / total), logs


def log_likelihoods(texts, priors: np.ndarray, logs: np.ndarray):
    """Yields (places, log likelihoods by text and language) of the texts that have a letter.

    The texts' counts are the rows of a sparse matrix, multiplied by ``logs`` a
    batch of rows at a time.
    """
    places, buckets, counts, cells = [], [], [], 0

    def product():
        hit = np.concatenate(buckets)
        starts = np.cumsum([0] + [len(x) for x in buckets[:-1]])
        return places[:], priors + np.add.reduceat(np.concatenate(counts)[:, None] * logs[hit], starts, axis=0)

    for place, text in enumerate(texts):
        got = ngram_counts(text) if text else None
        if got is None:
            continue
        hit = np.flatnonzero(got)
        if places and cells + len(hit) * len(priors) > CELLS:
            yield product()
            places, buckets, counts, cells = [], [], [], 0
        places.append(place)
        buckets.append(hit)
        counts.append(got[hit].astype(float))
        cells += len(hit) * len(priors)
    if places:
        yield product()


def _scorer(shared):
    """Brings (lang_pred, top, total) up to a further block: the best language, its log likelihood, the sum of all relative to it."""
    def run(chunks):
        langs, priors, logs = shared.value
        for b in batches(chunks):
            pred = np.array(b.column("lang_pred").to_pylist(), object)
            top, total = b.column("top").to_numpy().copy(), b.column("total").to_numpy().copy()
            for places, logp in log_likelihoods(b.column("text").to_pylist(), priors, logs) if langs else ():
                at = np.array(places)
                best = logp.argmax(axis=1)                          # of equal ones the first by name
                here = logp[np.arange(len(at)), best]
                peak = np.maximum(top[at], here)
                total[at] = total[at] * np.exp(top[at] - peak) + np.exp(logp - peak[:, None]).sum(axis=1)
                better = here > top[at]
                pred[at[better]] = np.array(langs, object)[best[better]]
                top[at] = peak
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("text"), pa.array(pred, pa.string()), pa.array(top), pa.array(total)],
                names=["doc_id", "held_out", "text", "lang_pred", "top", "total"])
    return run


def language(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the posterior probability of the predicted language).

    Defined results: ``und`` with score 0 for a null text, a text without a
    letter, or where no training row exists; of equally likely languages the
    first by name; a null doc_id isn't held out and teaches nothing; repeated
    rows are judged alike; an empty table gives no rows. A prediction reads
    the text alone.
    """
    spark = docs.sparkSession
    root = scratch(spark, "language")
    rows = pick(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "text",
        F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("total"))
    before = None
    for k, model in enumerate(train(docs, block)):
        if before is not None:      # a block's broadcast can go before the next one's comes
            rows = stored(rows, f"{root}/block-{k}")
            before.unpersist()
        before = spark.sparkContext.broadcast(model)
        rows = rows.mapInArrow(_scorer(before), rows.schema)
    score = F.when(F.col("total") > 0, 1.0 / F.col("total")).otherwise(0.0)
    return rows.select("doc_id", "held_out", "lang_pred", score.alias("score"))
