"""Operator 5: toxicity by maximum-scoring segments of token log-odds.

1. *Token scores.* The training rows that hold a word are counted by label, in
   ``DIM`` hashed places (rows, not occurrences: a word that one text repeats
   is no evidence). A word's score is its log-odds of toxic against clean text
   under a Dirichlet prior that follows the words' overall frequencies
   (pseudo-counts: ``PRIOR_SHARE`` of all counts), drawn towards zero by its
   standard errors and lowered by a constant, so that clean text drifts down.
2. *Segments.* One linear scan finds every maximal scoring segment: the
   passages whose score no extension or cut improves (the stack algorithm of
   Ruzzo and Tompa, over runs of equal sign).
3. *Calibration.* Under the extreme-value law the best segment of n clean
   words exceeds S with an expectation of ``K n exp(-lambda S)``. Lambda solves
   ``E[exp(lambda s)] = 1`` over clean words; K is fitted to the clean training
   rows' best segments. Each segment counts with its normalised score
   ``lambda S - ln(K n)`` where that is positive; a logistic curve over the sum
   and the best, fitted to the training rows, gives the score from 0 to 1.

The model (one number for each place, and a few constants) is broadcast; its
size doesn't depend on the data. Training rows are a bounded sample
(``max_train_rows``, a parameter); the driver gets sums by place, and three
numbers for each training row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import batches, pick, remainder, scratch, ship, stored
from .training import labelled

DIM = 1 << 20
PRIOR_SHARE = 0.4
CAUTION = 2.0                    # standard errors by which a score is drawn to zero
DRIFT = 0.1                      # what each word costs a segment
MAX_TRAIN_ROWS = 32_768
MODULUS, HELD_OUT = 3, 1
THRESHOLD = 0.7


@dataclass
class Model:
    scores: np.ndarray           # by place
    lam: float                   # lambda of the extreme-value law
    log_k: float                 # ln K
    curve: tuple[float, float, float]


def places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, starts, ends = T.words(text)
    return (hashes & np.uint64(DIM - 1)).astype(np.int64), starts, ends


def token_scores(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds by place with a Dirichlet prior after the overall frequencies, drawn to zero, less the drift."""
    total = toxic + clean
    if not toxic.sum() or not clean.sum():
        return np.full(len(total), -DRIFT)
    prior = PRIOR_SHARE * total.sum()
    alpha = prior * (total + 0.01) / (total + 0.01).sum()
    a, b = toxic + alpha, clean + alpha
    odds = np.log(a / (toxic.sum() + prior - a)) - np.log(b / (clean.sum() + prior - b))
    error = np.sqrt(1.0 / a + 1.0 / b)
    return np.sign(odds) * np.maximum(np.abs(odds) - CAUTION * error, 0.0) - DRIFT


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score), in order, in linear time."""
    if not len(score):
        return []
    up = score > 0
    cut = np.flatnonzero(np.diff(up.view(np.int8))) + 1
    starts = np.concatenate(([0], cut))
    sums = np.add.reduceat(score, starts)
    ends = np.append(cut, len(score))
    total, stack = 0.0, []       # (start, end, sum before it, sum after it, index below of a smaller start, or -1)
    for s, e, v in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        before, total = total, total + v
        if v <= 0:
            continue
        cur = (s, e, before, total)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cur[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= cur[3]:
                stack.append((*cur, j))
                break
            cur = (stack[j][0], cur[1], stack[j][2], cur[3])
            del stack[j:]
    return [(s, e, r - l) for s, e, l, r, _ in stack]


def solve_lambda(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(x s)] = 1; 1 where there is none."""
    used = weight > 0
    score, weight = score[used], weight[used] / max(1e-300, weight.sum())
    if not len(score) or score.max() <= 0 or score @ weight >= 0:
        return 1.0
    low, high = 0.0, 1.0
    excess = lambda x: weight @ np.exp(np.minimum(x * score, 500.0)) - 1.0
    while excess(high) < 0 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def evidence(score: np.ndarray, lam: float, log_k: float) -> tuple[float, float, list[tuple[int, int, float]]]:
    """(sum, best, segments) of the segments' normalised scores, those above zero."""
    offset = log_k + np.log(max(1, len(score)))
    found = [(s, e, lam * v - offset) for s, e, v in segments(score)]
    found = [x for x in found if x[2] > 0]
    return sum(x[2] for x in found), max((x[2] for x in found), default=0.0), found


def fit_curve(total: np.ndarray, best: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve over the logs of sum and best, by a few damped Newton steps."""
    if not len(y):
        return (0.0, 0.0, 0.0)
    x = np.stack([np.ones_like(total), np.log1p(total), np.log1p(best)], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w - np.linalg.solve(hess, grad)
    return tuple(float(v) for v in w)


def curve_score(curve, total: float, best: float) -> float:
    v = curve[0] + curve[1] * np.log1p(total) + curve[2] * np.log1p(best)
    return float(1.0 / (1.0 + np.exp(-np.clip(v, -30, 30))))


def _count(chunks):
    toxic, clean = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64)
    for b in batches(chunks):
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            (toxic if y > 0 else clean)[np.unique(places(t)[0])] += 1
    hit = np.flatnonzero(toxic + clean)
    for at in range(0, len(hit), 1 << 16):
        part = hit[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(toxic[part]), pa.array(clean[part])], names=["place", "toxic", "clean"])


def _measure(shared):
    def run(chunks):
        scores = shared.value
        for b in batches(chunks):
            out = np.zeros((2, b.num_rows))
            for i, t in enumerate(b.column("text").to_pylist()):
                s = scores[places(t)[0]]
                out[:, i] = len(s), max((v for _, _, v in segments(s)), default=0.0)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(out[0]), pa.array(out[1])], names=["y", "n", "best"])
    return run


def _evidence(shared):
    def run(chunks):
        model = shared.value
        for b in batches(chunks):
            out = np.zeros((2, b.num_rows))
            for i, t in enumerate(b.column("text").to_pylist()):
                out[:, i] = evidence(model.scores[places(t)[0]], model.lam, model.log_k)[:2]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(out[0]), pa.array(out[1])], names=["y", "total", "best"])
    return run


def fit_log_k(n: np.ndarray, best: np.ndarray, lam: float) -> float:
    """ln K from clean rows: under the law exp(-K n exp(-lambda S)) is even, so K n exp(-lambda S) has mean 1."""
    if not len(n):
        return 0.0
    return float(-np.log(np.mean(np.maximum(n, 1.0) * np.exp(-lam * best))))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    rows = stored(labelled(docs, labels, "toxic", MODULUS, HELD_OUT, max_train_rows).select("text", "y"), f"{scratch(spark, 'toxicity')}/rows")
    counted = (rows.mapInArrow(_count, "place int, toxic long, clean long").groupBy("place")
               .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas())
    toxic, clean = np.zeros(DIM), np.zeros(DIM)
    toxic[counted["place"]], clean[counted["place"]] = counted["toxic"], counted["clean"]
    scores = token_scores(toxic, clean)
    lam = solve_lambda(scores, clean)
    seen = rows.mapInArrow(_measure(sc.broadcast(scores)), "y double, n double, best double").toPandas()
    quiet = seen[(seen["y"] == 0) & (seen["n"] > 0)]
    model = Model(scores, lam, fit_log_k(quiet["n"].to_numpy(), quiet["best"].to_numpy(), lam), (0.0, 0.0, 0.0))
    held = rows.mapInArrow(_evidence(sc.broadcast(model)), "y double, total double, best double").toPandas()
    model.curve = fit_curve(held["total"].to_numpy(), held["best"].to_numpy(), (held["y"] > 0).to_numpy().astype(float))
    return model


def _scorer(shared):
    def run(chunks):
        model = shared.value
        for b in batches(chunks):
            score, spans = np.zeros(b.num_rows), []
            for i, t in enumerate(b.column("text").to_pylist()):
                place, starts, ends = places(t)
                total, best, found = evidence(model.scores[place], model.lam, model.log_k)
                score[i] = curve_score(model.curve, total, best)
                spans.append([{"start": int(starts[s]), "end": int(ends[e - 1]), "score": v} for s, e, v in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                names=["doc_id", "held_out", "score", "predicted", "passages"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7), passages.

    ``passages`` lists each significant segment with its code points and
    normalised score. Defined results: null and empty texts hold no segment and
    get the curve's lowest value; without labelled rows every score is 0.5;
    with labels of one kind only no word scores; a null doc_id isn't held out
    and teaches nothing; repeated rows score alike; an empty table gives no
    rows; columns other than doc_id and text are not read.
    """
    model = train(docs, labels, max_train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(shared), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int, passages array<struct<start:bigint,end:bigint,score:double>>")
