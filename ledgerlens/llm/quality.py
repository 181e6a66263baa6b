"""Operator 9: quality classifier. Hashed word n-gram logistic regression, trained with FTRL updates.

Features are single tokens and pairs of neighbours (words in their own case,
runs of marks), hashed into ``DIM`` buckets; a pair of equal tokens is one
common feature, "a token repeats", whichever token it is. Counts are scaled to
length one. A score is the sparse dot product of a document's features with
the weights, through the logistic function.

Training is distributed over ``SHARDS`` shards of a bounded sample of labelled
rows (``max_train_rows``, a parameter): in each round every shard follows the
regularised leader from the shared state through its rows, and the states'
changes are averaged for the next round. The state - two numbers a bucket - is
all that passes through the driver; its size doesn't depend on the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import batches, pick, remainder, scratch, ship, stored
from .training import labelled

DIM = 1 << 17
BIAS = DIM                       # the last place of the state
SHARDS = 4
ROUNDS = 4
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.0, 0.01
MAX_TRAIN_ROWS = 16_384
REPEAT = 0x51ED270B              # stands for any pair of equal tokens
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text, the bias included; an empty text has the bias alone."""
    tok = T.tokens(text)
    pairs = T.grams(tok, 2)
    if len(pairs):
        pairs[tok[1:] == tok[:-1]] = REPEAT
    bucket, count = np.unique(np.concatenate([tok, pairs]) & np.uint64(DIM - 1), return_counts=True)
    value = count / np.sqrt((count * count).sum()) if len(count) else count.astype(float)
    return np.append(bucket.astype(np.int64), BIAS), np.append(value, 1.0)


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that follow the regularised leader for the state (z, n)."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(z: np.ndarray, n: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: float) -> None:
    """One update of the state by one row, in place."""
    zi, ni = z[bucket], n[bucket]
    w = leader(zi, ni)
    p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35.0, 35.0)))
    g = (p - y) * value
    z[bucket] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
    n[bucket] = ni + g * g


def _featurise(chunks):
    for b in batches(chunks):
        both = [features(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("y"), b.column("shard"),
             pa.array([x.astype(np.int32) for x, _ in both], pa.list_(pa.int32())),
             pa.array([v for _, v in both], pa.list_(pa.float64()))], names=["doc_id", "y", "shard", "bucket", "value"])


def _round(shared):
    def run(chunks):
        z0, n0 = shared.value
        states: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches(chunks):
            cols = [b.column(c).to_pylist() for c in ("shard", "y")]
            for shard, y, bucket, value in zip(*cols, b.column("bucket"), b.column("value")):
                z, n = states.setdefault(shard, (z0.copy(), n0.copy()))
                follow(z, n, bucket.values.to_numpy(), value.values.to_numpy(), y)
        for z, n in states.values():
            hit = np.flatnonzero(n != n0)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(z[hit] - z0[hit]), pa.array(n[hit] - n0[hit])], names=["bucket", "dz", "dn"])
    return run


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """Weights, ``DIM + 1`` numbers. Without labelled rows all are zero."""
    spark = docs.sparkSession
    ship(spark)
    rows = labelled(docs, labels, "quality", MODULUS, HELD_OUT, max_train_rows)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)).cast("int"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = stored(rows.mapInArrow(_featurise, f"doc_id {kind}, y double, shard int, bucket array<int>, value array<double>"), f"{scratch(spark, 'quality')}/rows")
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((z, n))
        order = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", F.lit(k)), "y")
        moved = (order.mapInArrow(_round(shared), "bucket int, dz double, dn double")
                 .groupBy("bucket").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toPandas())
        z, n = z.copy(), n.copy()
        z[moved["bucket"]] += moved["dz"]
        n[moved["bucket"]] += moved["dn"]
    return leader(z, n)


def _scorer(shared):
    def run(chunks):
        w = shared.value
        for b in batches(chunks):
            out = np.zeros(b.num_rows)
            for i, t in enumerate(b.column("text").to_pylist()):
                bucket, value = features(t)
                out[i] = 1.0 / (1.0 + np.exp(-np.clip(w[bucket] @ value, -35.0, 35.0)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(out)], names=[*b.schema.names[:-1], "score"])
    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    ship(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_scorer(shared), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: good), predicted (score >= 0.3).

    Defined results: null and empty texts get the score of the bias alone;
    without labelled rows every score is 0.5; a null doc_id isn't held out and
    teaches nothing; repeated rows score alike; an empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    return score(docs, train(docs, labels, max_train_rows))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns unchanged; no shuffle. The pipeline's form."""
    weights = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    rows = plain.withColumn("text", F.coalesce(F.col(f"c{at}"), F.lit("")))
    return (rows.mapInArrow(_scorer(shared), ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)), "score double"]))
            .where(F.col("score") >= THRESHOLD).drop("score").toDF(*names))
