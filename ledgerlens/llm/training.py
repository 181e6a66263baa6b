"""Choice of labelled training rows: a bounded sample, joined to whole texts without a shuffle of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, remainder

UNIT = 1 << 31


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of about ``max_rows`` labelled documents outside the held-out fold; all of them if fewer.

    Rows are chosen by a hash of their id, so the choice is the same in every
    run. A null label or id teaches nothing; of several labels for a document
    the largest holds; a null text is empty.
    """
    pool = (pick(labels, doc_id="doc_id", y=label).where("y IS NOT NULL")
            .where(remainder(F.col("doc_id"), modulus) != held_out)
            .groupBy("doc_id").agg(F.max("y").cast("double").alias("y")))
    share = min(1.0, max_rows / max(1, pool.count()))
    chosen = pool.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(UNIT)) < int(share * UNIT))
    # At most about max_rows (id, label) pairs: 16 bytes each, whatever the corpus holds.
    return (pick(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"))
