"""Corpus pipeline: quality, exact copies, near copies, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``:

- ``quality`` drops the documents that the classifier rejects;
- ``exact_dedup`` keeps one row of each text;
- ``near_dedup`` keeps one document of each group of near copies;
- ``pii`` replaces personal data by its kind;
- ``packing`` returns the pieces of what is left, with their ids and places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, exact_dedup, near_dedup, packing, pii, quality
from ledgerlens.llm.common import scratch, stored, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(bpe.VOCABULARY), with_ids=True)


STAGES = [
    ("quality", _quality),
    ("exact_dedup", _exact_dedup),
    ("near_dedup", _near_dedup),
    ("pii", _pii),
    ("packing", _packing),
]

# The trained classifier, signatures and tokeniser have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{root}/{k}-{name}")
    return docs
