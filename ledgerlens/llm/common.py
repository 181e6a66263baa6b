"""Helpers that the training-data operators share: column picking, shared scratch tables, shipping code to executors."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so they can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="ledgerlens-code-")
    path = os.path.join(folder, "ledgerlens_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for root, dirs, files in os.walk(package):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by exact name under new names: ``pick(df, id="doc_id")``.

    Columns are addressed by position, so further columns whose names differ
    only in case, or clash with an operator's own names, do no harm. A column
    that is missing raises ``KeyError``.
    """
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[name]}").alias(new) for new, name in wanted.items()])


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``; nothing is reused between calls."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, *parts: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later jobs start from the files, whichever executors are lost."""
    writer = df.write
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not parts else df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col, modulus: int):
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def batches(chunks, rows: int = 256):
    """Arrow batches cut into slices of at most ``rows`` rows, so that Python holds few texts at a time."""
    for batch in chunks:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on from stage to stage, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # glibc's; others give back by themselves
    if trim is not None:
        trim(0)
