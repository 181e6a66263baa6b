"""Operator 3: exact deduplication over an extendible-hash index kept in shared files. DataFrame functions only.

Texts are equal when their bytes are (null counts as empty). The index is
built in these steps:

1. *Directory.* Rows are counted by the hash of their text, then keys by the
   first bits of that hash. As long as a bucket holds more than ``capacity``
   keys it is split by its next bit and, where that exceeds the directory's
   depth, the directory doubles. Only bucket counts reach the driver, at most
   ``MAX_DIRECTORY`` of them: the capacity grows with the number of keys to keep
   it so. Equal hashes can't be split by bits; they stay in one bucket.
2. *Owners.* Rows go with their bytes to the task that owns their range of
   (bucket, hash). Hashes of at least 1/``COMBINE_SHARE`` of the rows - there are
   at most ``COMBINE_SHARE`` - are first reduced to one row a task and text, so
   that a hot text arrives as a handful of rows.
3. *Chains.* An owner compares the texts under one hash byte by byte: each
   different text becomes an entry of that hash's chain, with the largest id and
   the number of its rows. The entries are written as the index files, a file
   for each owner.
4. *Probe.* Every row walks the chain of its (bucket, hash) to the entry with its
   digest. Entries of at least a thousandth of all rows - there are at most a
   thousand - are probed by broadcast, so a hot text isn't sent to one task; the
   rest by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, scratch, stored

MAX_DIRECTORY = 1 << 14
HEAVY_SHARE = 1000          # entries of at least 1/1000 of the rows are broadcast: at most 1000 exist
COMBINE_SHARE = 1 << 17     # hashes of at least this share of the rows are combined before they travel
FIRST_DEPTH = 10
DEPTH_STEP = 4
MAX_DEPTH = 48


def _entries(docs: DataFrame, hash_bits: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.xxhash64(text)
    if hash_bits < 64:      # fewer bits make collisions, for tests
        hashed = F.shiftleft(hashed, 64 - hash_bits)
    return pick(docs, doc_id="doc_id", text="text").select(
        "doc_id", hashed.alias("h"), F.sha2(text, 256).alias("digest"), text.alias("text"))


def _prefix(depth: int):
    return F.shiftrightunsigned(F.col("h"), 64 - depth)


def directory(keys: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """Leaf buckets as (prefix, depth), in key order, by splitting overfull buckets of the distinct hashes ``h``.

    Counts at the directory's depth come from one aggregation; only buckets
    that are still overfull at that depth are counted again, deeper.
    """
    total = keys.count()
    capacity = max(capacity, -(-2 * total // MAX_DIRECTORY))
    leaves: list[tuple[int, int]] = []
    top, depth, pending = 0, FIRST_DEPTH, [0]     # prefixes at depth ``top`` that are to be refined
    while pending:
        inside = keys.where(_prefix(top).isin(pending)) if top else keys
        counts = {r["p"]: r["n"] for r in inside.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n")).collect()}
        held = {depth: counts}                    # keys below each prefix, from the deepest level upwards
        for d in range(depth - 1, top - 1, -1):
            held[d] = {}
            for p, n in held[d + 1].items():
                held[d][p >> 1] = held[d].get(p >> 1, 0) + n
        todo, overfull = [(p, top) for p in pending], []
        while todo:
            p, d = todo.pop()
            if held[d].get(p, 0) <= capacity or d >= MAX_DEPTH:
                leaves.append((p, d))
            elif d == depth:
                overfull.append(p)                # overfull at full depth: the directory doubles
            else:
                todo += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        top, depth, pending = depth, min(depth + DEPTH_STEP, MAX_DEPTH), overfull
    return sorted(leaves, key=lambda x: x[0] << (MAX_DEPTH - x[1]))


def _with_bucket(df: DataFrame, leaves: list[tuple[int, int]], spark: SparkSession) -> DataFrame:
    """Adds ``bucket``: one lookup for each depth that leaves have (a handful), by the key's prefix at that depth."""
    rows = [(i, p, d) for i, (p, d) in enumerate(leaves)]
    out = df.withColumn("bucket", F.lit(None).cast("int"))
    for depth in sorted({d for _, _, d in rows}):
        if depth == 0:
            return df.withColumn("bucket", F.lit(0))
        level = spark.createDataFrame([(i, p) for i, p, d in rows if d == depth], "b int, p long")
        out = (out.withColumn("p", _prefix(depth)).join(F.broadcast(level), "p", "left")
               .withColumn("bucket", F.coalesce("bucket", "b")).drop("p", "b"))
    return out


def chains(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Index entries (bucket, h, digest, keep_id, group_size), in key order, from rows (bucket, h, digest, text, doc_id).

    ``hot`` holds the hashes ``h`` whose rows are combined before they travel.
    The exchange by ranges of (bucket, h) makes the owners; the aggregation
    after it adds none of its own and compares whole texts.
    """
    hot = F.broadcast(hot)
    keys = ["bucket", "h", "digest", "text"]
    combined = rows.join(hot, "h", "left_semi").groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    single = rows.join(hot, "h", "left_anti").select(*keys, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    return (single.unionByName(combined).repartitionByRange("bucket", "h")
            .groupBy(*keys).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
            .drop("text").sortWithinPartitions("bucket", "h", "digest"))


def exact_dedup(docs: DataFrame, capacity: int = 1 << 16, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Defined results: a
    null text counts as empty; a null doc_id loses to any other and is kept
    only where all ids of its group are null; a row that repeats both id and
    text counts in ``group_size`` and carries the same ``kept`` as its twin;
    an empty table gives no rows; columns other than doc_id and text are not
    read.
    """
    spark = docs.sparkSession
    root = scratch(spark, "exact-dedup")
    entries = stored(_entries(docs, hash_bits).drop("text"), f"{root}/entries")
    rows = entries.count()
    counts = stored(entries.groupBy("h").agg(F.count("*").alias("n")), f"{root}/counts")
    leaves = directory(counts.select("h"), capacity)
    hot = counts.where(F.col("n") >= max(2, -(-rows // COMBINE_SHARE))).select("h")
    index = stored(chains(_with_bucket(_entries(docs, hash_bits), leaves, spark), hot), f"{root}/index")
    entries = _with_bucket(entries, leaves, spark)
    # Single texts need no lookup of their group, but are probed like the rest: the index is the only authority.
    heavy_from = max(2, -(-rows // HEAVY_SHARE))
    heavy = F.broadcast(index.where(F.col("group_size") >= heavy_from).select("h", "digest", "keep_id", "group_size"))
    light = index.where(F.col("group_size") < heavy_from)
    hot = entries.join(heavy, ["h", "digest"])
    cold = (entries.join(heavy.select("h", "digest"), ["h", "digest"], "left_anti")
            .join(light, ["bucket", "h", "digest"]))
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256")]
    return hot.select(*cols).unionByName(cold.select(*cols))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each text, its columns unchanged. The pipeline's form of ``exact_dedup``."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    keyed = plain.withColumn("kept_id", doc_id).withColumn("kept_sha", F.sha2(F.coalesce(text, F.lit("")), 256))
    cond = keyed["kept_sha"].eqNullSafe(kept["kept_sha"]) & keyed["kept_id"].eqNullSafe(kept["kept_id"])
    return (keyed.join(kept, cond, "left_semi").dropDuplicates(["kept_sha", "kept_id"])
            .drop("kept_id", "kept_sha").toDF(*names))


SQL = """
SELECT doc_id,
       MAX(doc_id) OVER (PARTITION BY t) AS keep_id,
       COUNT(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM MAX(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents) d
"""
