"""Operator 2: best-fit packing of documents into sequences of bounded length, by best-two-fit.

A bin is filled greedily, always with the longest unpacked piece that fits;
then its smallest piece is replaced by two unpacked pieces, if two exist that
together fit its place and the gap more tightly. Pieces of equal length are
interchangeable, so the algorithm only needs to know how many pieces there are
of each length: at most ``capacity`` numbers, which the driver gets whatever
the corpus holds. A bin's pattern repeats as long as every length it uses
lasts, so the plan consists of patterns with a repeat count. A repeat ends when
some length falls short of the m it is used in one bin, and m is at most
capacity / length: there are at most capacity * (1 + ln capacity) patterns of at
most sqrt(2 * capacity) lengths each - the bound of what is broadcast.

Spark does the rest: tasks tokenise and cut documents and number their own
pieces of each length; a running sum over tasks turns that into ranks by
length; a piece's length and rank lead to its bin and place by binary search
in the plan. No step gathers pieces of one length (a length may hold a third of
all pieces) and no piece passes through the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Shared, _texts, encoder
from .common import batches, scratch, ship, stored

CAPACITY = 2048
END = 0                          # the id that ends every document


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, pieces), ...], repeats)`` that use up ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    plan = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return plan
        used: dict[int, int] = {}
        gap = capacity
        while True:
            top = int(np.searchsorted(lengths, gap, "right")) - 1
            while top >= 0 and used.get(int(lengths[top]), 0) >= left[lengths[top]]:
                top -= 1
            if top < 0:
                break
            size = int(lengths[top])
            take = min(int(left[size]) - used.get(size, 0), gap // size)
            used[size] = used.get(size, 0) + take
            gap -= take * size
        smallest = min(used)
        if gap and sum(used.values()) > 1:
            pair = _tightest_pair(left, used, gap + smallest, smallest)
            if pair:
                used[smallest] -= 1
                for size in pair:
                    used[size] = used.get(size, 0) + 1
                used = {s: m for s, m in used.items() if m}
        repeats = min(int(left[s]) // m for s, m in used.items())
        for s, m in used.items():
            left[s] -= m * repeats
        plan.append((sorted(used.items(), reverse=True), repeats))


def _tightest_pair(left: np.ndarray, used: dict[int, int], room: int, smallest: int) -> tuple[int, int] | None:
    """Two unpacked lengths of the largest sum up to ``room`` and above ``smallest``; of equal sums, the longest first."""
    free = left[: room + 1].copy()
    for s, m in used.items():
        if s <= room:
            free[s] -= m
    lengths = np.flatnonzero(free > 0)
    if not len(lengths):
        return None
    partner = np.searchsorted(lengths, np.minimum(lengths, room - lengths), "right") - 1
    alone = (partner >= 0) & (lengths[partner] == lengths) & (free[lengths] < 2)
    partner = partner - alone
    total = np.where(partner >= 0, lengths + lengths[np.maximum(partner, 0)], 0)
    best = int(total.max())
    if best <= smallest:
        return None
    a = int(np.flatnonzero(total == best)[-1])
    return int(lengths[a]), int(lengths[partner[a]])


class Plan:
    """The patterns as arrays to look pieces up in: by length, and by the first rank that an entry serves."""

    def __init__(self, patterns, capacity: int):
        rows, served, sequence = [], np.zeros(capacity + 1, np.int64), 0
        for pattern, repeats in patterns:
            offset = 0
            for size, m in pattern:
                rows.append((size, served[size], sequence, m, offset))
                served[size] += m * repeats
                offset += size * m
            sequence += repeats
        rows.sort()
        self.length, self.rank, self.sequence, self.each, self.offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
        self.sequences = sequence
        self.key = (self.length << 48) | self.rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        at = np.searchsorted(self.key, (length.astype(np.int64) << 48) | rank, "right") - 1
        q = rank - self.rank[at]
        return self.sequence[at] + q // self.each[at], self.offset[at] + (q % self.each[at]) * length


def _cut(shared, capacity: int, with_ids: bool):
    def run(chunks):
        enc = encoder(shared)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches(chunks, 1024):
            doc, piece, start, size, crc, nth, ids_out = [], [], [], [], [], [], []
            for i, ids in enumerate(enc.encode_many(b.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    nth.append(int(seen[len(own)]))
                    seen[len(own)] += 1
                    if with_ids:
                        ids_out.append(own.astype(np.int32))
            n = len(doc)
            cols = {"doc_id": b.column("doc_id").take(pa.array(doc, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * n, pa.int32()), "nth": pa.array(nth, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def _place(shared, names: list[str]):
    def run(chunks):
        plan = shared.value
        for b in chunks:
            if not b.num_rows:
                continue
            sequence, offset = plan.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids on request.

    A document's ids are its text's and then ``END``; only documents longer
    than ``capacity`` are cut. Defined results: a null or empty text is one
    piece of one id; a null doc_id stays null; repeated rows are packed as
    often as they stand; pieces of equal length take places in the order of
    task and row; an empty table gives no rows; other columns than doc_id and
    text are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch(spark, "packing")
    rows = _texts(docs)
    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if with_ids else "")
    pieces = stored(rows.mapInArrow(_cut(Shared(spark, path), capacity, with_ids), schema), f"{root}/pieces")
    by_part = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), f"{root}/counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():       # at most `capacity` rows
        counts[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(Plan(best_two_fit(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    out = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_place(plan, names), out)
