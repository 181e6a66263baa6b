"""Operator 11: the trie of conversation prefixes, by sorted matrices of turn ids.

*Turns.* A turn's id is 128 bits of the SHA-256 of its role and text. A turn's
place in its conversation comes from range shards of the ordered turns: each
shard numbers its own, and the counts of earlier shards are added where a
conversation goes on from one shard to the next, so no conversation has to be
in one task. A conversation becomes rows of at most ``SEGMENT`` turn ids; rows
beyond the first are keyed by a sum of hashes of the rows before, so that each
trie of segments hangs under one node of the trie before it.

*Shards.* Rows are range-partitioned by (segment, key, ids, conv_id) into shards
of about ``ROWS`` rows. A shard pads its rows to a matrix of turn ids, sorts them
by ``numpy.lexsort``, marks where a column changes and accumulates the marks by OR
from left to right: a mark in column d starts a node of depth d. ``reduceat`` over
the marks aggregates the members of all nodes of a depth.

*Boundaries.* Only nodes of a shard's first or last row, and those between two
segments, can have members elsewhere. They carry a hash of their prefix and are
recombined by it; all others are done in their shard.

*Subtrees.* A node belongs to its smallest member, and from there on so does the
rest of that member's path. Every conversation gets the sum over the nodes that
it owns; a node's subtree is then the sum over its members, less what its own
owner has above it. So a second pass over the shards gives all subtree sums,
whatever the depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, scratch, ship, stored

GROUP, HEADS = 5, 9              # conversation c starts as c - c % 5 does, for crc32(c) % 9 turns
SEGMENT = 64                     # turns in a row
ROWS = 1 << 15                   # rows in a shard, about
NUMBERED = "conv_id long, shard int, local long, id string, bytes long"
NODES = "shard int, depth long, owner long, n long, ends long, bytes long, ref binary"
PARTS = "shard int, depth long, owner long, parent long, n long, n_children long, bytes long, below long, leaves long, shared boolean, sha string, ids string"
EMPTY = hashlib.sha256(b"").hexdigest()


def _number(chunks):
    """Numbers the turns of each conversation within this shard, whose rows come in order."""
    shard, last, count = TaskContext.get().partitionId(), None, 0
    for b in chunks:
        if not b.num_rows:
            continue
        conv = b.column("conv_id").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        sizes = np.diff(np.append(starts, len(conv)))
        local = np.arange(len(conv)) - np.repeat(starts, sizes)
        if last is not None and conv[0] == last:
            local[: sizes[0]] += count
        last, count = conv[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.full(len(conv), shard, np.int32)), pa.array(local), b.column("id"), b.column("bytes")],
                                         names=["conv_id", "shard", "local", "id", "bytes"])


def _placed(conversations: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, bytes) of all turns, and (conv_id, n) of all conversations."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    turn_id = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", turn_id.alias("id"), F.octet_length("text").cast("long").alias("bytes"))
    numbered = stored(ranged.mapInArrow(_number, NUMBERED), f"{root}/numbered")
    counts = numbered.groupBy("conv_id", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv_id", "shard", "before")
    placed = numbered.join(carried, ["conv_id", "shard"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "bytes")
    return placed, counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def segments(conversations: DataFrame, segment: int, root: str) -> DataFrame:
    """(conv_id, seg, key, next, ids, bytes, last): the rebuilt conversations as rows of at most ``segment`` turns; one empty row for a turnless one."""
    placed, convs = _placed(conversations, root)
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    heads = stored(convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
                   .select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), f"{root}/heads")
    own = placed.join(heads.drop("base"), "conv_id").where("pos >= h").select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("taken")).alias("at"), "id", "bytes")
    lent = (placed.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base").join(heads, "base").where("pos < h")
            .select("conv_id", "total", F.col("pos").alias("at"), "id", "bytes"))
    turns = own.unionByName(lent).withColumn("seg", F.floor(F.col("at") / segment).cast("int"))
    grouped = turns.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("at", "id", "bytes"))).alias("t"), F.max("total").alias("total"))
    rows = grouped.select("conv_id", "seg", "total", F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), "")).alias("ids"), F.transform("t", lambda x: x["bytes"]).alias("bytes"))
    none = heads.where("total = 0").select("conv_id", F.lit(0).alias("seg"), "total", F.unhex(F.lit("")).alias("ids"), F.array().cast("array<bigint>").alias("bytes"))
    digest = F.sha2(F.concat("ids", F.col("seg").cast("string").cast("binary")), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    rows = rows.unionByName(none).withColumns({"a": part(1), "b": part(16)})
    name = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))
    short = rows.where(F.col("total") <= segment).withColumns({"key": F.lit("0:0"), "next": name(F.col("a"), F.col("b"))})
    upto = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    long = rows.where(F.col("total") > segment).withColumns({"sa": F.sum("a").over(upto), "sb": F.sum("b").over(upto)})
    long = long.withColumns({"key": name(F.col("sa") - F.col("a"), F.col("sb") - F.col("b")), "next": name(F.col("sa"), F.col("sb"))}).drop("sa", "sb")
    last = ((F.col("seg") + 1) * segment >= F.col("total")).alias("last")
    return short.unionByName(long).select("conv_id", "seg", "key", "next", "ids", "bytes", last)


class _Shard:
    """A shard's rows as sorted matrices."""

    def __init__(self, t: pa.Table, segment: int):
        self.segment, self.shard = segment, t.column("shard")[0].as_py()
        ids, lens = t.column("ids").to_pylist(), t.column("bytes").to_pylist()
        seg, key = t.column("seg").to_pylist(), t.column("key").to_pylist()
        size = np.array([len(x) // 16 for x in ids])
        width = int(size.max())
        inside = np.arange(width)[None, :] < size[:, None]
        matrix, weight = np.full((len(ids), width), -1, np.int32), np.zeros((len(ids), width), np.int64)
        if width:
            matrix[inside] = np.unique(np.frombuffer(b"".join(ids), "S16"), return_inverse=True)[1].reshape(-1)
            weight[inside] = np.concatenate([np.asarray(x, np.int64) for x in lens])
        tries = {x: i for i, x in enumerate(sorted(set(zip(seg, key))))}
        trie = np.array([tries[x] for x in zip(seg, key)])
        conv = t.column("conv_id").to_numpy()
        order = np.lexsort((conv, *matrix.T[::-1], trie))
        matrix, trie = matrix[order], trie[order]
        new = np.ones((len(ids), width + 1), bool)
        new[1:, 0] = trie[1:] != trie[:-1]
        new[1:, 1:] = matrix[1:] != matrix[:-1]
        self.starts = np.logical_or.accumulate(new, axis=1)
        self.width, self.rows, self.conv, self.size, self.weight = width, len(ids), conv[order], size[order], weight[order]
        self.last = t.column("last").to_numpy()[order]
        self.seg = np.array(seg)[order]
        self.text = [(seg[i], key[i], t.column("next")[int(i)].as_py(), ids[i]) for i in order] if self.rows else []

    def ref(self, row: int, j: int) -> bytes:
        """A hash of the prefix of j turns in this row's segment; the end of a full segment is the top of the next one."""
        seg, key, after, ids = self.text[row]
        name = f"{seg + 1}|{after}|".encode() if j == self.segment else f"{seg}|{key}|".encode() + ids[: 16 * j]
        return hashlib.sha256(name).digest()[:16]

    def depths(self):
        """For each depth j of the matrix: (j, first rows, member counts, which may have members elsewhere) of its nodes, and all marks of the column."""
        for j in range(self.width + 1):
            marks = np.flatnonzero(self.starts[:, j])
            n = np.diff(np.append(marks, self.rows))
            real = self.size[marks] >= j
            shared = (marks == 0) | (marks + n == self.rows) | (j == 0) | (j == self.segment)
            yield j, marks, n, real, shared


def _nodes(s: _Shard) -> pa.Table:
    """First pass: members of each node as far as they are in this shard."""
    out = []
    for j, marks, n, real, shared in s.depths():
        ends = np.add.reduceat((s.last & (s.size == j)).astype(np.int64), marks)
        owner = np.minimum.reduceat(s.conv, marks)
        top = (s.seg[marks] > 0) & (j == 0)           # counts as the end of the segment before
        weight = s.weight[marks, j - 1] if j else np.zeros(len(marks), np.int64)
        out.append(pa.table({
            "shard": pa.array(np.full(real.sum(), s.shard, np.int32)), "depth": pa.array((s.seg[marks].astype(np.int64) * s.segment + j)[real]),
            "owner": pa.array(owner[real], mask=top[real]), "n": pa.array(np.where(top, 0, n)[real]), "ends": pa.array(np.where(top, 0, ends)[real]),
            "bytes": pa.array(weight[real]), "ref": pa.array([s.ref(m, j) if x else None for m, x in zip(marks[real], shared[real])], pa.binary())}))
    return pa.concat_tables(out)


def _sums(s: _Shard, more: pa.Table) -> pa.Table:
    """Second pass: children, subtree sums and endings of each node as far as they are in this shard."""
    near = more.filter(pc.is_valid(more["ref"]))
    bounds = {ref: (owner, first) for ref, owner, first in zip(*(near[c].to_pylist() for c in ("ref", "owner", "first")))}
    # apart from the rows without sums, so that no id passes through a double
    sums = more.filter(pc.is_null(more["ref"])).select(["conv_id", "below", "leaves"]).to_pandas().set_index("conv_id").reindex(np.unique(s.conv), fill_value=0)
    at = np.searchsorted(sums.index.to_numpy(), s.conv)
    below, leaves = sums["below"].to_numpy()[at], sums["leaves"].to_numpy()[at]
    out, above = [], None
    levels = list(s.depths())
    owners = []
    for j, marks, n, real, shared in levels:
        owner, first = np.minimum.reduceat(s.conv, marks), np.ones(len(marks), bool)
        for i in np.flatnonzero(real & shared):
            owner[i], where = bounds[s.ref(marks[i], j)]
            first[i] = where == s.shard or j == 0
        owners.append((owner, first))
    for (j, marks, n, real, shared), (owner, _) in zip(levels, owners):
        kids = np.zeros(len(marks), np.int64)
        if j < s.width:
            below_marks, below_real, (_, begins) = levels[j + 1][1], levels[j + 1][3], owners[j + 1]
            np.add.at(kids, np.searchsorted(marks, below_marks[below_real & begins], "right") - 1, 1)
        parent = np.zeros(len(marks), np.int64)
        if j:
            up = np.searchsorted(levels[j - 1][1], marks, "right") - 1
            parent = owners[j - 1][0][up]
        top = (s.seg[marks] > 0) & (j == 0)
        done = s.last & (s.size == j)
        sha, ids = np.full(len(marks), None, object), np.full(len(marks), None, object)
        for i in np.flatnonzero(real & (np.add.reduceat(done.astype(np.int64), marks) > 0)):
            span = slice(marks[i], marks[i] + n[i])
            joined = ",".join(map(str, s.conv[span][done[span]].tolist()))
            if shared[i]:
                ids[i] = joined
            else:
                sha[i] = hashlib.sha256(joined.encode()).hexdigest()
        none = np.where(top, 0, 1)
        weight = s.weight[marks, j - 1] if j else np.zeros(len(marks), np.int64)
        columns = [np.full(len(marks), s.shard, np.int32), s.seg[marks].astype(np.int64) * s.segment + j, owner, parent, n * none, kids, weight,
                   np.add.reduceat(below, marks) * none, np.add.reduceat(leaves, marks) * none, shared]
        arrays = [pa.array(c[real]) for c in columns]
        arrays[3] = pa.array(parent[real], mask=np.full(int(real.sum()), j == 0))
        out.append(pa.Table.from_arrays([a.cast(kind) for a, (_, kind) in zip([*arrays, pa.array(sha[real], pa.string()), pa.array(ids[real], pa.string())], _PARTS)],
                                        names=[name for name, _ in _PARTS]))
    return pa.concat_tables(out)


_PARTS = [(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]]) for x in PARTS.split(", ")]


def _hash(chunks):
    """SHA-256 over the chunks of ids of each node, which come in order: nothing but the hash's state is held."""
    now, state = None, None
    for b in chunks:
        done = []
        for owner, depth, ids in zip(*(b.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
            if (owner, depth) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (owner, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hashes(done)
    if now is not None:
        yield _hashes([(*now, state.hexdigest())])


def _hashes(rows):
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["owner", "depth", "sha"]).astype({"owner": "int64", "depth": "int64", "sha": object}),
                                      schema=pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())]), preserve_index=False)


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, rows_in_shard: int = ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Defined results: turns are ordered by turn, null first, equal ones by role
    and then text; a null role or text is empty; a row with a null conv_id
    belongs to no conversation; rows that repeat are turns of their own; a
    conversation without a turn is a member of the root and ends there; an
    empty table has no conversation, so no root and no rows; other columns
    than conv_id, turn, role and text are not read.
    """
    spark: SparkSession = conversations.sparkSession
    ship(spark)
    root = scratch(spark, "prefix-trie")
    rows = stored(segments(conversations, segment, root), f"{root}/segments")
    shards = max(1, -(-rows.count() // rows_in_shard))
    sharded = stored(rows.repartitionByRange(shards, "seg", "key", "ids", "conv_id").withColumn("shard", F.spark_partition_id()), f"{root}/sharded")
    found = stored(sharded.groupBy("shard").applyInArrow(lambda t: _nodes(_Shard(t, segment)), NODES), f"{root}/found")
    bounds = stored(found.where("ref IS NOT NULL").groupBy("ref").agg(
        F.min("owner").alias("owner"), F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("bytes").alias("bytes"),
        F.min(F.when(F.col("n") > 0, F.col("shard"))).alias("first")), f"{root}/bounds")
    nodes = found.where("ref IS NULL").select("owner", "n", "ends", "bytes").unionByName(bounds.select("owner", "n", "ends", "bytes"))
    owned = nodes.groupBy("owner").agg(F.sum((F.col("n") - 1) * F.col("bytes")).alias("below"), F.count_if(F.col("n") == F.col("ends")).alias("leaves"))
    sums = sharded.select("shard", "conv_id").distinct().join(owned.withColumnRenamed("owner", "conv_id"), "conv_id")
    near = found.where("ref IS NOT NULL").select("shard", "ref").distinct().join(bounds.select("ref", "owner", "first"), "ref")
    more = stored(sums.unionByName(near, allowMissingColumns=True), f"{root}/more")
    parts = stored(sharded.groupBy("shard").cogroup(more.groupBy("shard")).applyInArrow(lambda t, known: _sums(_Shard(t, segment), known), PARTS), f"{root}/parts")
    joined = parts.where("shared").groupBy("owner", "depth").agg(
        F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in ("n", "n_children", "below", "leaves")), F.max("bytes").alias("bytes"))
    endings = parts.where("ids IS NOT NULL").select("owner", "depth", "shard", "ids").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "shard")
    joined = joined.join(endings.select("owner", "depth", "ids").mapInArrow(_hash, "owner long, depth long, sha string"), ["owner", "depth"], "left")
    whole = parts.where("NOT shared").select(*joined.columns).unionByName(joined).withColumn("part", F.floor(F.col("depth") / segment))
    # what the owner has above a node, part by part: no window holds more than a segment, or a row for each segment
    weight = (F.col("n") - 1) * F.col("bytes")
    whole = stored(whole.withColumn("above", F.sum(weight).over(Window.partitionBy("owner", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))), f"{root}/whole")
    upper = Window.partitionBy("owner").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.groupBy("owner", "part").agg(F.sum(weight).alias("w")).withColumn("earlier", F.sum("w").over(upper)).where("earlier > 0").drop("w")
    saved = F.col("below") - F.coalesce("above", F.lit(0)) - F.coalesce("earlier", F.lit(0))
    return whole.join(earlier, ["owner", "part"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


# An id that may be missing reaches pandas as a double from Spark, so it is one here, too.
SQL = """
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
own AS (
  SELECT conv_id AS c, LIST(ROW(COALESCE(role, ''), COALESCE(text, '')) ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT c, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: unicode(x)::BIGINT)),
                       lambda a, b: xor(a // 256, crc.t[(xor(a, b) % 256) + 1])), 4294967295) % 9 AS h
  FROM own, crc),
built AS (
  SELECT a.c, list_concat(COALESCE(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS path
  FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, path, len(path) AS size, UNNEST(range(0, len(path) + 1)) AS depth FROM built),
nodes AS (
  SELECT path[1:depth] AS node, depth, MIN(c) AS conv_id, COUNT(*) AS n_convs,
         COALESCE(string_agg(CASE WHEN size = depth THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends
  FROM prefixes GROUP BY path[1:depth], depth),
kids AS (SELECT node[1:depth - 1] AS node, COUNT(*) AS n FROM nodes WHERE depth > 0 GROUP BY node[1:depth - 1]),
named AS (
  SELECT n.*, COALESCE(k.n, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(n.node[depth][2]) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN kids k ON n.node = k.node),
above AS (SELECT node, depth, saved, n_children, UNNEST(range(0, depth + 1)) AS up FROM named),
sums AS (
  SELECT node[1:up] AS node, CAST(SUM(saved) AS BIGINT) AS saved_tokens, COUNT(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY node[1:up])
SELECT n.conv_id, n.depth, CAST(p.conv_id AS DOUBLE) AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM named n JOIN sums s ON n.node = s.node LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.node[1:n.depth - 1] = p.node
"""
