"""Operator 10: near-duplicates by DartMinHash signatures and banded joins.

*Weighted sets.* A text is the multiset of its runs of five words (the whole
text, if shorter). A shingle that occurs c times has weight c: its region is
made of the unit cells 1..c, and the similarity of two texts is the weighted
Jaccard similarity, the sum of the smaller weights over the sum of the larger.

*Darts.* Into every unit cell darts are thrown as a Poisson process in rank:
the n-th dart's gap to the one before, and the coordinate that it hits, are
hashes of (cell, n), so texts that share a cell share its darts. A coordinate
keeps its earliest dart; two texts agree in a coordinate with a probability
equal to their similarity. Only darts up to rank t / weight are thrown, which
is about t darts a text whatever its length, t = K (ln K + 3); should a
coordinate stay empty, the limit doubles.

*Joining.* Texts with equal word sequences are one node. Nodes that agree in
all ``ROWS`` coordinates of one of ``BANDS`` bands fall in a bucket; each node is
compared, by its whole multiset, with the bucket's leader: the node whose buckets
are the largest together, in a family of copies the one nearest to all others.
Links of at least ``SIMILARITY`` give components. Nodes of buckets that still hold several
components are left open. They are gathered in families (nodes joined by open
buckets). A family of one chunk (about ``CHUNK`` cells and ``TEXTS`` texts) is compared
in one task by products of occurrence matrices, ``TILE`` rows at a time.

*Large families.* Two texts that reach the similarity share a cell among the rarest
fifth of either's cells, in any fixed order. Cells are ordered by counters that they
share by hash, which are never below the true count. A text whose rarest fifth has
only cells of at most ``HOT`` texts is compared with the texts that share one of them,
at most ``HOT`` a cell. Texts that have commoner cells there are compared with each
other, too: cut into chunks, two at a time in one task. So a bucket of near copies
costs about one comparison a node; a family whose texts are just too unlike costs
at most ``HOT`` a cell where their differences are rare, and comparisons by the pair,
but no row for any of them, where they are made of common cells alone. No link is lost
that shares a bucket: a pair at 0.8 misses all with probability (1 - 0.8^5)^25, 1 in
20,000.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import batches, pick, scratch, ship, stored
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
CHUNK = 1 << 18                  # cells in a chunk, about
TEXTS = 4096                     # texts in a chunk, about
TILE = 1024                      # texts of a chunk that a task compares with the other chunk at a time
HOT = 64                         # texts that share a rare cell, at most
SLOTS = 1 << 21                  # counters of cells
COLUMNS = 4096                   # cells that a task multiplies at a time
K = BANDS * ROWS
DARTS = K * (np.log(K) + 3.0)
RARE = "family long, uid long, label long, size int, hot boolean, keys array<int>"
GAP, SPOT, NAME = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def cells(words: np.ndarray) -> np.ndarray:
    """A hash for each unit cell (shingle, occurrence) of a text given as word hashes; sorted."""
    if not len(words):
        return np.zeros(0, np.uint64)
    shingles = np.sort(T.grams(words, min(WORDS, len(words))))
    first = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
    nth = np.arange(len(shingles)) - np.repeat(first, np.diff(np.append(first, len(shingles))))
    with np.errstate(over="ignore"):
        return np.sort(T.mix(shingles + nth.astype(np.uint64) * NAME))


def throw(cell: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, coordinate, name) of all darts up to rank ``limit``."""
    many = 1 if limit < 2 else int(np.ceil(limit + 4 * np.sqrt(limit))) + 4
    ranks, spots, names = [], [], []
    base, nth = np.zeros(len(cell)), 0
    while len(cell):
        n = np.arange(nth + 1, nth + many + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            seed = cell[:, None] + n[None, :] * GAP
            gap = -np.log((T.mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            rank = base[:, None] + np.cumsum(gap, axis=1)
            hit = rank <= limit
            name = T.mix(seed[hit] ^ SPOT)
        ranks.append(rank[hit])
        spots.append((name >> np.uint64(33)) % np.uint64(K))
        names.append(name)
        base, nth = rank[:, -1], nth + many
        on = base <= limit
        cell, base = cell[on], base[on]
    return np.concatenate(ranks), np.concatenate(spots), np.concatenate(names)


def signature(cell: np.ndarray) -> np.ndarray:
    """The earliest dart of each coordinate, by name."""
    limit = DARTS / len(cell)
    while True:
        rank, spot, name = throw(cell, limit)
        order = np.lexsort((name, rank))[::-1]      # the last to be written is the earliest
        out, hit = np.zeros(K, np.uint64), np.zeros(K, bool)
        out[spot[order]] = name[order]
        hit[spot] = True
        if hit.all():
            return out
        limit *= 2


def bands(sig: np.ndarray) -> np.ndarray:
    return T.grams(np.concatenate([sig.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)[:, None]], axis=1).reshape(-1), ROWS + 1)[:: ROWS + 1]


def _features(chunks):
    uid = TaskContext.get().partitionId() << 36
    for b in batches(chunks):
        keys, band, cell = np.zeros((2, b.num_rows), np.int64), [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            words = T.words(t)[0]
            own = cells(words)
            if len(own):
                whole = T.grams(words, len(words)) if len(words) <= 64 else _fold(words)
                keys[:, i] = whole.view(np.int64)[0], T.mix(own.sum(keepdims=True)).view(np.int64)[0]
            band.append(bands(signature(own)).view(np.int64) if len(own) else np.zeros(0, np.int64))
            cell.append((own >> np.uint64(32)).astype(np.uint32).view(np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(np.arange(uid, uid + b.num_rows)), pa.array(keys[0]), pa.array(keys[1]),
             pa.array(band, pa.list_(pa.int64())), pa.array(cell, pa.list_(pa.int32()))],
            names=["doc_id", "text_hash", "uid", "k1", "k2", "bands", "cells"])
        uid += b.num_rows


def _fold(words: np.ndarray) -> np.ndarray:
    """A hash of a long sequence: the sum of its words' hashes, each mixed with its place."""
    with np.errstate(over="ignore"):
        return T.mix(T.mix(words + np.arange(len(words), dtype=np.uint64) * GAP).sum(keepdims=True))


def _verified(pairs: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """(a, b, sim) of the pairs (a, b), by their whole multisets. ``a`` may be shared by very many pairs: its row goes to each
    part that the engine splits the join into."""
    left = pairs.join(nodes.select(F.col("uid").alias("b"), F.col("cells").alias("cells_b")), "b")
    both = left.join(nodes.select(F.col("uid").alias("a"), F.col("cells").alias("cells_a")), "a")
    common = F.size(F.array_intersect("cells_a", "cells_b"))
    return stored(both.select("a", "b", (common / (F.size(F.array_distinct("cells_a")) + F.size(F.array_distinct("cells_b")) - common)).alias("sim")), path)


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, group_size, kept, text_hash.

    ``class_id`` is the smallest doc_id of the group; that row stays. Defined
    results: a text without a word (null and empty ones too) has no shingles
    and is a group of its own; texts of one to four words have one shingle;
    word sequences are compared without case and marks, so texts that differ
    in these alone are copies; a null doc_id sorts last and stays only in a
    group without any other; of a group's rows that share its smallest id but
    not the text, that of the smallest text hash stays; of rows that repeat an
    id and text one stays, and all carry the same ``kept``; an empty table gives
    no rows; other columns than doc_id and text are not read. Cells are told
    apart by 32 bits of their hash within a pair of texts.
    """
    spark = docs.sparkSession
    ship(spark)
    root = scratch(spark, "near-dedup")
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    id_type = dict(rows.dtypes)["doc_id"]
    rows = stored(rows.select("doc_id", "text_hash", "text").mapInArrow(
        _features, f"doc_id {id_type}, text_hash long, uid long, k1 long, k2 long, bands array<bigint>, cells array<int>"), f"{root}/rows")
    worded = rows.where(F.size("bands") > 0)
    # the row that stays: the smallest id, a null one last; of rows that share it the smallest text hash
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = stored(worded.groupBy("k1", "k2").agg(F.min("uid").alias("node"), first.alias("first"), F.count("*").alias("copies")), f"{root}/classes")
    nodes = worded.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi")
    banded = stored(nodes.select("uid", F.explode("bands").alias("band")), f"{root}/bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(banded.join(sizes, "band"), f"{root}/shared")
    members = stored(shared.select("band", "uid").join(shared.groupBy("uid").agg(F.sum("n").alias("weight")), "uid"), f"{root}/members")
    # Only nodes that share a bucket are ever compared: their multisets are set apart once.
    compared = stored(nodes.select("uid", "cells").join(members.select("uid").distinct(), "uid", "left_semi"), f"{root}/compared")
    labels = _linked(members, compared, root)
    labelled = stored(classes.join(labels.withColumnRenamed("label", "root"), "node", "left")
                      .select("k1", "k2", F.coalesce("root", "node").alias("root"), "first", "copies"), f"{root}/labelled")
    groups = labelled.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("group_size"))
    found = labelled.select("k1", "k2", "root").join(groups, "root").select("k1", "k2", F.col("first.doc_id").alias("class_id"), F.col("first.text_hash").alias("kept_hash"), "group_size")
    by_key = worded.select("doc_id", "text_hash", "k1", "k2").join(found, ["k1", "k2"]).drop("k1", "k2")
    alone = rows.where(F.size("bands") == 0).select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("text_hash").alias("kept_hash"),
                                                       F.lit(1).cast("long").alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("kept_hash"))
    return by_key.unionByName(alone).select("doc_id", "class_id", "group_size", kept.alias("kept"), "text_hash")


def _leaders(members: DataFrame) -> DataFrame:
    """(band, leader): of each bucket the node with the largest weight, of equal ones the smallest."""
    top = F.max(F.struct("weight", (-F.col("uid")).alias("uid"))).alias("top")
    return members.groupBy("band").agg(top).select("band", (-F.col("top.uid")).alias("leader"))


def _linked(members: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """(node, label) of all linked nodes."""
    led = members.join(_leaders(members), "band")
    star = stored(led.where("uid <> leader").select("band", "uid", "leader"), f"{root}/star")
    first = _verified(star.select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct(), nodes, f"{root}/verified-0")
    links = first.where(F.col("sim") >= SIMILARITY)
    labels = components(links, f"{root}/components-0")
    placed = members.join(labels.withColumnRenamed("node", "uid"), "uid", "left").select("band", "uid", "weight", F.coalesce("label", "uid").alias("label"))
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    left = stored(placed.join(mixed, "band", "left_semi"), f"{root}/open")
    if not left.limit(1).count():
        return labels
    more = _between(left, nodes, root)
    if not more.limit(1).count():
        return labels
    return components(links.select("a", "b").unionByName(more), f"{root}/components-1")


def _between(left: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """Links (a, b) between the open nodes' components, within families."""
    # a family's buckets mostly share their leader, which keeps the edges few
    joined = left.join(_leaders(left), "band").where("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b"))
    family = components(joined, f"{root}/families")
    own = left.select("uid", "label").distinct().join(family.select(F.col("node").alias("uid"), F.col("label").alias("family")), "uid")
    own = stored(own.join(nodes, "uid"), f"{root}/own")
    sizes = own.groupBy("family").agg(F.greatest(F.ceil(F.sum(F.size("cells")) / CHUNK), F.ceil(F.count("*") / TEXTS)).cast("int").alias("chunks"))
    sized = stored(own.join(sizes, "family"), f"{root}/sized")
    large = sized.where("chunks > 1")
    if not large.limit(1).count():
        return _met(sized, f"{root}/between")
    table = large.sparkSession.sparkContext.broadcast(_counts(large))
    rare = stored(large.select("family", "uid", "label", "cells").mapInArrow(_rarest(table), RARE), f"{root}/rare")
    pairs = (rare.select("family", F.struct("uid", "label", "size", "hot").alias("text"), F.explode("keys").alias("key"))
             .groupBy("family", "key").agg(F.collect_list("text").alias("texts")).where(F.size("texts") > 1).select("texts"))
    found = _verified(stored(pairs.mapInArrow(_pairs, "a long, b long").distinct(), f"{root}/pairs"), nodes, f"{root}/verified-1")
    table.unpersist()
    hot = own.join(rare.where("hot").select("uid"), "uid", "left_semi")
    again = hot.groupBy("family").agg(F.greatest(F.ceil(F.sum(F.size("cells")) / CHUNK), F.ceil(F.count("*") / TEXTS)).cast("int").alias("chunks"))
    met = _met(sized.where("chunks = 1").unionByName(hot.join(again, "family").select(*sized.columns)), f"{root}/between")
    return met.unionByName(found.where(F.col("sim") >= SIMILARITY).select("a", "b"))


def _met(sized: DataFrame, path: str) -> DataFrame:
    """Links (a, b) between components of the texts of each family, all compared."""
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = met.groupBy("family", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).agg(
        F.collect_list(F.struct("uid", "label", "chunk", "cells")).alias("texts"))
    return stored(groups.select("i", "j", "texts").mapInArrow(_meet, "a long, b long"), path)


def _counts(large: DataFrame) -> np.ndarray:
    """For each counter in how many texts its cells are. At most SLOTS rows reach the driver."""
    slots = large.select("cells").mapInArrow(_count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.ones(SLOTS, np.int64)
    out[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    return out


def _slots(cells: np.ndarray) -> np.ndarray:
    return cells.view(np.uint32) % np.uint32(SLOTS)


def _count(chunks):
    out = np.zeros(SLOTS, np.int64)
    for b in batches(chunks):
        for c in b.column("cells"):
            np.add.at(out, _slots(np.unique(np.asarray(c.values))), 1)
    at = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["slot", "n"])


def _rarest(table):
    """Of each text's rarest fifth of cells (and one more) those of at most HOT texts, and whether there are others."""
    def run(chunks):
        for b in batches(chunks):
            sizes, hots, keys = [], [], []
            for c in b.column("cells"):
                cell = np.unique(np.asarray(c.values))
                many = table.value[_slots(cell)]
                first = np.lexsort((cell, many))[: len(cell) - (4 * len(cell) + 4) // 5 + 1]
                sizes.append(len(cell))
                hots.append(bool(many[first[-1]] > HOT))
                keys.append(cell[first][many[first] <= HOT])
            yield pa.RecordBatch.from_arrays(
                [b.column("family"), b.column("uid"), b.column("label"), pa.array(sizes, pa.int32()), pa.array(hots, pa.bool_()), pa.array(keys, pa.list_(pa.int32()))],
                names=["family", "uid", "label", "size", "hot", "keys"])
    return run


def _pairs(chunks):
    """Pairs (a, b) of texts with a rare cell in common, of different components, whose sizes allow the similarity; two hot ones meet elsewhere."""
    for b in batches(chunks):
        found_a, found_b = [], []
        for texts in b.column("texts"):
            uid, label, size, hot = (np.asarray(texts.values.field(c).to_numpy(zero_copy_only=False)) for c in ("uid", "label", "size", "hot"))
            near = (5 * size[:, None].astype(np.int64) >= 4 * size[None, :]) & (5 * size[None, :].astype(np.int64) >= 4 * size[:, None])
            near &= (uid[:, None] < uid[None, :]) & (label[:, None] != label[None, :]) & ~(hot[:, None] & hot[None, :])
            x, y = np.nonzero(near)
            found_a.append(uid[x])
            found_b.append(uid[y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (found_a, found_b)], names=["a", "b"])


def _meet(chunks):
    for b in batches(chunks, 16):
        found_a, found_b = [], []
        for i, j, texts in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("texts")):
            texts = texts.values
            chunk, uid, label = (np.asarray(texts.field(c)) for c in ("chunk", "uid", "label"))
            cells = [np.unique(np.asarray(c.values)) for c in texts.field("cells")]
            rows, y = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            for x in (rows[at : at + TILE] for at in range(0, len(rows), TILE)):
                near = _alike(cells, x, y)
                near &= label[x][:, None] != label[y][None, :]
                if i == j:
                    near &= uid[x][:, None] < uid[y][None, :]
                at_x, at_y = np.nonzero(near)
                found_a.append(uid[x[at_x]])
                found_b.append(uid[y[at_y]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (found_a, found_b)], names=["a", "b"])


def _alike(cells: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of ``x`` and ``y`` reach the similarity: common cells by products of occurrence matrices."""
    owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    cell = np.concatenate(cells)
    order = np.argsort(cell, kind="stable")
    owner, cell = owner[order], cell[order]
    new = np.concatenate(([True], cell[1:] != cell[:-1]))
    place = np.cumsum(new) - 1
    several = np.bincount(place)[place] > 1                 # a cell of one text is common to none
    owner, place = owner[several], place[several]
    place = np.cumsum(np.concatenate(([False], place[1:] != place[:-1]))) if len(place) else place
    common = np.zeros((len(x), len(y)), np.float32)
    row = np.full(len(cells), -1)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + COLUMNS])
        sides = []
        for side in (x, y):
            row[:] = -1
            row[side] = np.arange(len(side))
            m = np.zeros((len(side), COLUMNS), np.float32)
            r = row[owner[lo:hi]]
            m[r[r >= 0], place[lo:hi][r >= 0] - at] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    size = np.array([len(c) for c in cells], np.float32)
    return common >= SIMILARITY * (size[x][:, None] + size[y][None, :] - common) - 1e-3


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, columns unchanged. The pipeline's form of ``near_dedup``."""
    kept = near_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    keyed = plain.withColumn("kept_id", F.col(f"c{names.index('doc_id')}")).withColumn("kept_hash", F.xxhash64(F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))))
    cond = keyed["kept_hash"].eqNullSafe(kept["kept_hash"]) & keyed["kept_id"].eqNullSafe(kept["kept_id"])
    return keyed.join(kept, cond, "left_semi").dropDuplicates(["kept_hash", "kept_id"]).drop("kept_id", "kept_hash").toDF(*names)
