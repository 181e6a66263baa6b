"""Operator 13: I-Match document fingerprints. DataFrame functions only.

*Lexicon.* A term is a run of letters, marks and digits in lower case. The
lexicon holds the terms in a band of inverse document frequency: in at least
``RAREST`` of all documents (and in two) and in at most ``COMMONEST``. Its size has
a bound that doesn't depend on the number of documents: the mean number of
distinct terms a document, over ``RAREST``. It is kept as one bit for each of
``2**BITS`` hashed places (512 KB), so looking a term up costs neither a join nor a
shuffle. A term outside the band that shares a place with one inside is kept
with it, in every document alike.

*Fingerprint.* A text's distinct terms in the lexicon are sorted. A randomised
subset of the lexicon keeps a term where its hash says so; ``SUBSETS`` disjoint
subsets keep one in 2^level terms each, and the level follows the number m of
the text's terms: 2^(level-1) < m <= 2^level, so that each subset keeps about one
of them, whatever the text's length. The text's terms in a subset are hashed
together; ``SUBSETS`` hashes of this level and as many of the next form the
fingerprint. An edit changes the hashes of the subsets that its terms are in
and leaves the others.

*Likeness.* Of two fingerprints the share of equal hashes among the subsets of
which either text has a term, at the finest level that both fingerprints have.

*Next document.* Documents are dealt into blocks by ranges of (doc_id, text
hash) in one shuffle of the texts; a block's last document finds its successor
as a guest row that the neighbouring block's first document sends along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, scratch, stored

TERM = r"[\p{L}\p{M}\p{N}]+"
RAREST, COMMONEST = 1 / 4096, 1 / 16
BITS = 22                        # places of the lexicon: 2^22 bits
SUBSETS = 32
LEAST_LEVEL = 5                  # 2^5 = SUBSETS: a text of few terms has each of them in some subset
GROUP = 64                       # bounds of blocks are searched in two steps, by groups of so many


def terms(text: Column) -> Column:
    """Sorted distinct hashes of the terms."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(runs, lambda t: F.xxhash64(t))))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return pick(docs, doc_id="doc_id", text="text").select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))


def _place(term: Column) -> Column:
    return term.bitwiseAND((1 << BITS) - 1)


def lexicon(docs: DataFrame, root: str) -> DataFrame:
    """One row (words: array<bigint>): a bit for each place, set where a term of the band is."""
    texts = _texts(docs)
    n = texts.count()
    frequency = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = frequency.where((F.col("df") >= max(2, n * RAREST)) & (F.col("df") <= max(2, n * COMMONEST)))
    at = _place(F.col("term"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = kept.groupBy(F.shiftright(at, 6).alias("id")).agg(F.bit_or(bit).alias("word"))
    # 2^16 rows whatever the corpus holds: one row of 512 KB
    spark = docs.sparkSession
    full = spark.range(1 << (BITS - 6)).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return stored(full.agg(F.sort_array(F.collect_list(F.struct("id", "word"))).alias("all")).select(F.transform("all", lambda x: x["word"]).alias("words")), f"{root}/lexicon")


def _subset(term: Column, level: Column) -> Column:
    """The subset that the term is in at this level, of 2^level that are possible; those from ``SUBSETS`` on aren't used."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
    return F.shiftrightunsigned(term, BITS).bitwiseAND(mask)


def _chosen(kept: Column, level: Column) -> Column:
    return F.filter(kept, lambda t: _subset(t, level) < SUBSETS)


def _hashes(chosen: Column, level: Column) -> Column:
    """A hash for each subset, of the terms in it; empty where there is none."""
    def one(x):
        own = F.filter(chosen, lambda t: _subset(t, level) == x)
        return F.when(F.size(own) == 0, "").otherwise(F.lpad(F.hex(F.xxhash64(own).bitwiseAND(0xFFFFFFFF)), 8, "0"))

    return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), one), ",")


def with_fingerprint(df: DataFrame, text: str, name: str, words: DataFrame) -> DataFrame:
    """``df`` with the fingerprint of its column ``text`` as column ``name``."""
    inside = lambda t: F.call_function("getbit", F.element_at("_words", (F.shiftright(_place(t), 6) + 1).cast("int")), t.bitwiseAND(63).cast("int")) == 1
    out = (df.withColumn("_words", words.scalar()).withColumn("_all", terms(F.col(text)))
           .withColumn("_band", F.filter("_all", inside)).withColumn("_kept", F.when(F.size("_band") > 0, F.col("_band")).otherwise(F.col("_all"))))
    out = out.withColumn("_level", F.greatest(F.lit(LEAST_LEVEL), F.length(F.bin((F.size("_kept") - 1).cast("long")))))
    level = F.col("_level")
    # each step a column of its own, so that it is evaluated once a text; what the next level chooses is part of what this one does
    out = out.withColumn("_fine", _chosen(F.col("_kept"), level)).withColumn("_finer", _chosen(F.col("_fine"), level + 1))
    full = F.concat_ws(":", level.cast("string"), _hashes(F.col("_fine"), level), _hashes(F.col("_finer"), level + 1))
    bare = F.when(F.col(text) == "", "").otherwise(F.concat(F.lit("x"), F.hex(F.xxhash64(F.col(text)))))
    return out.withColumn(name, F.when(F.size("_kept") > 0, full).otherwise(bare)).drop("_words", "_all", "_band", "_kept", "_level", "_fine", "_finer")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; equal fingerprints have 1, a fingerprint without terms has 0 with any other."""
    parts = [F.split(x, ":") for x in (a, b)]
    levels = [F.get(p, F.lit(0)).try_cast("int") for p in parts]
    common = F.least(*levels) + 1
    x, y = (F.split(F.get(p, 1 + common - level), ",") for p, level in zip(parts, levels))
    count = lambda test: F.size(F.filter(F.zip_with(x, y, test), lambda hit: hit))
    equal, either = count(lambda p, q: (p == q) & (p != "")), count(lambda p, q: (p != "") | (q != ""))
    near = F.when((F.abs(levels[0] - levels[1]) <= 1) & (either > 0), equal / either)
    return F.when(a == b, 1.0).otherwise(F.coalesce(near, F.lit(0.0)))


def _bounds(texts: DataFrame, root: str) -> DataFrame:
    """One row (keys: array of the largest key of each block, ascending); about as many blocks as the session has shuffle partitions."""
    spark: SparkSession = texts.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("doc_id", "h")
    dealt = texts.select("doc_id", "h").repartitionByRange(blocks, "doc_id", "h")
    ends = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("key"))
    return stored(ends.agg(F.sort_array(F.collect_list("key")).alias("keys")), f"{root}/bounds")


def with_next(texts: DataFrame, following: list[str], root: str) -> DataFrame:
    """``texts`` with next_<c> for each column c of ``following``: the next row's, by descending (doc_id, h); the last is followed by the first."""
    names = texts.columns
    keyed = texts.withColumn("_keys", _bounds(texts, root).scalar()).withColumn("_key", F.struct("doc_id", "h"))
    below = lambda keys: F.size(F.filter(keys, lambda k: k < F.col("_key")))
    coarse = F.transform(F.sequence(F.lit(1), F.floor((F.size("_keys") - 1) / GROUP).cast("int") + 1),
                         lambda i: F.element_at("_keys", F.least(i * GROUP, F.size("_keys"))))
    keyed = keyed.withColumn("_group", F.least(below(coarse), F.floor((F.size("_keys") - 1) / GROUP).cast("int")))
    keyed = keyed.withColumn("_block", F.col("_group") * GROUP + below(F.slice("_keys", F.col("_group") * GROUP + 1, F.lit(GROUP))))
    first = F.get("_keys", F.col("_block")) == F.col("_key")       # the first of its block in descending order
    own, guest = F.struct(F.col("_block").alias("block"), F.lit(False).alias("guest")), F.struct(((F.col("_block") + 1) % F.size("_keys")).alias("block"), F.lit(True).alias("guest"))
    seats = keyed.withColumn("_seat", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    rows = seats.select(*names, F.col("_seat.block").alias("_block"), F.col("_seat.guest").alias("_guest"))
    order = Window.partitionBy("_block").orderBy("_guest", F.desc("doc_id"), F.desc("h"))
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in following}).where(~F.col("_guest")).drop("_block", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Defined results: a null text counts as empty; the fingerprint of an empty
    text is empty, that of a text without any term is a hash of the text; a
    text that has terms but none in the lexicon is represented by all of them;
    documents are ordered by descending doc_id, null ids last, equal ids by a
    hash of the text; a single document follows itself; an empty table gives
    no rows; other columns than doc_id and text are not read.
    """
    root = scratch(docs.sparkSession, "fingerprints")
    words = lexicon(docs, root)
    rows = with_next(with_fingerprint(_texts(docs), "text", "fingerprint", words), ["text", "fingerprint"], root)
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", words)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
