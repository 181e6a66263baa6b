"""Operator 12: spelling variants of words by PartEnum signatures of letter multisets.

*Words.* Maximal runs of Latin letters, counted over all texts; DataFrame
functions only, one row a distinct word and task before anything is shuffled.

*Vectors.* A word is the binary vector of its unit letters (letter, how many of
it came before). One replaced code point changes two units, one inserted or
deleted code point changes one, so near words have a Hamming distance of two
at equal length and of one at lengths one apart.

*PartEnum.* The units are partitioned into ``PARTS`` parts, dealt by the letters'
frequency so that every part tells about as much. Vectors at distance two agree
on all parts but two at most, at distance one on all but one. So a word has a
signature for every choice of two parts left out (for words of its own length)
and for every part left out (once as the shorter, once as the longer word). Two
near words share a signature for certain; an equi-join on signatures finds
them, and its condition verifies the pair by edit distance before any row is
made. Anagrams and other strangers that share a signature so cost a comparison,
never a row.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, scratch, ship, stored
from .text import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[A-Za-zÀ-ÿ]+"
EDITED_EVERY = 97                # a run whose hash this divides loses a code point
MIN_LENGTH, MIN_COUNT = 5, 3
FORM_RATIO = 2                   # a form is at least so many times as frequent as the word
PARTS = 6
SIGNED = "sig long, longer boolean, word string, n long"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all runs of all texts, after the edits that the rows' hashes ask for; not yet cut to common words."""
    rows = pick(docs, doc_id="doc_id", text="text").where("text IS NOT NULL")
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUNS), F.lit(0)))
    runs = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % EDITED_EVERY == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _signatures(rank: dict[str, int], same: bool):
    """Signatures of each word of an Arrow batch: for words of its own length, or for words one longer and one shorter.

    ``rank`` gives every letter's place by frequency.
    """
    place = np.zeros(1 + max(map(ord, rank), default=0), np.int64)
    for letter, r in rank.items():
        place[ord(letter)] = r
    choices = list(itertools.combinations(range(PARTS), 2))

    def run(chunks):
        for chunk in chunks:
            for at in range(0, chunk.num_rows, 4096):
                b = chunk.slice(at, 4096)
                words = b.column("word").to_pylist()
                if not words:
                    continue
                size = np.array([len(w) for w in words])
                codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
                owner = np.repeat(np.arange(len(words)), size)
                order = np.lexsort((codes, owner))
                codes, owner = codes[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1]))))
                before = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
                parts = np.zeros((len(words), PARTS), np.uint64)
                with np.errstate(over="ignore"):
                    unit = mix((codes * 4096 + before).astype(np.uint64))
                    np.add.at(parts, (owner, (place[codes] + before) % PARTS), unit)
                    whole = parts.sum(axis=1, dtype=np.uint64)
                    sigs, longer = [], []

                    def add(left, length, is_longer, name):
                        sigs.append(mix(mix(whole - left) + mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(name))))
                        longer.append(np.full(len(words), is_longer))

                    if same:
                        for name, (x, y) in enumerate(choices):
                            add(parts[:, x] + parts[:, y], size, False, name)
                    else:
                        for x in range(PARTS):
                            add(parts[:, x], size, True, x)
                            add(parts[:, x], size + 1, False, x)
                many = pa.array(np.tile(np.arange(len(words)), len(sigs)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(longer)), b.column("word").take(many), b.column("n").take(many)],
                    names=["sig", "longer", "word", "n"])
    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """Distinct (word, n, other, other_n) of all words (word, n) that differ by one code point; each pair both ways."""
    spark = words.sparkSession
    ship(spark)
    # The alphabet has 90 letters, so at most 90 rows reach the driver.
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    rank = {r["c"]: i for i, r in enumerate(r for r in letters if r["c"])}
    alike, apart = (words.select("word", "n").mapInArrow(_signatures(rank, same), SIGNED) for same in (True, False))
    side = lambda signed, x: signed.select("sig", F.col("word").alias(x), F.col("n").alias(f"{x}_n"))
    near = F.levenshtein("a", "b", 1) == 1
    # a word becomes 27 signatures, which no file statistics tell: never broadcast
    same = side(alike, "a").join(side(alike, "b").hint("merge"), "sig").where((F.col("a") < F.col("b")) & near)
    step = side(apart.where(~F.col("longer")), "a").join(side(apart.where("longer"), "b").hint("merge"), "sig").where(near)
    pairs = same.unionByName(step).select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                             F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame, root: str) -> DataFrame:
    """``forms`` (word, form) with ``root``: the end of the chain of forms. Pointers are doubled until every one is at its end.

    A form is at least twice as frequent as its word, so a chain of n steps
    needs 2^n occurrences and log2(n) rounds.
    """
    at = stored(forms.select("word", F.coalesce("form", "word").alias("root")), f"{root}/roots-0")
    k = 0
    while True:
        k += 1
        jump = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{root}/roots-{k}")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Defined results: a null text has no runs; a null doc_id stands as an empty
    id before the colon; rows that repeat count each; of near words of equal n
    the smallest in code-point order is the form; a word without any near word
    of at least twice its count has no form and is its own root; an empty table
    gives no rows; other columns than doc_id and text are not read.
    """
    root = scratch(docs.sparkSession, "variants")
    words = stored(word_counts(docs).where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LENGTH)), f"{root}/words")
    pairs = stored(near_pairs(words), f"{root}/pairs")
    top = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("top"))
    found = words.join(top, "word", "left").withColumn("top_n", -F.col("top.less"))
    is_form = F.col("top_n") >= FORM_RATIO * F.col("n")
    formed = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(is_form, F.col("top.form")).alias("form"), F.when(is_form, F.col("top_n")).alias("form_n")), f"{root}/formed")
    return formed.join(roots(formed, root), "word").select("word", "form", "root", "n", "n_near", "form_n")


# A count that may be missing reaches pandas as a double from Spark, so it is one here, too.
SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
runs AS (
  SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id,
         UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT id, run, COUNT(*) AS n FROM runs GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(
           list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
             lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
           lambda a, b: xor(a // 256, crc.t[(xor(a, b) % 256) + 1])), 4294967295) AS h
  FROM counted, crc),
words AS (
  SELECT word, CAST(SUM(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) x
  GROUP BY word HAVING SUM(n) >= 3 AND length(word) >= 5),
places AS (SELECT word, n, UNNEST(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
top AS (
  SELECT word, COUNT(*) AS n_near, FIRST(other ORDER BY other_n DESC, other) AS form, MAX(other_n) AS form_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, COALESCE(t.n_near, 0) AS n_near,
         CASE WHEN t.form_n >= 2 * w.n THEN t.form END AS form, CASE WHEN t.form_n >= 2 * w.n THEN t.form_n END AS form_n
  FROM words w LEFT JOIN top t ON w.word = t.word),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, CAST(f.form_n AS DOUBLE) AS form_n FROM formed f JOIN ends c ON f.word = c.word
"""
