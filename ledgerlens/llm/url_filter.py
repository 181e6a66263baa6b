"""Operator 8: URL filter by rules and link-graph propagation over hosts. DataFrame functions only.

Rules decide the urls they fit. For the rest, trust and distrust spread over
the host graph:

- a host's seed is the share of its pages that rules allow, or block;
- trust follows links: ``t(v) = (1-a) allow(v) + a * sum over u of t(u) w(u,v)``
  (personalised PageRank from the trusted seeds);
- distrust follows them backwards: ``d(u) = (1-a) block(u) + a * sum over v of
  w(u,v) d(v)`` - a host that links to blocked hosts is distrusted;

with ``w(u,v)`` the share of u's links that go to v. A host without links to
another host keeps what it has (a link to itself). A host is blocked where its
distrust reaches ``block_from`` and exceeds its trust; its pages without a rule
follow it, all others are allowed.

Pages are reduced to hosts and to (host, host) link counts before any join, so
a host with a third of all pages is one row. Each round writes its scores to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, scratch, stored

# The contract's rules: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
INLINE_RULES = 1000         # up to so many rules are an expression; more are a table to join with
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


def _host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def _path(url):
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _rule_columns(rules):
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _joined_rules(base: DataFrame, rules) -> DataFrame:
    """``base`` with (rule, verdict) of the longest rule that fits, by equality of host suffix and path prefix.

    Places are reduced to distinct (host, path) first; each gives a row for every
    suffix of its host that has rules, and prefix of its path of a length that
    these rules have: never more than its own length allows.
    """
    spark = base.sparkSession
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rules)], "n long, kind string, r_host string, r_path string")
    # as in the expression, of equally long rules the later one wins
    table = table.groupBy("r_host", "r_path").agg(F.max(F.struct("n", "kind")).alias("last")).select("r_host", "r_path", "last.n", "last.kind")
    lengths = table.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    places = base.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = (places.select("host", "path", F.explode(suffixes).alias("r_host")).join(lengths, "r_host")
             .select("host", "path", "r_host", F.explode(prefixes).alias("r_path")))
    longest = F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("size"), "n", "kind", F.concat("r_host", "r_path").alias("rule")))
    won = tried.join(table, ["r_host", "r_path"]).groupBy("host", "path").agg(longest.alias("won"))
    won = won.select("host", "path", F.col("won.rule").alias("rule"), F.col("won.kind").alias("verdict"))
    return base.join(won, ["host", "path"], "left").select(*base.columns, "rule", "verdict")


def judged(pages: DataFrame, rules, inline: int = INLINE_RULES) -> DataFrame:
    base = pick(pages, page_id="page_id", url="url", html="html").withColumns({"host": _host(F.col("url")), "path": _path(F.col("url"))})
    if len(rules) > inline:
        return _joined_rules(base, rules)
    rule, verdict = _rule_columns(rules)
    return base.withColumns({"rule": rule, "verdict": verdict})


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): the share of src's links to other hosts that go to dst."""
    links = F.regexp_extract_all(F.col("html"), F.lit(LINK), 1)
    absolute = F.filter(links, lambda x: x.rlike(r"\A(?i:[a-z][a-z0-9+.-]*:)?//"))
    target = F.transform(absolute, lambda x: F.translate(F.regexp_extract(x, r"//([^/?#]*)", 1), UPPER, LOWER))
    counts = (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(target).alias("dst"))
              .where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n")))
    out = counts.groupBy("src").agg(F.sum("n").alias("all_links"))
    return counts.join(out, "src").select("src", "dst", (F.col("n") / F.col("all_links")).alias("w"))


def propagate(hosts: DataFrame, links: DataFrame, root: str, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """(host, trust, distrust) within ``tolerance`` of the solution; an error if ``rounds`` rounds don't do.

    A round shrinks the sum of what trust is short of, and the largest that
    distrust is short of, by the damping at least, so the last move bounds the
    rest. Trust is a sum over all hosts, so its tolerance is a share of the seeds'
    mass: with very many hosts the rounding of that sum alone exceeds a fixed one.
    """
    enough = tolerance * (1 - damping) / max(damping, 1e-9)
    seeds = stored(hosts.join(links.select(F.col("src").alias("host"), F.lit(True).alias("links")).distinct(), "host", "left")
                   .select("host", "allow", "block", F.coalesce("links", F.lit(False)).alias("links")), f"{root}/seeds")
    scores = seeds.select("host", F.col("allow").alias("trust"), F.col("block").alias("distrust"))
    for k in range(rounds):
        received = (links.join(scores, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("host"))
                    .agg(F.sum(F.col("trust") * F.col("w")).alias("received")))
        reached = (links.join(scores, F.col("dst") == F.col("host")).groupBy(F.col("src").alias("host"))
                   .agg(F.sum(F.col("distrust") * F.col("w")).alias("reached")))
        before = scores.withColumnsRenamed({"trust": "trust_0", "distrust": "distrust_0"})
        own = lambda c: F.when(F.col("links"), 0.0).otherwise(F.col(c))
        after = seeds.join(before, "host").join(received, "host", "left").join(reached, "host", "left").select(
            "host",
            ((1 - damping) * F.col("allow") + damping * (F.coalesce("received", F.lit(0.0)) + own("trust_0"))).alias("trust"),
            ((1 - damping) * F.col("block") + damping * F.when(F.col("links"), F.coalesce("reached", F.lit(0.0))).otherwise(F.col("distrust_0"))).alias("distrust"),
            "trust_0", "distrust_0", "allow")
        done = stored(after, f"{root}/round-{k}")
        moved = done.agg(F.greatest(F.sum(F.abs(F.col("trust") - F.col("trust_0"))) / F.greatest(F.sum("allow"), F.lit(1.0)), F.max(F.abs(F.col("distrust") - F.col("distrust_0"))))).first()[0]
        scores = done.select("host", "trust", "distrust")
        if moved is None or moved <= enough:
            return scores
    raise RuntimeError(f"scores still move by {moved} after {rounds} rounds")


def url_filter(pages: DataFrame, rules=tuple(RULES), damping: float = 0.85, rounds: int = 1000,
               tolerance: float = 1e-6, block_from: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Defined results: a null url, or one without ``://``, has an empty host and
    path, fits no rule and is allowed; null html has no links; repeated rows
    are judged alike, each counting as a page of its host; an empty table
    gives no rows; further columns are not read.
    """
    spark = pages.sparkSession
    root = scratch(spark, "url-filter")
    base = judged(pages, rules)
    share = lambda kind: F.avg(F.when(F.col("verdict") == kind, 1.0).otherwise(0.0))
    hosts = stored(base.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")), f"{root}/hosts")
    links = stored(host_links(base), f"{root}/links")
    linked = links.select(F.col("dst").alias("host")).distinct().join(hosts.select("host"), "host", "left_anti")
    everyone = hosts.unionByName(linked.select("host", F.lit(0.0).alias("allow"), F.lit(0.0).alias("block")))
    scores = propagate(everyone, links, root, damping, rounds, tolerance)
    bad = scores.where((F.col("distrust") >= block_from) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("host_verdict"))
    return (base.drop("url", "html").join(bad, "host", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", "host_verdict", F.lit("allow")).alias("verdict")))
