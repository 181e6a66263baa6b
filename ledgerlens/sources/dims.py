"""Side dimensions: S02 projections, S03 fees, S04 squads, S05 short names, S06 featured courses.

In an operational deployment these are small, hand-maintained maps (a JSON
file, a config table), bound to the warehouse by name: as tables, or through
``bind_maps`` in their JSON forms, which are turned into rows on the executors.
Where none is bound, each is derived from the test tables by the FIXTURES.md
recipes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .warehouse import Warehouse


def projections(wh: Warehouse) -> DataFrame:
    """S02 (test binding): (name, month, projected)."""
    if wh.side("projections") is not None:
        return wh.side("projections")
    n = wh.base("nation")
    return n.where(F.col("n_nationkey") % 6 != 5).select(
        F.col("n_name").alias("name"), F.lit("2000-06").alias("month"),
        (2 * (F.col("n_nationkey") % 7)).alias("projected"))


def projections_from_json(docs: DataFrame, col: str = "doc") -> DataFrame:
    """Nested ``{"YYYY-MM": {tenant: n}, "_comment": "..."}`` documents -> (month, name, projected).

    Keys whose value is not an object (comments) parse to NULL and drop out;
    a missing month simply has no rows.
    """
    outer = F.from_json(F.col(col), "map<string,string>")
    months = docs.select(F.explode(outer).alias("month", "inner"))
    inner = F.from_json(F.col("inner"), "map<string,int>")
    return (months.where(inner.isNotNull())
            .select("month", F.explode(inner).alias("name", "projected")))


def fees(wh: Warehouse) -> DataFrame:
    """(name, fee) - fee per featured-course enrolment."""
    if wh.side("fees") is not None:
        return wh.side("fees")
    n = wh.base("nation")
    return n.where(F.col("n_nationkey") % 5 == 0).select(
        F.col("n_name").alias("name"), (400 + 50 * (F.col("n_nationkey") % 4)).alias("fee"))


def fees_from_map(docs: DataFrame, col: str = "doc") -> DataFrame:
    """S03 from a JSON map tenant -> fee."""
    pairs = docs.select(F.explode(F.from_json(F.col(col), "map<string,string>")).alias("name", "raw"))
    # F22, lenient conversion: fractions stay; what is no number (comments, NaN) drops out.
    return (pairs.select("name", F.expr("try_cast(raw AS DOUBLE)").alias("fee"))
            .where(F.col("fee").isNotNull() & ~F.isnan("fee")))


def squads(wh: Warehouse) -> DataFrame:
    """(squad, name)."""
    if wh.side("squads") is not None:
        return wh.side("squads")
    r = wh.base("region").select("r_regionkey", "r_name")
    n = wh.base("nation").select("n_nationkey", "n_name", "n_regionkey")
    return (n.where(F.col("n_nationkey") % 8 != 3)
            .join(r, n["n_regionkey"] == r["r_regionkey"])
            .select(F.col("r_name").alias("squad"), F.col("n_name").alias("name")))


def squads_from_map(docs: DataFrame, col: str = "doc") -> DataFrame:
    """S04 from a JSON map squad -> [tenant names]."""
    m = F.from_json(F.col(col), "map<string,array<string>>")
    return (docs.select(F.explode(m).alias("squad", "names"))
            .select("squad", F.explode("names").alias("name")))


def short_names(wh: Warehouse) -> DataFrame:
    """S05 raw map: (name, short_name) for the tenants that have one."""
    if wh.side("short_names") is not None:
        return wh.side("short_names")
    n = wh.base("nation")
    return n.where(F.col("n_nationkey") % 4 != 0).select(
        F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("short_name"))


def with_label(df: DataFrame, shorts: DataFrame, name_col: str = "name") -> DataFrame:
    """Add ``label`` = short name when one exists, else the full name."""
    s = shorts.select(F.col("name").alias("_sn_name"), F.col("short_name").alias("_sn_short"))
    return (df.join(s, df[name_col] == s["_sn_name"], "left")
            .withColumn("label", F.coalesce(F.col("_sn_short"), F.col(name_col)))
            .drop("_sn_name", "_sn_short"))


def featured_courses(wh: Warehouse) -> DataFrame:
    """The featured course names."""
    if wh.side("featured_courses") is not None:
        return wh.side("featured_courses")
    p = wh.base("part")
    return p.where(F.col("p_name").like("blue%")).select(F.col("p_name").alias("name")).distinct()



def short_names_from_map(docs: DataFrame, col: str = "doc") -> DataFrame:
    """S05 from a JSON map tenant -> short name."""
    return docs.select(F.explode(F.from_json(F.col(col), "map<string,string>")).alias("name", "short_name"))


def bind_maps(wh: Warehouse, projections: DataFrame, fees: DataFrame, squads: DataFrame, short_names: DataFrame,
              featured: DataFrame) -> Warehouse:
    """Bind the side dimensions from JSON documents (column ``doc``) and a table of featured course names (``name``)."""
    wh.bind_sides(
        projections=projections_from_json(projections), fees=fees_from_map(fees), squads=squads_from_map(squads),
        short_names=short_names_from_map(short_names), featured_courses=featured.select("name").distinct())
    return wh
