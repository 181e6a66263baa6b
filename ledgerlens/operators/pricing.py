"""Contract-phase and price metrics: M06a-c, M09a-b, M16.

Phases, prices, products and services are dimensions (a handful of rows
per tenant). Joins among them are small; the only fact touched here is
``degree_students`` in M06b/c, reduced to counts by (tenant, degree, day)
before it meets the phases and fees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import day
from ..functions.periods import Period
from ..sources.warehouse import Warehouse

# Price kinds pivoted into the pricing configuration.
PRICE_KINDS = ("SEAT_OVERAGE", "AIRLOCK", "EXEMPTION", "IMPORT", "PBA", "RPL")


def _tenant_phases(wh: Warehouse) -> DataFrame:
    sp = wh.table("subscription_phases").select(
        F.col("id").alias("phase_id"), "subscription_id", "version")
    s = wh.table("subscriptions").select(F.col("id").alias("subscription_id"), "college_id")
    return sp.join(s, "subscription_id").select("college_id", "phase_id", "version")


def phase_start(wh: Warehouse) -> DataFrame:
    """Per tenant: newest phase date and, independently, the highest phase id (Q3)."""
    return _tenant_phases(wh).groupBy("college_id").agg(
        F.max("version").alias("phase_date"), F.max("phase_id").alias("phase_id"))


def latest_phase(wh: Warehouse) -> DataFrame:
    """The newest phase per tenant (ties on version broken by higher id, Q10)."""
    newest = _tenant_phases(wh).groupBy("college_id").agg(F.max(F.struct("version", "phase_id")).alias("top"))
    return newest.select("college_id", F.col("top.phase_id").alias("phase_id"), F.col("top.version").alias("phase_start"))


def _priced(wh: Warehouse) -> DataFrame:
    """prices x products x services: (phase_id, college_id, degree_id, kind, price)."""
    pr = wh.table("prices").select("phase_id", F.col("product_id"), "price")
    prd = wh.table("products").select(F.col("id").alias("product_id"), "college_id", "degree_id", "service_id")
    svc = wh.table("services").select(F.col("id").alias("service_id"), "kind")
    return pr.join(prd, "product_id").join(svc, "service_id").select(
        "phase_id", "college_id", "degree_id", "kind", "price")


def seat_fee_per_degree(wh: Warehouse, priced: DataFrame | None = None, ps: DataFrame | None = None) -> DataFrame:
    """Highest positive SEAT price per (tenant, degree) in the max-id phase."""
    ps = (ps if ps is not None else phase_start(wh)).select("phase_id")
    priced = priced if priced is not None else _priced(wh)
    return (
        priced.where((F.col("kind") == "SEAT") & (F.col("price") > 0))
        .join(ps, "phase_id")
        .groupBy("college_id", "degree_id")
        .agg(F.max("price").alias("seat_fee"))
    )


def seat_expected_revenue(wh: Warehouse, p: Period) -> DataFrame:
    """M06b (current) / M06c (past): sum of seat fees over active enrolments since phase start."""
    from .enrolment import active_filter

    ps = phase_start(wh).select("college_id", "phase_date")
    days = (wh.table("degree_students").where(active_filter(p))
            .groupBy("college_id", "degree_id", day("created").alias("created_day")).agg(F.count(F.lit(1)).alias("n")))
    fees = seat_fee_per_degree(wh)
    return (
        days.join(ps, "college_id")
        .where(F.col("created_day") >= day("phase_date"))
        .join(fees, ["college_id", "degree_id"], "left")
        .groupBy("college_id")
        .agg(F.sum(F.col("n") * F.col("seat_fee")).alias("seat_exp_rev"))
    )


def degree_fee_pivot(wh: Warehouse, priced: DataFrame | None = None, lp: DataFrame | None = None) -> DataFrame:
    """enrollment_pct and min_rev_share per (tenant, degree) in the latest phase; the tenant is the phase's, whoever's product it prices."""
    lp = (lp if lp is not None else latest_phase(wh)).select("college_id", "phase_id")
    priced = priced if priced is not None else _priced(wh)
    return (
        priced.drop("college_id").join(lp, "phase_id")
        .groupBy("college_id", "degree_id")
        .agg(
            F.max(F.when(F.col("kind") == "ENROLLMENT", F.col("price"))).alias("enrollment_pct"),
            F.max(F.when(F.col("kind") == "MIN_REV_SHARE", F.col("price"))).alias("min_rev_share"),
        )
    )


def pricing_config(wh: Warehouse, priced: DataFrame | None = None, lp: DataFrame | None = None) -> DataFrame:
    """The fee configuration of each tenant's latest phase (positive prices only)."""
    lp = (lp if lp is not None else latest_phase(wh)).select("college_id", "phase_id", "phase_start")
    priced = priced if priced is not None else _priced(wh)
    cur = priced.drop("college_id").where(F.col("price") > 0).join(lp, "phase_id")

    def kind_max(kind: str):
        return F.max(F.when(F.col("kind") == kind, F.col("price")))

    return cur.groupBy("college_id").agg(
        F.max("phase_start").alias("phase_start"),
        F.min(F.when(F.col("kind") == "SEAT", F.col("price"))).alias("seat_fee_min"),
        kind_max("SEAT").alias("seat_fee_max"),
        *[kind_max(k).alias(f"{k.lower()}_fee") for k in PRICE_KINDS],
        kind_max("ENROLLMENT").alias("enrollment_pct"),
        kind_max("MIN_REV_SHARE").alias("min_rev_share"),
    )


def dimension_views() -> dict:
    """Period-independent views over the price and phase dimensions (materialisable)."""
    def fee_pivot(wh):
        return degree_fee_pivot(wh, _view(wh, "priced"), _view(wh, "latest_phase"))

    def seat_fees(wh):
        return seat_fee_per_degree(wh, _view(wh, "priced"), _view(wh, "phase_start"))

    def pricing(wh):
        return pricing_config(wh, _view(wh, "priced"), _view(wh, "latest_phase"))

    return {
        "phase_start": phase_start,
        "latest_phase": latest_phase,
        "priced": _priced,
        "degree_fee_pivot": fee_pivot,
        "seat_fee_per_degree": seat_fees,
        "pricing_config": pricing,
    }


def _view(wh: Warehouse, name: str) -> DataFrame | None:
    return wh.view(name)


def view_or_build(wh: Warehouse, name: str) -> DataFrame:
    """The materialised view when present, else the plan that builds it."""
    v = wh.view(name)
    return v if v is not None else dimension_views()[name](wh)
