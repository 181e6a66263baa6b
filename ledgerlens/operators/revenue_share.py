"""Expected revenue of revenue-share tenants: M09c, M09d, M09e, M09.

Per new enrolment of the month the estimate falls through four sources:
P1 the degree's average actual share over the last three months, P2 the
contract formula max(pct x USD tuition, floor), P3 the tenant's all-time
average actual share, P4 the floor. Purchases are the only large input. Both
averages compare every purchase with a floor, so the floors have to reach the
rows: a tenant's floors travel as one small row, copied to every salt, and the
purchases are dealt by (tenant, salt), so a tenant with most of the rows is
spread over ``SALTS`` tasks. One pass reduces them to mergeable sums and counts
for each (tenant, degree) before anything else is joined.

Money is exact from the tuition on: tuition, the contract formula, each
enrolment's amount, their sum and its rounding are ``decimal(38,9)``; so cents
neither get lost nor decide on which side of a half a sum falls. Averages of
recorded shares have the type of the bound ``rev_share`` and enter the sum with
nine decimals.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, distinct_from, midnight, money, money_times, sqlround, strict_greatest
from ..functions.periods import Period
from ..sources.warehouse import PARTITIONED, Warehouse
from .pricing import degree_fee_pivot


SALTS = 32


def _tenant_floors(fees: DataFrame) -> DataFrame:
    """One row per tenant: its lowest floor, and each degree's floor (0 where the degree has fees but no floor)."""
    floor = F.coalesce(F.col("min_rev_share"), F.lit(0.0))
    return fees.groupBy("college_id").agg(
        F.min("min_rev_share").alias("tenant_floor"),
        F.map_from_entries(F.collect_list(F.struct(F.col("degree_id").alias("key"), floor.alias("value")))).alias("floors"))


def share_sums(wh: Warehouse, since: date, fees: DataFrame | None = None, all_time: bool = True,
               salts: int = SALTS) -> DataFrame:
    """(college_id, degree_id, recent, n_recent, ever, n_ever): sums and counts of the purchases' shares, each at least at its floor.

    ``recent``: purchases since ``since`` of degrees that have fees, at the
    degree's floor; ``ever``: all purchases, at the tenant's lowest floor.
    Sums and counts merge, so averages of any coarser key follow without a
    second pass. Without ``all_time`` only the recent months are scanned.
    """
    fees = fees if fees is not None else degree_fee_pivot(wh)
    rows = wh.table("purchases") if all_time else wh.slice("purchases", since)
    rows = rows.where(distinct_from("category", "STUDYTRACK") & F.col("rev_share").isNotNull()).select(
        "college_id", "degree_id", "rev_share", (F.col(PARTITIONED["purchases"]) >= midnight(since)).alias("is_recent"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    copies = _tenant_floors(fees).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    share, known = F.col("rev_share"), F.coalesce(F.map_contains_key("floors", F.col("degree_id")), F.lit(False))
    recent = F.when(F.col("is_recent") & F.col("degree_id").isNotNull() & known, F.greatest(share, F.try_element_at("floors", F.col("degree_id"))))
    ever = F.greatest(share, F.coalesce("tenant_floor", F.lit(0.0)))
    return (rows.join(copies, ["college_id", "salt"], "left")
            .groupBy("college_id", "degree_id")
            .agg(F.sum(recent).alias("recent"), F.count(recent).alias("n_recent"), F.sum(ever).alias("ever"), F.count(ever).alias("n_ever")))


def avg_share_per_degree_3m(wh: Warehouse, p: Period, fees: DataFrame | None = None) -> DataFrame:
    """Avg of max(rev_share, floor) per degree since the first of month - 2 (no upper bound)."""
    sums = share_sums(wh, p.three_months_ago, fees, all_time=False)
    return sums.where("n_recent > 0").select("college_id", "degree_id", (F.col("recent") / F.col("n_recent")).alias("avg_rev_share"))


def avg_share_per_tenant(wh: Warehouse, fees: DataFrame | None = None) -> DataFrame:
    """M09d: all-time avg of max(rev_share, lowest floor of the tenant or 0)."""
    sums = share_sums(wh, date.max, fees)
    return sums.groupBy("college_id").agg((F.sum("ever") / F.sum("n_ever")).alias("avg_rev_share"))


def tenant_shares(sums: DataFrame) -> DataFrame:
    """M09c and M09d of one pass: per tenant its average and, as a map, its degrees' recent averages."""
    recent = F.when(F.col("n_recent") > 0, F.struct(F.col("degree_id").alias("key"), (F.col("recent") / F.col("n_recent")).alias("value")))
    return sums.groupBy("college_id").agg((F.sum("ever") / F.sum("n_ever")).alias("tenant_avg"),
                                          F.map_from_entries(F.collect_list(recent)).alias("degree_avgs"))


def new_enrolment_tuition(wh: Warehouse, p: Period) -> DataFrame:
    """M09e: enrolments of the month with their USD tuition (override, else USD list price), exact."""
    ds = wh.slice("degree_students", p.first, p.last).select(
        F.col("id").alias("degree_student_id"), "college_id", "degree_id")
    d = wh.table("degrees").select(F.col("id").alias("degree_id"), "currency", "tuition_cost")
    ipo = wh.table("invoice_purchase_overrides").where(
        (F.col("service_kind") == "ENROLLMENT") & F.col("tuition_due").isNotNull() & (F.col("tuition_due") > 0)
    ).select("degree_student_id", "tuition_due")
    # The overrides span all history; keep only those of this month's
    # enrolments first. A semi join may broadcast its (small, measured) id
    # side, so the large table is filtered map-side instead of being shuffled
    # for the outer join below.
    ipo = ipo.join(ds.select("degree_student_id"), "degree_student_id", "left_semi")
    return (
        ds.join(d, "degree_id", "left")
        .join(ipo, "degree_student_id", "left")
        .select(
            "degree_student_id", "college_id", "degree_id",
            F.coalesce(money("tuition_due"), F.when(F.col("currency") == "USD", money("tuition_cost"))).alias("tuition_usd"),
        )
    )


def share_branch(tuition, deg_avg, tenant_avg):
    """Which waterfall branch applies: 1..4."""
    return (F.when(deg_avg.isNotNull(), 1)
            .when(tuition.isNotNull(), 2)
            .when(tenant_avg.isNotNull(), 3)
            .otherwise(4))


def expected_share_revenue(wh: Warehouse, p: Period, with_rows: bool = False,
                           fees: DataFrame | None = None) -> DataFrame:
    """exp_rev_usd = ROUND(SUM(waterfall), 0) and est_from_min_rev per tenant.

    With ``with_rows`` the per-enrolment rows (value and branch) are returned
    instead, which the tests use to check the branch counts.
    """
    fees = fees if fees is not None else degree_fee_pivot(wh)
    ne = new_enrolment_tuition(wh, p)
    shares = tenant_shares(share_sums(wh, p.three_months_ago, fees))
    j = (ne.join(fees, ["college_id", "degree_id"], "left").join(shares, "college_id", "left")
         .withColumn("deg_avg", F.when(F.col("degree_id").isNotNull(), F.try_element_at("degree_avgs", F.col("degree_id")))))
    floor0 = money(F.coalesce(F.col("min_rev_share"), F.lit(0.0)))
    value = (
        F.when(F.col("deg_avg").isNotNull(), money("deg_avg"))
        .when(F.col("tuition_usd").isNotNull(),
              strict_greatest(money_times(F.col("enrollment_pct"), F.col("tuition_usd")), floor0))
        .when(F.col("tenant_avg").isNotNull(), money("tenant_avg"))
        .otherwise(floor0)
    )
    floor_only = F.col("deg_avg").isNull() & F.col("tuition_usd").isNull() & F.col("tenant_avg").isNull()
    if with_rows:
        return j.select(
            "degree_student_id", "college_id", "degree_id", value.alias("value"),
            share_branch(F.col("tuition_usd"), F.col("deg_avg"), F.col("tenant_avg")).alias("branch"))
    return j.groupBy("college_id").agg(
        sqlround(F.sum(value), 0).cast("double").alias("exp_rev_usd"),        # whole dollars: exact as a double, too
        count_if(floor_only).alias("est_from_min_rev"),
    )
