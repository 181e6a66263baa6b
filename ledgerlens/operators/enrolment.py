"""Enrolment-table metrics: M01, M04, M05, M08, M10, M11, M12, M15, M19, M20.

Each is one pass over a fact table with pushed date filters, an optional
join to a per-tenant dimension (broadcast by AQE after its size is
measured) and a per-tenant aggregate with a map-side partial step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import active_on, count_if, day, is_true, on_or_between, safe_div, sqlround, unbounded_if_null
from ..functions.periods import Period
from ..sources.warehouse import Warehouse
from .pricing import phase_start

# Enrolment states that count as currently active.
ACTIVE_STATUSES = ("ACTIVE", "PENDING", "SUBMITTED")


def verified_tenants(wh: Warehouse) -> DataFrame:
    """Verified tenants, seat-based first, then by name."""
    return (
        wh.table("orgs").where(F.col("status") == "VERIFIED")
        .select("id", "name", "revenue_model")
        .orderBy(F.col("revenue_model").desc(), F.col("name"))
    )


def active_filter(p: Period):
    """Current month: live status. Past month: point-in-time state at month end."""
    if p.is_current:
        return F.col("status").isin(*ACTIVE_STATUSES)
    return active_on(p.last)


def active_base(wh: Warehouse, p: Period) -> DataFrame:
    """M04 (current month) / M05 (past month): active enrolments since the latest phase start.

    The phase rule looks at days, so enrolments are first counted by (tenant,
    day): what meets the phases is a row a day, not the fact table.
    """
    days = (wh.table("degree_students").where(active_filter(p))
            .groupBy("college_id", day("created").alias("created_day")).agg(F.count(F.lit(1)).alias("n")))
    ps = phase_start(wh).select("college_id", "phase_date")
    return (
        days.join(ps, "college_id", "left")
        .where(unbounded_if_null(day("phase_date"), F.col("created_day")))
        .groupBy("college_id")
        .agg(F.sum("n").cast("bigint").alias("active_base"))
    )


def enrolment_pass(wh: Warehouse, p: Period, ps: DataFrame | None = None) -> DataFrame:
    """One scan of ``degree_students`` feeding M04/M05, M06, M08 and M10.

    Enrolments are reduced to counts by (tenant, degree, created day) by a
    map-side partial aggregate, and only these meet the phase start, so a hot
    tenant costs no more shuffle than a cold one.
    """
    ps = (ps if ps is not None else phase_start(wh)).select("college_id", "phase_date")
    ds = wh.table("degree_students").select(
        "college_id", "degree_id", "status", "created", "pause_started", "pause_ended", "delisted_timestamp",
        "has_activity_before_invitation", "is_pba_converted")
    active = active_filter(p)
    in_month = on_or_between("created", p.first, p.last)
    days = ds.groupBy("college_id", "degree_id", day("created").alias("created_day")).agg(
        count_if(active).alias("active"),
        count_if(in_month & is_true("has_activity_before_invitation")).alias("st_converted_this_month"),
        count_if(is_true("is_pba_converted") & in_month).alias("pba_count"),
        count_if((F.col("status") == "ARCHIVED") & on_or_between("created", p.refund_window_first, p.last))
        .alias("archived_30d"),
    )
    has_phase = F.col("phase_date").isNotNull()
    since_phase = F.col("created_day") >= day("phase_date")

    def total(counts):
        return F.coalesce(F.sum(counts), F.lit(0)).cast("bigint")

    return days.join(ps, "college_id", "left").groupBy("college_id", "degree_id").agg(
        total(F.when(~has_phase | since_phase, F.col("active"))).alias("active_base"),
        total(F.when(has_phase & since_phase, F.col("active"))).alias("seat_billable"),
        *[total(F.col(c)).alias(c) for c in ("st_converted_this_month", "pba_count", "archived_30d")],
    )


def conversion_admission_counts(wh: Warehouse, p: Period) -> DataFrame:
    """st_converted_this_month and pba_count; every tenant with an enrolment appears."""
    ds = wh.table("degree_students")
    in_month = on_or_between("created", p.first, p.last)
    return ds.groupBy("college_id").agg(
        count_if(in_month & is_true("has_activity_before_invitation")).alias("st_converted_this_month"),
        count_if(is_true("is_pba_converted") & in_month).alias("pba_count"),
    )


def refund_window_archives(wh: Warehouse, p: Period) -> DataFrame:
    """Archived enrolments created in the 31 days ending on the month's last day."""
    ds = wh.slice("degree_students", p.refund_window_first, p.last)
    return (
        ds.where(F.col("status") == "ARCHIVED")
        .groupBy("college_id")
        .agg(F.count(F.lit(1)).alias("archived_30d"))
    )


def exemption_counts(wh: Warehouse, p: Period) -> DataFrame:
    """Approved exemption requests processed in the month, split at 20 credits."""
    r = wh.slice("rpl_exemption_requests", p.first, p.last).where(
        F.col("status") == "APPROVED"
    ).select("degree_student_id", "approved_credits")
    ds = wh.table("degree_students").select(F.col("id").alias("degree_student_id"), "college_id")
    return (
        r.join(ds, "degree_student_id")
        .groupBy("college_id")
        .agg(
            count_if(F.col("approved_credits") < 20).alias("rpl_low"),
            count_if(F.col("approved_credits") >= 20).alias("rpl_high"),
        )
    )


def rpl_admissions(wh: Warehouse, p: Period) -> DataFrame:
    """Enrolments of the month with an RPL service row (counts service rows)."""
    ds = wh.slice("degree_students", p.first, p.last).select(
        F.col("id").alias("degree_student_id"), "college_id")
    dss = wh.table("degree_student_services").where(F.col("rpl").isNotNull()).select("degree_student_id")
    return ds.join(dss, "degree_student_id").groupBy("college_id").agg(F.count(F.lit(1)).alias("rpl_admission"))


def featured_course_counts(wh: Warehouse, p: Period, featured: DataFrame) -> DataFrame:
    """Course enrolments of the month in the featured course list, per tenant.

    ``featured`` is a one-column (name) DataFrame; it is applied as a semi
    join, so the list is never collected to the driver.
    """
    courses = wh.table("courses").join(featured.select("name").distinct(), "name", "left_semi")
    acs = wh.slice("ams_course_students", p.first, p.last)
    return (
        acs.join(courses.select(F.col("id").alias("course_id"), "college_id"), "course_id")
        .groupBy("college_id")
        .agg(F.count(F.lit(1)).alias("featured_enrolments"))
    )


def graduation_summary(wh: Warehouse) -> DataFrame:
    """M19 for every tenant: total_graduates, total_enrolled, grad_rate_pct."""
    ds = wh.table("degree_students")
    g = count_if(F.col("status") == "COMPLETED")
    return ds.groupBy("college_id").agg(
        g.alias("total_graduates"),
        F.count(F.lit(1)).alias("total_enrolled"),
        sqlround(safe_div(g, F.count(F.lit(1))) * 100, 1).alias("grad_rate_pct"),
    )


def graduation_trend(wh: Warehouse) -> DataFrame:
    """Graduates by month of enrolment, all time, per tenant."""
    ds = wh.table("degree_students")
    return (
        ds.where(F.col("status") == "COMPLETED")
        .groupBy("college_id", F.date_format(day("created"), "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("graduates"))
        .orderBy("college_id", "month")
    )
