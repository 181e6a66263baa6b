"""R01 tenant_month_report and R02 enrolment_extras.

R01 is one lazy plan: the verified-tenant list left-joined with every
per-tenant metric of the month. All inputs of the chain are per-tenant
results (one row per tenant), so each join is a small hash join; the facts
are touched only inside the metrics, each behind its pushed date filter.
The three activity metrics share one bounded rollup, so ``activities`` is
scanned once for the whole report.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import Period
from ..operators.activity import month_report_activity
from ..operators.enrolment import (enrolment_pass, exemption_counts, featured_course_counts, rpl_admissions,
                                   verified_tenants)
from ..operators.leads import lead_counts, lead_workload
from ..operators.pricing import view_or_build
from ..operators.revenue_share import expected_share_revenue
from ..sources import dims
from ..sources.warehouse import Warehouse

COUNT_COLUMNS = (
    "new_enrol", "pauses", "archives",
    "new_enrol_m1", "pauses_m1", "archives_m1", "new_enrol_m1_mtd", "new_enrol_y1", "new_enrol_y1_mtd",
    "active_base", "st_till_last_month", "st_new_this_month", "st_converted_this_month", "pba_count",
    "rpl_low", "rpl_high", "featured_enrolments", "archived_30d",
)


# The stored metrics that make up the report.
STORED_PARTS = (
    "activity_counts_month", "activity_counts_prior", "completion_rates", "active_base", "conversion_admission_counts",
    "refund_window_archives", "seat_expected_revenue", "lead_counts", "exemption_counts", "featured_course_counts",
    "pricing_config", "expected_share_revenue",
)


def tenant_month_report(wh: Warehouse, p: Period, featured: DataFrame | None = None,
                        stored: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """One row per verified tenant with every metric of the month.

    ``stored`` gives a metric's stored result by name; with it the report joins
    those results and reads no fact table.
    """
    if stored is not None:
        parts = [stored(name) for name in STORED_PARTS]
        at = STORED_PARTS.index("pricing_config")
        parts[at] = parts[at].withColumn("phase_start", F.to_date("phase_start"))
        return _joined(stored("verified_tenants"), parts)
    featured = featured if featured is not None else dims.featured_courses(wh)
    # Shared inputs: one bounded activity scan (M02, M03, M14), one enrolment
    # pass (M04/5, M06, M08, M10), materialised phase / price views.
    ps = view_or_build(wh, "phase_start")
    # One consumer of the enrolment pass: a second consumer using other
    # columns would be pruned differently and re-scan the fact table.
    enrol = enrolment_pass(wh, p, ps).join(view_or_build(wh, "seat_fee_per_degree"),
                                           ["college_id", "degree_id"], "left")
    per_tenant = enrol.groupBy("college_id").agg(
        *[F.sum(c).cast("bigint").alias(c)
          for c in ("active_base", "st_converted_this_month", "pba_count", "archived_30d")],
        F.sum(F.when(F.col("seat_billable") > 0, F.col("seat_billable") * F.col("seat_fee"))).alias("seat_exp_rev"),
    )
    parts = [
        month_report_activity(wh, p),
        per_tenant,
        lead_counts(wh, p),
        exemption_counts(wh, p),
        featured_course_counts(wh, p, featured),
        view_or_build(wh, "pricing_config").withColumn("phase_start", F.to_date("phase_start")),
        expected_share_revenue(wh, p, fees=view_or_build(wh, "degree_fee_pivot")),
    ]
    return _joined(verified_tenants(wh), parts)


def _joined(tenants: DataFrame, parts: list[DataFrame]) -> DataFrame:
    df = tenants.select(F.col("id").alias("college_id"), "name", "revenue_model")
    for part in parts:
        df = df.join(part, "college_id", "left")
    df = df.fillna(0, subset=list(COUNT_COLUMNS))
    return (
        df.withColumn("active_base", F.when(F.col("revenue_model") == "SEAT_BASED", F.col("active_base")))
        .withColumn("net_additions", F.col("new_enrol") - F.col("pauses_m1") - F.col("archives_m1"))
        .withColumn("net_revsh", F.col("new_enrol") - F.col("archived_30d"))
    )


def enrolment_extras(wh: Warehouse, p: Period) -> DataFrame:
    """RPL admissions and lead workload per tenant, full outer, zero-filled."""
    return (
        rpl_admissions(wh, p).join(lead_workload(wh, p), "college_id", "full")
        .select("college_id",
                F.coalesce("rpl_admission", F.lit(0)).cast("bigint").alias("rpl_admission"),
                F.coalesce("st_wlh_count", F.lit(0)).cast("bigint").alias("st_wlh_count"))
    )


# Parameters of the fixture month (FIXTURES.md section 4).
FIXTURE_MONTH = date(2000, 6, 1)
PAST = Period(FIXTURE_MONTH, date(2000, 7, 15))
CURRENT = Period(FIXTURE_MONTH, date(2000, 6, 17))
BILLING_START = date(2000, 4, 1)
