"""Report pages as tables: R04-R27.

``overview_base`` extends the month report (R01) with the side dimensions
(projection, course fee, short label), the enrolment extras (R02) and the
per-row arithmetic of the pages (R06-R10). Every page is a projection of it:
a model filter, an ordering rank, and - for TOTAL rows - one aggregate.
The base has one row per tenant, so everything after R01 is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display as X
from ..functions.exprs import nonzero_or_null, positive_or_null, pyround, reliable_rate, sum_known
from ..functions.periods import Period
from ..sources import dims
from ..sources.warehouse import Warehouse
from .month_report import enrolment_extras, tenant_month_report

SEAT, SHARE = "SEAT_BASED", "REVENUE_SHARE"
# Fixed value: flat fee per RPL admission in the RPL/PBA revenue formula.
RPL_ADMISSION_FEE = 200


def overview_base(wh: Warehouse, p: Period, rpl_admissions_in_revenue: bool = False,
                  report: DataFrame | None = None) -> DataFrame:
    """Per verified tenant: R01 + projection, fee, label, R02 extras, R06-R10 columns.

    ``rpl_admissions_in_revenue`` mirrors quirk Q1: the pages pass 0 RPL
    admissions into the revenue formula; set True to price them. ``report``
    is a stored R01 to build on (see ``streaming.snapshots``).
    """
    rep = report if report is not None else tenant_month_report(wh, p)
    proj = dims.projections(wh).where(F.col("month") == p.projection_key).select("name", "projected")
    fee = dims.fees(wh).select("name", F.col("fee").alias("course_fee"))
    extras = enrolment_extras(wh, p)
    df = (rep.join(proj, "name", "left")
          .join(fee, "name", "left")
          .join(extras, "college_id", "left")
          .fillna(0, subset=["rpl_admission", "st_wlh_count"]))
    df = dims.with_label(df, dims.short_names(wh))

    cur = F.col("new_enrol")
    rate = F.col("completion_rate")
    variance, mtd_based = X.projection_variance(cur, F.col("projected"), rate)
    est, est_fallback = X.eom_estimate(cur, rate, F.col("avg_full_month"))
    proj_c = F.col("projected")
    airlock = F.col("airlock_fee")
    rpl_adm = F.col("rpl_admission") if rpl_admissions_in_revenue else F.lit(0)
    seat_rev = positive_or_null(F.col("seat_exp_rev"))
    share_rev = positive_or_null(F.col("exp_rev_usd"))

    df = df.select(
        "*",
        # MTD deltas
        (cur - F.col("new_enrol_m1_mtd")).alias("delta_m1"),
        X.change_pct(cur, F.col("new_enrol_m1_mtd")).alias("delta_m1_pct"),
        X.direction(cur - F.col("new_enrol_m1_mtd")).alias("delta_m1_dir"),
        (cur - F.col("new_enrol_y1_mtd")).alias("delta_y1"),
        X.change_pct(cur, F.col("new_enrol_y1_mtd")).alias("delta_y1_pct"),
        X.direction(cur - F.col("new_enrol_y1_mtd")).alias("delta_y1_dir"),
        # Variance against projection
        variance.alias("variance"),
        mtd_based.alias("variance_mtd_based"),
        # Month-end estimate (only with a projection)
        F.when(proj_c.isNotNull(), est).alias("eom_est"),
        F.when(proj_c.isNotNull(), est_fallback).alias("eom_est_fallback"),
        F.when(proj_c.isNotNull(), est >= proj_c).alias("eom_met"),
        F.when(proj_c > 0, pyround(est / proj_c * 100, 0).cast("bigint")).alias("eom_pct_of_proj"),
        # unconditional extrapolation used by TOTAL rows
        F.when(reliable_rate(rate), pyround(cur / rate, 0).cast("bigint")).otherwise(cur).alias("eom_enrol"),
        est.alias("eom_enrol_fallback"),
        # Revenue components
        seat_rev.alias("seat_rev"),
        share_rev.alias("share_rev"),
        (F.col("st_converted_this_month") * airlock).alias("lead_rev"),
        (F.col("rpl_low") * airlock + F.col("rpl_high") * 2 * airlock + F.col("pba_count") * airlock
         + rpl_adm * RPL_ADMISSION_FEE).alias("rpl_pba_rev"),
        (F.col("featured_enrolments") * F.col("course_fee")).cast("double").alias("course_rev"),
    )
    expected = F.when(F.col("revenue_model") == SEAT, F.col("seat_rev")).otherwise(F.col("share_rev"))
    return df.withColumn("expected_rev", expected).withColumn(
        "total_rev", sum_known(F.col("expected_rev"), F.col("lead_rev"), F.col("rpl_pba_rev"), F.col("course_rev")))


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Page order as a distributed sort (range-partitioned), not a one-task window."""
    return df.orderBy(*order)


def _o3(seat_sort_by_active: bool = True, with_new_leads: bool = True) -> list[Column]:
    order = []
    if seat_sort_by_active:
        order.append(F.coalesce(F.col("active_base"), F.lit(0)).desc())
    order += [F.col("new_enrol").desc(), F.col("st_till_last_month").desc()]
    if with_new_leads:
        order.append(F.col("st_new_this_month").desc())
    order.append(F.col("name").asc())
    return order


# ---- R04 / R05 -------------------------------------------------------------

def squad_report(wh: Warehouse, p: Period) -> DataFrame:
    """The month report per squad member, ordered by squad then O03."""
    base = tenant_month_report(wh, p)
    sq = dims.squads(wh)
    return base.join(sq, "name").orderBy(F.col("squad"), *_o3())


def lead_funnel(report: DataFrame) -> DataFrame:
    """One-row lead funnel over the given tenant rows."""
    s = report.agg(
        F.sum("st_till_last_month").cast("bigint").alias("st_till"),
        F.sum("st_new_this_month").cast("bigint").alias("st_new"),
        F.sum("st_converted_this_month").cast("bigint").alias("st_converted"),
        F.sum("new_enrol").cast("bigint").alias("enrolled"),
    )
    return s.select(
        "*",
        F.when(F.col("st_new") > 0,
               pyround(F.col("st_converted") / F.col("st_new") * 100, 1)).alias("conversion_pct"),
        F.when(F.col("st_converted") > 0,
               pyround(F.col("enrolled") / F.col("st_converted") * 100, 1)).alias("enrol_of_converted_pct"),
    )


def restrict(report: DataFrame, members: DataFrame | None, col: str = "name") -> DataFrame:
    """keep rows whose ``col`` is in ``members`` (a one-column DataFrame); None keeps all."""
    if members is None:
        return report
    return report.join(members.select(F.col(members.columns[0]).alias(col)).distinct(), col, "left_semi")


def squad_lead_funnel(wh: Warehouse, p: Period) -> DataFrame:
    """R05 for every squad page at once: the funnel of each squad's tenants."""
    rep = tenant_month_report(wh, p).join(dims.squads(wh), "name")
    s = rep.groupBy("squad").agg(
        F.sum("st_till_last_month").cast("bigint").alias("st_till"),
        F.sum("st_new_this_month").cast("bigint").alias("st_new"),
        F.sum("st_converted_this_month").cast("bigint").alias("st_converted"),
        F.sum("new_enrol").cast("bigint").alias("enrolled"),
    )
    return s.select(
        "*",
        F.when(F.col("st_new") > 0,
               pyround(F.col("st_converted") / F.col("st_new") * 100, 1)).alias("conversion_pct"),
        F.when(F.col("st_converted") > 0,
               pyround(F.col("enrolled") / F.col("st_converted") * 100, 1)).alias("enrol_of_converted_pct"),
    )


def tenant_detail(report: DataFrame, name: str) -> DataFrame:
    """the report row of one tenant by name; a missing tenant is an error when the page is read, not an empty page.

    Building the page runs nothing: the picked rows, a handful at most, pass
    through one global aggregate that raises where it finds none.
    """
    rows = report.where(F.col("name") == F.lit(name)).agg(F.collect_list(F.struct("*")).alias("rows"))
    missing = F.raise_error(F.lit(f"tenant {name!r} is not in the report"))
    return rows.select(F.inline(F.when(F.size("rows") == 0, missing).otherwise(F.col("rows"))))


# ---- R06-R11 as standalone per-tenant tables -------------------------------

def period_delta(base: DataFrame) -> DataFrame:
    """R06."""
    return base.select("college_id", "new_enrol", "new_enrol_m1_mtd", "delta_m1", "delta_m1_pct", "delta_m1_dir",
                       "new_enrol_y1_mtd", "delta_y1", "delta_y1_pct", "delta_y1_dir")


def projection_variance(base: DataFrame) -> DataFrame:
    """R07."""
    return base.select("college_id", "new_enrol", "projected", "completion_rate", "variance", "variance_mtd_based")


def eom_estimate(base: DataFrame) -> DataFrame:
    """R08."""
    return base.select("college_id", "new_enrol", "projected", "eom_est", "eom_est_fallback", "eom_met",
                       "eom_pct_of_proj")


def revenue_components(base: DataFrame) -> DataFrame:
    """R09."""
    return base.select("college_id", "revenue_model", "seat_rev", "share_rev", "lead_rev", "rpl_pba_rev",
                       "course_rev", "expected_rev")


def total_revenue(base: DataFrame) -> DataFrame:
    """R10."""
    return base.select("college_id", "total_rev")


def section_kpis(report: DataFrame) -> DataFrame:
    """Per revenue model: tenant count and sums of the section tiles."""
    return report.groupBy("revenue_model").agg(
        F.count(F.lit(1)).alias("tenants"),
        *[F.sum(c).cast("bigint").alias(c) for c in
          ("new_enrol", "pauses_m1", "archives_m1", "net_additions", "archived_30d", "net_revsh")],
    )


# ---- A16: rows and TOTAL from one pass ---------------------------------------

def rows_and_total(base: DataFrame, model: str, sums: list[Column]) -> DataFrame:
    """(is_total, row, <sums>): every tenant of ``model`` and their TOTAL, by grouping sets over one pass of ``base``.

    ``row`` is the tenant's row of ``base`` (null in the TOTAL), the sums are those
    of the tenant or of all. A page without tenants still has its TOTAL: an
    empty marker row stands in for the missing ones and is left out again.
    """
    tenants = base.where(F.col("revenue_model") == model)
    marker = base.sparkSession.range(1).select(F.lit(True).alias("_marker"))
    marked = tenants.withColumn("_marker", F.lit(False)).unionByName(marker, allowMissingColumns=True)
    key = [F.col("college_id"), F.col("_marker")]
    grouped = marked.select("*", F.struct(*base.columns).alias("row")).groupingSets([key, []], *key).agg(
        (F.grouping("college_id") == 1).alias("is_total"), F.first("row").alias("_row"), *sums)
    return grouped.where(F.col("is_total") | ~F.col("_marker")).withColumn("row", F.when(~F.col("is_total"), F.col("_row"))).drop("college_id", "_marker", "_row")


def _page(base: DataFrame, model: str, sums: list[Column], total: list[Column], columns: tuple[str, ...],
          order: list[Column]) -> DataFrame:
    """The page as it is read: the tenants' rows in order, then TOTAL, with ``columns`` and what the TOTAL has besides."""
    both = rows_and_total(base, model, sums).select("is_total", "row", F.struct(*total).alias("total"))
    names = both.schema["total"].dataType.names
    more = [c for c in names if c not in columns]

    def cell(c: str) -> Column:
        of_row = F.col(f"row.{c}") if c in columns else F.lit(None)
        of_total = F.col(f"total.{c}") if c in names else F.lit("TOTAL") if c == "name" else F.lit(None)
        return F.when(F.col("is_total"), of_total).otherwise(of_row).alias(c)

    return both.select(*(cell(c) for c in [*columns, *more]), "is_total").orderBy("is_total", *order)


# ---- R12-R14 seat-based page ----------------------------------------------

SEAT_COLUMNS = ("college_id", "name", "label", "active_base", "projected", "new_enrol", "new_enrol_m1",
                "new_enrol_y1", "delta_m1", "delta_m1_pct", "delta_m1_dir", "delta_y1", "delta_y1_pct",
                "delta_y1_dir", "variance", "variance_mtd_based", "pauses_m1", "archives_m1", "net_additions",
                "seat_fee_min", "seat_fee_max", "seat_rev", "st_till_last_month", "st_new_this_month",
                "st_converted_this_month", "lead_rev", "rpl_low", "rpl_high", "pba_count", "rpl_pba_rev",
                "featured_enrolments", "course_rev", "total_rev")


def seat_overview(base: DataFrame) -> DataFrame:
    """Seat-based tenants, ordered active -> enrolments -> leads -> name."""
    return _ranked(base.where(F.col("revenue_model") == SEAT), _o3()).select(*SEAT_COLUMNS)


def _delta_cols(cur: Column, m1: Column, y1: Column) -> list[Column]:
    return [
        (cur - m1).alias("delta_m1"), X.change_pct(cur, m1).alias("delta_m1_pct"),
        X.direction(cur - m1).alias("delta_m1_dir"),
        (cur - y1).alias("delta_y1"), X.change_pct(cur, y1).alias("delta_y1_pct"),
        X.direction(cur - y1).alias("delta_y1_dir"),
    ]


def _sumi(c: str, alias: str | None = None) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(alias or c)


def _sum_money(c: str) -> Column:
    return nonzero_or_null(F.coalesce(F.sum(c), F.lit(0.0))).alias(c)


_LEAD_SUMS = ("st_till_last_month", "st_new_this_month", "st_converted_this_month", "rpl_low", "rpl_high", "pba_count", "featured_enrolments")


def _money_page_sums(counts: tuple[str, ...], expected: str) -> list[Column]:
    """The sums of a money page's TOTAL."""
    return [
        F.coalesce(F.sum("projected"), F.lit(0)).cast("bigint").alias("proj_sum"),
        *[_sumi(c) for c in ("new_enrol", "new_enrol_m1", "new_enrol_y1", "new_enrol_m1_mtd", "new_enrol_y1_mtd", "eom_enrol", *counts)],
        *[_sum_money(c) for c in (expected, "lead_rev", "rpl_pba_rev", "course_rev", "total_rev")],
        *[_sumi(c) for c in _LEAD_SUMS],
    ]


def _money_page_total(counts: tuple[str, ...], expected: str) -> list[Column]:
    """The TOTAL's columns, from the sums: no projection, no variance where nothing is projected."""
    proj = F.col("proj_sum")
    return [
        *[F.col(c) for c in ("new_enrol", "new_enrol_m1", "new_enrol_y1", "new_enrol_m1_mtd", "new_enrol_y1_mtd", "eom_enrol", *counts, expected,
                             "lead_rev", "rpl_pba_rev", "course_rev", "total_rev", *_LEAD_SUMS)],
        F.when(proj != 0, proj).alias("projected"),
        F.when(proj != 0, F.col("eom_enrol") - proj).alias("eom_variance"),
        *_delta_cols(F.col("new_enrol"), F.col("new_enrol_m1_mtd"), F.col("new_enrol_y1_mtd")),
    ]


SEAT_TOTAL = (("active_base", "pauses_m1", "archives_m1", "net_additions"), "seat_rev")


def seat_overview_total(base: DataFrame) -> DataFrame:
    """The TOTAL row of the seat page (sums of per-row values)."""
    return rows_and_total(base, SEAT, _money_page_sums(*SEAT_TOTAL)).where("is_total").select(*_money_page_total(*SEAT_TOTAL))


def seat_page(base: DataFrame) -> DataFrame:
    """R12 and R13 from one pass: the seat page's rows in order and its TOTAL."""
    return _page(base, SEAT, _money_page_sums(*SEAT_TOTAL), _money_page_total(*SEAT_TOTAL), SEAT_COLUMNS, _o3())


def seat_eom_revenue(base: DataFrame) -> DataFrame:
    """Month-end seat revenue: seats grow by the expected remaining enrolments."""
    seat = base.where(F.col("revenue_model") == SEAT)
    ab = F.coalesce(F.col("active_base"), F.lit(0)).cast("double")
    extra = F.greatest(F.col("eom_enrol") - F.col("new_enrol"), F.lit(0))
    eom_seat = F.when((ab > 0) & F.col("seat_rev").isNotNull(),
                      (ab + extra) * (F.col("seat_rev") / ab)).otherwise(F.coalesce(F.col("seat_rev"), F.lit(0.0)))
    eom_rev = (eom_seat + F.coalesce(F.col("lead_rev"), F.lit(0.0)) + F.coalesce(F.col("rpl_pba_rev"), F.lit(0.0))
               + F.coalesce(F.col("course_rev"), F.lit(0.0)))
    t = seat.agg(F.coalesce(F.sum(eom_rev), F.lit(0.0)).alias("eom_rev"), F.coalesce(F.sum("total_rev"), F.lit(0.0)).alias("total_rev"))
    return t.withColumn("eom_delta", F.col("eom_rev") - F.col("total_rev"))


# ---- R15-R17 revenue-share page -------------------------------------------

SHARE_COLUMNS = ("college_id", "name", "label", "projected", "new_enrol", "new_enrol_m1", "new_enrol_y1",
                 "delta_m1", "delta_m1_pct", "delta_m1_dir", "delta_y1", "delta_y1_pct", "delta_y1_dir",
                 "variance", "variance_mtd_based", "archived_30d", "net_revsh", "enrollment_pct", "share_rev",
                 "share_rev_approximate", "st_till_last_month", "st_new_this_month", "st_converted_this_month",
                 "lead_rev", "rpl_low", "rpl_high", "pba_count", "rpl_pba_rev", "featured_enrolments", "course_rev",
                 "total_rev")


def _with_approximate(base: DataFrame) -> DataFrame:
    return base.withColumn("share_rev_approximate",
                           F.when(F.col("share_rev").isNotNull(), F.coalesce(F.col("est_from_min_rev"), F.lit(0)) > 0))


def share_overview(base: DataFrame) -> DataFrame:
    """Revenue-share tenants, ordered enrolments -> leads -> name."""
    share = _with_approximate(base).where(F.col("revenue_model") == SHARE)
    return _ranked(share, _o3(seat_sort_by_active=False)).select(*SHARE_COLUMNS)


SHARE_TOTAL = (("archived_30d", "net_revsh"), "share_rev")


def share_overview_total(base: DataFrame) -> DataFrame:
    """The TOTAL row of the revenue-share page."""
    return rows_and_total(base, SHARE, _money_page_sums(*SHARE_TOTAL)).where("is_total").select(*_money_page_total(*SHARE_TOTAL))


def share_page(base: DataFrame) -> DataFrame:
    """R15 and R16 from one pass: the revenue-share page's rows in order and its TOTAL."""
    return _page(_with_approximate(base), SHARE, _money_page_sums(*SHARE_TOTAL), _money_page_total(*SHARE_TOTAL), SHARE_COLUMNS,
                 _o3(seat_sort_by_active=False))


def share_eom_revenue(base: DataFrame) -> DataFrame:
    """Month-end revenue-share revenue: total / rate when the rate is reliable."""
    share = base.where((F.col("revenue_model") == SHARE) & F.col("total_rev").isNotNull()
                       & (F.col("total_rev") != 0))
    rate = F.col("completion_rate")
    eom = F.when(reliable_rate(rate), F.col("total_rev") / rate).otherwise(F.col("total_rev"))
    t = share.agg(F.coalesce(F.sum(eom), F.lit(0.0)).alias("eom_rev"),
                  F.coalesce(F.sum("total_rev"), F.lit(0.0)).alias("total_rev"))
    return t.withColumn("eom_delta", F.col("eom_rev") - F.col("total_rev"))


# ---- R18-R21 tenant drill-down ----------------------------------------------

def tenant_kpis(report: DataFrame) -> DataFrame:
    """The drill-down tiles for every tenant."""
    seat = F.col("revenue_model") == SEAT
    return report.select(
        "college_id", "name", "revenue_model", "new_enrol",
        (F.col("new_enrol") - F.col("new_enrol_m1")).alias("enrol_change_m1"),
        "pauses", "archives", "net_additions",
        F.when(seat, F.col("active_base")).otherwise(F.col("st_converted_this_month")).alias("headline"),
        F.when(seat, F.lit("active_base")).otherwise(F.lit("st_conversions")).alias("headline_kind"),
    )


def tenant_trend_net(trend: DataFrame) -> DataFrame:
    """Monthly trend with net = new - pauses - archives of the same month (Q7)."""
    return trend.withColumn("net", F.col("new_enrol") - F.col("pauses") - F.col("archives"))


def lead_conversion(report: DataFrame) -> DataFrame:
    """Per-tenant lead conversion rate and the unconverted gap."""
    new, conv = F.col("st_new_this_month"), F.col("st_converted_this_month")
    return report.select(
        "college_id", "st_till_last_month", "st_new_this_month", "st_converted_this_month",
        F.when(new > 0, pyround(conv / new * 100, 1)).alias("conversion_pct"),
        F.when((new > 0) & (conv < new), new - conv).alias("unconverted_gap"),
    )


# Growth-opportunity flags of the drill-down page.
OPPORTUNITY_FLAGS = ("unconverted_leads", "no_exemptions", "no_pba", "no_featured_courses", "no_new_enrolments")


def opportunity_flags(report: DataFrame, exploded: bool = True) -> DataFrame:
    """Growth-opportunity flags per tenant (one row per flag, or an array)."""
    conds = [
        (F.col("st_till_last_month") > 0) & (F.col("st_converted_this_month") == 0),
        (F.col("rpl_low") == 0) & (F.col("rpl_high") == 0),
        F.col("pba_count") == 0,
        (F.col("featured_enrolments") == 0) & (F.col("revenue_model") == SEAT),
        F.col("new_enrol") == 0,
    ]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in zip(conds, OPPORTUNITY_FLAGS)]))
    df = report.select("college_id", flags.alias("flags"))
    if not exploded:
        return df
    return df.select("college_id", F.explode("flags").alias("flag"))


# ---- R24-R27 enrolment pages -----------------------------------------------

ENROL_COMMON = ("college_id", "name", "label", "projected", "new_enrol", "eom_est", "eom_est_fallback", "eom_met",
                "eom_pct_of_proj", "new_enrol_m1", "delta_m1", "delta_m1_pct", "delta_m1_dir", "new_enrol_y1",
                "delta_y1", "delta_y1_pct", "delta_y1_dir", "st_till_last_month", "st_wlh_count",
                "st_new_this_month", "st_converted_this_month", "pba_count", "rpl_admission", "rpl_low",
                "rpl_high", "featured_enrolments")


def enrolment_overview_seat(base: DataFrame) -> DataFrame:
    """Seat page without money, plus workload, RPL admissions and the R08 estimate."""
    seat = base.where(F.col("revenue_model") == SEAT)
    return _ranked(seat, _o3(with_new_leads=False)).select(
        *ENROL_COMMON, "active_base", "pauses_m1", "archives_m1", "net_additions")


def enrolment_overview_share(base: DataFrame) -> DataFrame:
    """Revenue-share enrolment page."""
    share = base.where(F.col("revenue_model") == SHARE)
    return _ranked(share, _o3(seat_sort_by_active=False)).select(
        *ENROL_COMMON, "archived_30d", "net_revsh")


_ENROL_SUMS = ("new_enrol_m1", "new_enrol_m1_mtd", "new_enrol_y1", "new_enrol_y1_mtd", "st_till_last_month", "st_wlh_count", "st_new_this_month",
               "st_converted_this_month", "pba_count", "rpl_admission", "rpl_low", "rpl_high", "featured_enrolments")


def _enrol_sums(counts: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.sum("projected"), F.lit(0)).cast("bigint").alias("proj_sum"), _sumi("new_enrol"), _sumi("eom_enrol_fallback", "eom_est"),
            *[_sumi(c) for c in (*_ENROL_SUMS, *counts)]]


def _enrol_total(counts: tuple[str, ...]) -> list[Column]:
    """The TOTAL's columns of an enrolment page; the estimate falls back to the average full month (Q8)."""
    proj = F.col("proj_sum")
    return [
        *[F.col(c) for c in ("new_enrol", "eom_est", *_ENROL_SUMS, *counts)],
        F.when(proj != 0, proj).alias("projected"),
        F.when(proj != 0, F.col("eom_est") >= proj).alias("eom_met"),
        F.when(proj != 0, pyround(F.col("eom_est") / proj * 100, 0).cast("bigint")).alias("eom_pct_of_proj"),
        *_delta_cols(F.col("new_enrol"), F.col("new_enrol_m1_mtd"), F.col("new_enrol_y1_mtd")),
    ]


ENROL_SEAT, ENROL_SHARE = ("active_base", "pauses_m1", "archives_m1", "net_additions"), ("archived_30d", "net_revsh")


def enrolment_overview_seat_total(base: DataFrame) -> DataFrame:
    """R25."""
    return rows_and_total(base, SEAT, _enrol_sums(ENROL_SEAT)).where("is_total").select(*_enrol_total(ENROL_SEAT))


def enrolment_overview_share_total(base: DataFrame) -> DataFrame:
    """R27."""
    return rows_and_total(base, SHARE, _enrol_sums(ENROL_SHARE)).where("is_total").select(*_enrol_total(ENROL_SHARE))


def enrolment_page_seat(base: DataFrame) -> DataFrame:
    """R24 and R25 from one pass."""
    return _page(base, SEAT, _enrol_sums(ENROL_SEAT), _enrol_total(ENROL_SEAT), ENROL_COMMON + ENROL_SEAT, _o3(with_new_leads=False))


def enrolment_page_share(base: DataFrame) -> DataFrame:
    """R26 and R27 from one pass."""
    return _page(base, SHARE, _enrol_sums(ENROL_SHARE), _enrol_total(ENROL_SHARE), ENROL_COMMON + ENROL_SHARE, _o3(seat_sort_by_active=False))


# ---- R28 display columns -------------------------------------------------------

def display_columns(base: DataFrame) -> DataFrame:
    """The text renderings next to the numbers."""
    approx = F.coalesce(F.col("est_from_min_rev"), F.lit(0)) > 0
    expected_text = F.when(F.col("revenue_model") == SEAT, X.money_text(F.col("expected_rev"))).otherwise(
        X.approx_prefix(X.money_text(F.col("expected_rev")), approx))
    return base.select(
        "college_id",
        X.fee_text(F.col("seat_fee_min"), F.col("seat_fee_max")).alias("seat_fee_text"),
        X.percent_text(F.col("enrollment_pct")).alias("enrollment_pct_text"),
        expected_text.alias("expected_rev_text"),
        X.money_text(F.col("total_rev")).alias("total_rev_text"),
        X.change_text(F.col("new_enrol"), F.col("new_enrol_m1_mtd")).alias("vs_m1_text"),
        X.change_text(F.col("new_enrol"), F.col("new_enrol_y1_mtd")).alias("vs_y1_text"),
        X.variance_text(F.col("variance"), F.col("variance_mtd_based")).alias("variance_text"),
    )


# ---- R22-R23 revenue overview (invoice-sourced) ---------------------------------

HEADS = ("saas_fee", "seat_fee", "growth", "additional_items", "monthly_invoice_total", "total_cv")


def revenue_overview(wh: Warehouse, billing_started) -> DataFrame:
    """Verified tenants with their invoice heads; unknown when no invoice or zero."""
    from ..operators.enrolment import verified_tenants
    from ..operators.invoices import invoice_breakdown

    tenants = verified_tenants(wh).select(F.col("id").alias("college_id"), "name", "revenue_model")
    df = tenants.join(invoice_breakdown(wh, billing_started), "college_id", "left")
    has = F.col("invoice_name").isNotNull()
    return df.select(
        "college_id", "name", "revenue_model", "invoice_name", has.alias("has_invoice"),
        F.when(has, F.col("quarterly_status")).alias("quarterly_status"),
        F.when(has, F.col("invoice_status")).alias("invoice_status"),
        *[F.when(has & (F.col(h) != 0), F.col(h)).alias(h) for h in HEADS],
    ).orderBy("revenue_model", "name")


def revenue_overview_total(rows: DataFrame) -> DataFrame:
    """Per revenue model: rows, rows with an invoice, sums of the six heads (zero -> unknown)."""
    return rows.groupBy("revenue_model").agg(
        F.count(F.lit(1)).alias("tenants"),
        F.count("invoice_name").alias("with_invoice"),
        *[nonzero_or_null(F.coalesce(F.sum(h), F.lit(0.0))).alias(h) for h in HEADS],
    )


def revenue_page(wh: Warehouse, billing_started) -> DataFrame:
    """R22 and R23 from one pass over the invoices: each revenue model's rows, then its totals."""
    rows = revenue_overview(wh, billing_started)
    row = F.struct(*rows.columns)
    both = rows.select("*", row.alias("row")).groupingSets([["revenue_model", "college_id"], ["revenue_model"]], "revenue_model", "college_id").agg(
        (F.grouping("college_id") == 1).alias("is_total"), F.first("row").alias("row"), F.count(F.lit(1)).alias("tenants"), F.count("invoice_name").alias("with_invoice"),
        *[nonzero_or_null(F.coalesce(F.sum(h), F.lit(0.0))).alias(f"sum_{h}") for h in HEADS])
    total = F.col("is_total")
    cells = [F.when(~total, F.col(f"row.{c}")).alias(c) for c in ("college_id", "invoice_name", "has_invoice", "quarterly_status", "invoice_status")]
    return both.select(
        "revenue_model", F.when(total, F.lit("TOTAL")).otherwise(F.col("row.name")).alias("name"), *cells,
        *[F.when(total, F.col(f"sum_{h}")).otherwise(F.col(f"row.{h}")).alias(h) for h in HEADS],
        F.when(total, F.col("tenants")).alias("tenants"), F.when(total, F.col("with_invoice")).alias("with_invoice"), "is_total",
    ).orderBy("revenue_model", "is_total", "name")
