"""

Parameters are those of the fixture month (FIXTURES.md section 4): month
2000-06, a past-month run as of 2000-07-15 and a current-month run as of
2000-06-17, invoices of the billing period starting 2000-04-01.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.periods import Period
from ..operators import activity as act
from ..operators import enrolment as enr
from ..operators import invoices as inv
from ..operators import leads as lds
from ..operators import pricing as prc
from ..operators import revenue_share as rsh
from ..sources import dims
from .registry import Entry

MONTH = date(2000, 6, 1)
PAST = Period(MONTH, date(2000, 7, 15))
CURRENT = Period(MONTH, date(2000, 6, 17))
PERIODS = {"past": PAST, "current": CURRENT}
BILLING_START = date(2000, 4, 1)


def _q(name: str, **kw) -> dict:
    """Oracle pieces for a metric registered under q_<name>."""
    return dict(sql_final=f"SELECT * FROM q_{name}", sql_deps=(f"q_{name}",), **kw)


def _rates(wh, p):
    return act.mtd_rates(act.monthly_mtd_history(wh, p))


ENTRIES: dict[str, Entry] = {
    # ---- 2.11 metric operators ----------------------------------------
    "verified_tenants": Entry(lambda wh: enr.verified_tenants(wh), **_q("verified_tenants")),
    "activity_counts_month": Entry(lambda wh: act.activity_counts_month(wh, PAST), **_q("activity_counts_month")),
    "activity_counts_prior": Entry(lambda wh: act.activity_counts_prior(wh, PAST), **_q("activity_counts_prior")),
    "activity_counts_prior_current": Entry(lambda wh: act.activity_counts_prior(wh, CURRENT),
                                           **_q("activity_counts_prior", period="current")),
    "active_base_current": Entry(lambda wh: enr.active_base(wh, CURRENT), **_q("active_base", period="current")),
    "active_base_asof": Entry(lambda wh: enr.active_base(wh, PAST), **_q("active_base")),
    "seat_fee_per_degree": Entry(lambda wh: prc.seat_fee_per_degree(wh), **_q("seat_fee_per_degree", doubles=("seat_fee",))),
    "seat_expected_revenue_current": Entry(lambda wh: prc.seat_expected_revenue(wh, CURRENT),
                                           **_q("seat_expected_revenue", doubles=("seat_exp_rev",), period="current")),
    "seat_expected_revenue_asof": Entry(lambda wh: prc.seat_expected_revenue(wh, PAST),
                                        **_q("seat_expected_revenue", doubles=("seat_exp_rev",))),
    "lead_counts": Entry(lambda wh: lds.lead_counts(wh, PAST), **_q("lead_counts")),
    "conversion_admission_counts": Entry(lambda wh: enr.conversion_admission_counts(wh, PAST),
                                         **_q("conversion_admission_counts")),
    "latest_phase": Entry(lambda wh: prc.latest_phase(wh).withColumn("phase_start", F.to_date("phase_start")),
                          sql_final="SELECT college_id, phase_id, CAST(phase_start AS DATE) AS phase_start "
                                    "FROM newest_phase",
                          sql_deps=("newest_phase",), dates=("phase_start",)),
    "degree_fee_pivot": Entry(lambda wh: prc.degree_fee_pivot(wh),
                              **_q("degree_fee_pivot", doubles=("enrollment_pct", "min_rev_share"))),
    "avg_share_per_degree_3m": Entry(lambda wh: rsh.avg_share_per_degree_3m(wh, PAST),
                                     **_q("avg_share_per_degree_3m", doubles=("avg_rev_share",))),
    "avg_share_per_tenant": Entry(lambda wh: rsh.avg_share_per_tenant(wh),
                                  **_q("avg_share_per_tenant", doubles=("avg_rev_share",))),
    "new_enrolment_tuition": Entry(lambda wh: rsh.new_enrolment_tuition(wh, PAST),
                                   **_q("new_enrolment_tuition", doubles=("tuition_usd",))),
    "expected_share_revenue": Entry(lambda wh: rsh.expected_share_revenue(wh, PAST),
                                    **_q("expected_share_revenue", doubles=("exp_rev_usd",))),
    "refund_window_archives": Entry(lambda wh: enr.refund_window_archives(wh, PAST), **_q("refund_window_archives")),
    "exemption_counts": Entry(lambda wh: enr.exemption_counts(wh, PAST), **_q("exemption_counts")),
    "rpl_admissions": Entry(lambda wh: enr.rpl_admissions(wh, PAST), **_q("rpl_admissions")),
    "lead_workload": Entry(lambda wh: lds.lead_workload(wh, PAST), **_q("lead_workload")),
    "monthly_mtd_history": Entry(lambda wh: act.monthly_mtd_history(wh, PAST), **_q("monthly_mtd_history", dates=("mo",))),
    "mtd_rates": Entry(lambda wh: _rates(wh, PAST), **_q("mtd_rates", doubles=("rate",), dates=("mo",))),
    "momentum_last4": Entry(lambda wh: act.momentum_last4(_rates(wh, PAST)),
                            **_q("momentum_last4", doubles=("momentum_rate", "avg_full_month"))),
    "seasonal_factor": Entry(lambda wh: act.seasonal_factor(_rates(wh, PAST), PAST),
                             **_q("seasonal_factor", doubles=("y1_rate", "y1_prev_rate"))),
    "completion_rates": Entry(lambda wh: act.completion_rates(wh, PAST),
                              **_q("completion_rates", doubles=("completion_rate", "avg_full_month"))),
    "completion_rates_current": Entry(lambda wh: act.completion_rates(wh, CURRENT),
                                      **_q("completion_rates", doubles=("completion_rate", "avg_full_month"),
                                           period="current")),
    "featured_course_counts": Entry(lambda wh: enr.featured_course_counts(wh, PAST, dims.featured_courses(wh)),
                                    **_q("featured_course_counts")),
    "pricing_config": Entry(lambda wh: prc.pricing_config(wh).withColumn("phase_start", F.to_date("phase_start")),
                            **_q("pricing_config", dates=("phase_start",),
                                 doubles=("seat_fee_min", "seat_fee_max", "seat_overage_fee", "airlock_fee",
                                          "exemption_fee", "import_fee", "pba_fee", "rpl_fee", "enrollment_pct",
                                          "min_rev_share"))),
    "tenant_trend": Entry(lambda wh: act.tenant_trend(wh, PAST), **_q("tenant_trend")),
    "lead_trend": Entry(lambda wh: lds.lead_trend(wh, PAST), **_q("lead_trend")),
    "graduation_summary": Entry(lambda wh: enr.graduation_summary(wh), **_q("graduation_summary", doubles=("grad_rate_pct",))),
    "graduation_trend": Entry(lambda wh: enr.graduation_trend(wh), **_q("graduation_trend")),
    "workload_total": Entry(lambda wh: lds.workload_total(wh, PAST), **_q("workload_total")),
    "conversion_age_bands": Entry(lambda wh: lds.conversion_age_bands(wh, PAST), **_q("conversion_age_bands")),
    "admission_mix": Entry(lambda wh: lds.admission_mix(wh, PAST), **_q("admission_mix")),
    "funnel_extras": Entry(lambda wh: lds.funnel_extras(wh, PAST), **_q("funnel_extras")),
    "quarterly_invoice_lines": Entry(lambda wh: inv.quarterly_invoice_lines(wh, BILLING_START),
                                     **_q("quarterly_invoice_lines", doubles=("saas_fee", "seat_prepaid_monthly"))),
    "monthly_invoice_purchases": Entry(lambda wh: inv.monthly_invoice_purchases(wh, BILLING_START),
                                       **_q("monthly_invoice_purchases",
                                            doubles=("invoice_total", "seat_overage", "growth"))),
    "additional_items": Entry(lambda wh: inv.additional_items(wh, BILLING_START),
                              **_q("additional_items", doubles=("additional_items",))),
    "invoice_breakdown": Entry(lambda wh: inv.invoice_breakdown(wh, BILLING_START),
                               **_q("invoice_breakdown", doubles=("saas_fee", "seat_fee", "growth", "additional_items",
                                                                  "total_cv", "monthly_invoice_total"))),
}


# ---- 2.12 report operators ------------------------------------------------
from ..oracle import reports_sql as RS  # noqa: E402
from . import overview as ov  # noqa: E402
from .month_report import enrolment_extras, tenant_month_report  # noqa: E402

TMR_DOUBLES = ("seat_fee_min", "seat_fee_max", "seat_overage_fee", "airlock_fee", "exemption_fee", "import_fee",
               "pba_fee", "rpl_fee", "enrollment_pct", "min_rev_share", "exp_rev_usd", "seat_exp_rev",
               "completion_rate", "avg_full_month")
MONEY = ("seat_rev", "share_rev", "lead_rev", "rpl_pba_rev", "course_rev", "expected_rev", "total_rev")
PCTS = ("delta_m1_pct", "delta_y1_pct")
PAGE_TENANT = "NATION_6"      # the tenant whose page ``tenant_page`` shows


def _price_maps(wh):
    """One JSON map a part, of prices as texts of which some are no number: what a hand-kept fee file looks like."""
    part = wh.base("part")
    raw = (F.when(F.col("p_partkey") % 4 == 0, F.lit("n/a")).when(F.col("p_partkey") % 4 == 1, F.lit("NaN"))
           .otherwise(F.col("p_retailprice").cast("string")))
    return part.select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), raw)).alias("doc"))


def _base(wh, p=PAST):
    return ov.overview_base(wh, p)


def _cols(cols) -> str:
    return ", ".join(cols)


def _ob(cols, where: str = "", extra: str = "", **kw) -> dict:
    sql = f"SELECT {_cols(cols)}{extra} FROM q_overview_base{where}"
    return dict(sql_final=sql, sql_deps=("q_overview_base",), **kw)


def _in(cols, pool):
    return tuple(c for c in cols if c in pool)


_SEAT_W = " WHERE revenue_model = 'SEAT_BASED'"
_SHARE_W = " WHERE revenue_model = 'REVENUE_SHARE'"
_SEAT_TOTAL_SUMS = [RS.sum_i("active_base"), RS.sum_i("new_enrol"), RS.sum_i("new_enrol_m1"), RS.sum_i("new_enrol_y1"),
                    RS.sum_i("new_enrol_m1_mtd"), RS.sum_i("new_enrol_y1_mtd"), RS.sum_i("eom_enrol"),
                    RS.sum_i("pauses_m1"), RS.sum_i("archives_m1"), RS.sum_i("net_additions"),
                    RS.sum_money("seat_rev"), RS.sum_money("lead_rev"), RS.sum_money("rpl_pba_rev"),
                    RS.sum_money("course_rev"), RS.sum_money("total_rev"),
                    RS.sum_i("st_till_last_month"), RS.sum_i("st_new_this_month"),
                    RS.sum_i("st_converted_this_month"), RS.sum_i("rpl_low"), RS.sum_i("rpl_high"),
                    RS.sum_i("pba_count"), RS.sum_i("featured_enrolments")]
_SHARE_TOTAL_SUMS = [RS.sum_i("new_enrol"), RS.sum_i("new_enrol_m1"), RS.sum_i("new_enrol_y1"),
                     RS.sum_i("new_enrol_m1_mtd"), RS.sum_i("new_enrol_y1_mtd"), RS.sum_i("eom_enrol"),
                     RS.sum_i("archived_30d"), RS.sum_i("net_revsh"),
                     RS.sum_money("share_rev"), RS.sum_money("lead_rev"), RS.sum_money("rpl_pba_rev"),
                     RS.sum_money("course_rev"), RS.sum_money("total_rev"),
                     RS.sum_i("st_till_last_month"), RS.sum_i("st_new_this_month"),
                     RS.sum_i("st_converted_this_month"), RS.sum_i("rpl_low"), RS.sum_i("rpl_high"),
                     RS.sum_i("pba_count"), RS.sum_i("featured_enrolments")]
_EOM_VAR = "CASE WHEN proj_sum <> 0 THEN eom_enrol - proj_sum END AS eom_variance,"
_ENROL_TOTAL_SUMS = [RS.sum_i("new_enrol"), RS.sum_i("eom_enrol_fallback", "eom_est"), RS.sum_i("new_enrol_m1"),
                     RS.sum_i("new_enrol_m1_mtd"), RS.sum_i("new_enrol_y1"), RS.sum_i("new_enrol_y1_mtd"),
                     RS.sum_i("st_till_last_month"), RS.sum_i("st_wlh_count"), RS.sum_i("st_new_this_month"),
                     RS.sum_i("st_converted_this_month"), RS.sum_i("pba_count"), RS.sum_i("rpl_admission"),
                     RS.sum_i("rpl_low"), RS.sum_i("rpl_high"), RS.sum_i("featured_enrolments")]
_ENROL_FINAL = ("CASE WHEN proj_sum <> 0 THEN eom_est >= proj_sum END AS eom_met, "
                "CASE WHEN proj_sum <> 0 THEN CAST(round_even(eom_est / proj_sum * 100, 0) AS BIGINT) END "
                "AS eom_pct_of_proj,")
_FLAG_SQL = " UNION ALL ".join(
    f"SELECT college_id, '{flag}' AS flag FROM q_tenant_month_report WHERE {cond}" for flag, cond in zip(
        ov.OPPORTUNITY_FLAGS,
        ("st_till_last_month > 0 AND st_converted_this_month = 0", "rpl_low = 0 AND rpl_high = 0", "pba_count = 0",
         "featured_enrolments = 0 AND revenue_model = 'SEAT_BASED'", "new_enrol = 0")))
_REV_OVERVIEW_SQL = ("SELECT t.id AS college_id, t.name, t.revenue_model, ib.invoice_name, "
                     "ib.invoice_name IS NOT NULL AS has_invoice, "
                     "CASE WHEN ib.invoice_name IS NOT NULL THEN ib.quarterly_status END AS quarterly_status, "
                     "CASE WHEN ib.invoice_name IS NOT NULL THEN ib.invoice_status END AS invoice_status, "
                     + ", ".join(f"CASE WHEN ib.invoice_name IS NOT NULL AND ib.{h} <> 0 THEN ib.{h} END AS {h}"
                                 for h in ov.HEADS)
                     + " FROM q_verified_tenants t LEFT JOIN q_invoice_breakdown ib ON ib.college_id = t.id")

ENTRIES.update({
    "tenant_month_report": Entry(lambda wh: tenant_month_report(wh, PAST),
                                 sql_final="SELECT * FROM q_tenant_month_report",
                                 sql_deps=("q_tenant_month_report",), doubles=TMR_DOUBLES, dates=("phase_start",)),
    "tenant_month_report_current": Entry(lambda wh: tenant_month_report(wh, CURRENT),
                                         sql_final="SELECT * FROM q_tenant_month_report",
                                         sql_deps=("q_tenant_month_report",), doubles=TMR_DOUBLES,
                                         dates=("phase_start",), period="current"),
    "enrolment_extras": Entry(lambda wh: enrolment_extras(wh, PAST), sql_final="SELECT * FROM q_enrolment_extras",
                              sql_deps=("q_enrolment_extras",)),
    "squad_report": Entry(lambda wh: ov.squad_report(wh, PAST),
                          sql_final="SELECT sq.squad, r.* FROM q_tenant_month_report r JOIN squads sq ON sq.name = r.name",
                          sql_deps=("q_tenant_month_report", "squads"), doubles=TMR_DOUBLES, dates=("phase_start",)),
    "squad_members_report": Entry(lambda wh: ov.restrict(tenant_month_report(wh, PAST), dims.squads(wh).select("name")),
                                  sql_final="SELECT * FROM q_tenant_month_report WHERE name IN (SELECT name FROM squads)",
                                  sql_deps=("q_tenant_month_report", "squads"), doubles=TMR_DOUBLES, dates=("phase_start",)),
    "tenant_page": Entry(lambda wh: ov.tenant_detail(tenant_month_report(wh, PAST), PAGE_TENANT),
                         sql_final=f"SELECT * FROM q_tenant_month_report WHERE name = '{PAGE_TENANT}'",
                         sql_deps=("q_tenant_month_report",), doubles=TMR_DOUBLES, dates=("phase_start",)),
    "lead_funnel": Entry(lambda wh: ov.lead_funnel(tenant_month_report(wh, PAST)),
                         sql_final="""SELECT *,
  CASE WHEN st_new > 0 THEN round_even(CAST(st_converted AS DOUBLE) / st_new * 100, 1) END AS conversion_pct,
  CASE WHEN st_converted > 0 THEN round_even(CAST(enrolled AS DOUBLE) / st_converted * 100, 1) END AS enrol_of_converted_pct
FROM (SELECT CAST(SUM(st_till_last_month) AS BIGINT) AS st_till, CAST(SUM(st_new_this_month) AS BIGINT) AS st_new,
  CAST(SUM(st_converted_this_month) AS BIGINT) AS st_converted, CAST(SUM(new_enrol) AS BIGINT) AS enrolled
  FROM q_tenant_month_report) s""", sql_deps=("q_tenant_month_report",),
                         doubles=("conversion_pct", "enrol_of_converted_pct")),
    "squad_lead_funnel": Entry(lambda wh: ov.squad_lead_funnel(wh, PAST), sql_final="""SELECT *,
  CASE WHEN st_new > 0 THEN round_even(CAST(st_converted AS DOUBLE) / st_new * 100, 1) END AS conversion_pct,
  CASE WHEN st_converted > 0 THEN round_even(CAST(enrolled AS DOUBLE) / st_converted * 100, 1) END AS enrol_of_converted_pct
FROM (SELECT sq.squad, CAST(SUM(r.st_till_last_month) AS BIGINT) AS st_till, CAST(SUM(r.st_new_this_month) AS BIGINT) AS st_new,
  CAST(SUM(r.st_converted_this_month) AS BIGINT) AS st_converted, CAST(SUM(r.new_enrol) AS BIGINT) AS enrolled
  FROM q_tenant_month_report r JOIN squads sq ON sq.name = r.name GROUP BY sq.squad) s""",
                               sql_deps=("q_tenant_month_report", "squads"),
                               doubles=("conversion_pct", "enrol_of_converted_pct")),
    "period_delta": Entry(lambda wh: ov.period_delta(_base(wh)),
                          **_ob(("college_id", "new_enrol", "new_enrol_m1_mtd", "delta_m1", "delta_m1_pct",
                                 "delta_m1_dir", "new_enrol_y1_mtd", "delta_y1", "delta_y1_pct", "delta_y1_dir"),
                                doubles=PCTS)),
    "projection_variance": Entry(lambda wh: ov.projection_variance(_base(wh)),
                                 **_ob(("college_id", "new_enrol", "projected", "completion_rate", "variance",
                                        "variance_mtd_based"), doubles=("completion_rate",))),
    "eom_estimate": Entry(lambda wh: ov.eom_estimate(_base(wh)),
                          **_ob(("college_id", "new_enrol", "projected", "eom_est", "eom_est_fallback", "eom_met",
                                 "eom_pct_of_proj"))),
    "revenue_components": Entry(lambda wh: ov.revenue_components(_base(wh)),
                                **_ob(("college_id", "revenue_model", "seat_rev", "share_rev", "lead_rev",
                                       "rpl_pba_rev", "course_rev", "expected_rev"),
                                      doubles=MONEY[:-1])),
    "total_revenue": Entry(lambda wh: ov.total_revenue(_base(wh)), **_ob(("college_id", "total_rev"),
                                                                         doubles=("total_rev",))),
    "section_kpis": Entry(lambda wh: ov.section_kpis(tenant_month_report(wh, PAST)),
                          sql_final="SELECT revenue_model, COUNT(*) AS tenants, " + ", ".join(
                              f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in
                              ("new_enrol", "pauses_m1", "archives_m1", "net_additions", "archived_30d", "net_revsh"))
                          + " FROM q_tenant_month_report GROUP BY revenue_model",
                          sql_deps=("q_tenant_month_report",)),
    "seat_overview": Entry(lambda wh: ov.seat_overview(_base(wh)),
                           **_ob(ov.SEAT_COLUMNS, _SEAT_W,
                                 doubles=_in(ov.SEAT_COLUMNS, MONEY + PCTS + ("seat_fee_min", "seat_fee_max")))),
    "seat_overview_total": Entry(lambda wh: ov.seat_overview_total(_base(wh)),
                                 sql_final=RS.totals_sql("SEAT_BASED", _SEAT_TOTAL_SUMS, _EOM_VAR),
                                 sql_deps=("q_overview_base",), doubles=MONEY[:1] + MONEY[2:5] + MONEY[6:] + PCTS),
    "seat_eom_revenue": Entry(lambda wh: ov.seat_eom_revenue(_base(wh)), sql_final="""SELECT *, eom_rev - total_rev AS eom_delta FROM (
  SELECT SUM(CASE WHEN COALESCE(active_base, 0) > 0 AND seat_rev IS NOT NULL
      THEN (CAST(COALESCE(active_base, 0) AS DOUBLE) + GREATEST(eom_enrol - new_enrol, 0)) * (seat_rev / CAST(COALESCE(active_base, 0) AS DOUBLE))
      ELSE COALESCE(seat_rev, 0) END
    + COALESCE(lead_rev, 0) + COALESCE(rpl_pba_rev, 0) + COALESCE(course_rev, 0)) AS eom_rev,
  COALESCE(SUM(total_rev), 0) AS total_rev
  FROM q_overview_base WHERE revenue_model = 'SEAT_BASED') t""", sql_deps=("q_overview_base",),
                              doubles=("eom_rev", "total_rev", "eom_delta")),
    "share_overview": Entry(lambda wh: ov.share_overview(_base(wh)),
                            **_ob([c for c in ov.SHARE_COLUMNS if c != "share_rev_approximate"], _SHARE_W,
                                  extra=", CASE WHEN share_rev IS NOT NULL THEN COALESCE(est_from_min_rev, 0) > 0 END"
                                        " AS share_rev_approximate",
                                  doubles=_in(ov.SHARE_COLUMNS, MONEY + PCTS + ("enrollment_pct",)))),
    "share_overview_total": Entry(lambda wh: ov.share_overview_total(_base(wh)),
                                  sql_final=RS.totals_sql("REVENUE_SHARE", _SHARE_TOTAL_SUMS, _EOM_VAR),
                                  sql_deps=("q_overview_base",), doubles=MONEY[1:5] + MONEY[6:] + PCTS),
    "share_eom_revenue": Entry(lambda wh: ov.share_eom_revenue(_base(wh)), sql_final="""SELECT *, eom_rev - total_rev AS eom_delta FROM (
  SELECT COALESCE(SUM(CASE WHEN total_rev IS NOT NULL AND total_rev <> 0 THEN
      CASE WHEN rel THEN total_rev / completion_rate ELSE total_rev END END), 0) AS eom_rev,
  COALESCE(SUM(total_rev), 0) AS total_rev
  FROM q_overview_base WHERE revenue_model = 'REVENUE_SHARE') t""", sql_deps=("q_overview_base",),
                               doubles=("eom_rev", "total_rev", "eom_delta")),
    "tenant_kpis": Entry(lambda wh: ov.tenant_kpis(tenant_month_report(wh, PAST)), sql_final="""SELECT college_id, name,
  revenue_model, new_enrol, new_enrol - new_enrol_m1 AS enrol_change_m1, pauses, archives, net_additions,
  CASE WHEN revenue_model = 'SEAT_BASED' THEN active_base ELSE st_converted_this_month END AS headline,
  CASE WHEN revenue_model = 'SEAT_BASED' THEN 'active_base' ELSE 'st_conversions' END AS headline_kind
FROM q_tenant_month_report""", sql_deps=("q_tenant_month_report",)),
    "tenant_trend_net": Entry(lambda wh: ov.tenant_trend_net(act.tenant_trend(wh, PAST)),
                              sql_final="SELECT * FROM q_tenant_trend_net", sql_deps=("q_tenant_trend_net",)),
    "lead_conversion": Entry(lambda wh: ov.lead_conversion(tenant_month_report(wh, PAST)), sql_final="""SELECT college_id,
  st_till_last_month, st_new_this_month, st_converted_this_month,
  CASE WHEN st_new_this_month > 0 THEN round_even(CAST(st_converted_this_month AS DOUBLE) / st_new_this_month * 100, 1) END AS conversion_pct,
  CASE WHEN st_new_this_month > 0 AND st_converted_this_month < st_new_this_month
       THEN st_new_this_month - st_converted_this_month END AS unconverted_gap
FROM q_tenant_month_report""", sql_deps=("q_tenant_month_report",), doubles=("conversion_pct",)),
    "opportunity_flags": Entry(lambda wh: ov.opportunity_flags(tenant_month_report(wh, PAST)),
                               sql_final=_FLAG_SQL, sql_deps=("q_tenant_month_report",)),
    "revenue_overview": Entry(lambda wh: ov.revenue_overview(wh, BILLING_START), sql_final=_REV_OVERVIEW_SQL,
                              sql_deps=("q_verified_tenants", "q_invoice_breakdown"), doubles=ov.HEADS),
    "revenue_overview_total": Entry(lambda wh: ov.revenue_overview_total(ov.revenue_overview(wh, BILLING_START)),
                                    sql_final="SELECT revenue_model, COUNT(*) AS tenants, COUNT(invoice_name) AS with_invoice, "
                                              + ", ".join(f"NULLIF(COALESCE(SUM({h}), 0), 0) AS {h}" for h in ov.HEADS)
                                              + f" FROM ({_REV_OVERVIEW_SQL}) r GROUP BY revenue_model",
                                    sql_deps=("q_verified_tenants", "q_invoice_breakdown"), doubles=ov.HEADS),
    "enrolment_overview_seat": Entry(lambda wh: ov.enrolment_overview_seat(_base(wh)),
                                     **_ob(ov.ENROL_COMMON + ("active_base", "pauses_m1", "archives_m1", "net_additions"),
                                           _SEAT_W, doubles=PCTS)),
    "enrolment_overview_seat_total": Entry(lambda wh: ov.enrolment_overview_seat_total(_base(wh)),
                                           sql_final=RS.totals_sql("SEAT_BASED", _ENROL_TOTAL_SUMS + [
                                               RS.sum_i("active_base"), RS.sum_i("pauses_m1"), RS.sum_i("archives_m1"),
                                               RS.sum_i("net_additions")], _ENROL_FINAL),
                                           sql_deps=("q_overview_base",), doubles=PCTS),
    "enrolment_overview_share": Entry(lambda wh: ov.enrolment_overview_share(_base(wh)),
                                      **_ob(ov.ENROL_COMMON + ("archived_30d", "net_revsh"), _SHARE_W, doubles=PCTS)),
    "enrolment_overview_share_total": Entry(lambda wh: ov.enrolment_overview_share_total(_base(wh)),
                                            sql_final=RS.totals_sql("REVENUE_SHARE", _ENROL_TOTAL_SUMS + [
                                                RS.sum_i("archived_30d"), RS.sum_i("net_revsh")], _ENROL_FINAL),
                                            sql_deps=("q_overview_base",), doubles=PCTS),
    "display_columns": Entry(lambda wh: ov.display_columns(_base(wh)), sql_final=RS.display_sql(),
                             sql_deps=("q_overview_base",)),
    # ---- 2.1 sources: side dimensions -----------------------------------
    "dim_projections": Entry(lambda wh: dims.projections(wh), sql_final="SELECT * FROM projections",
                             sql_deps=("projections",)),
    "dim_fees": Entry(lambda wh: dims.fees(wh), sql_final="SELECT * FROM fees", sql_deps=("fees",)),
    "fees_from_json": Entry(lambda wh: dims.fees_from_map(_price_maps(wh)),
                            sql_final="SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(p_retailprice AS DOUBLE) AS fee FROM part "
                                      "WHERE p_partkey % 4 IN (2, 3) AND p_retailprice IS NOT NULL", doubles=("fee",)),
    "dim_squads": Entry(lambda wh: dims.squads(wh), sql_final="SELECT * FROM squads", sql_deps=("squads",)),
    "dim_short_names": Entry(lambda wh: dims.with_label(
        enr.verified_tenants(wh).select(F.col("id").alias("college_id"), "name"), dims.short_names(wh)),
        sql_final="SELECT t.id AS college_id, t.name, COALESCE(sn.short_name, t.name) AS label "
                  "FROM q_verified_tenants t LEFT JOIN short_names sn ON sn.name = t.name",
        sql_deps=("q_verified_tenants", "short_names")),
    "dim_featured_courses": Entry(lambda wh: dims.featured_courses(wh), sql_final="SELECT * FROM featured_courses",
                                  sql_deps=("featured_courses",)),
})

# ---- 2.1 S01 table binding: every operational table, checked against its recipe ----
_TABLE_DOUBLES = {"degrees": ("tuition_cost",), "prices": ("price",), "invoice_purchase_overrides": ("tuition_due",),
                  "invoices": ("amount",), "purchases": ("rev_share",), "custom_prices": ("price",)}
_TABLE_TS = {"degree_students": ("created", "pause_started", "pause_ended", "delisted_timestamp"),
             "activities": ("created",), "st_students": ("created",), "subscription_phases": ("version",),
             "invoices": ("billing_started",), "purchases": ("created",), "rpl_exemption_requests": ("processed",),
             "degree_student_services": ("rpl",), "ams_course_students": ("created",)}


def _binding_entry(name: str) -> Entry:
    return Entry(lambda wh: wh.table(name), sql_final=f"SELECT * FROM {name}", sql_deps=(name,),
                 doubles=_TABLE_DOUBLES.get(name, ()), timestamps=_TABLE_TS.get(name, ()))


from ..sources.warehouse import OPERATIONAL_TABLES  # noqa: E402

# S01 as the source exposes it: SQL text over the named tables.
ENTRIES["run_query"] = Entry(
    lambda wh: wh.run_query("SELECT id, name, revenue_model FROM orgs WHERE status = 'VERIFIED' "
                            "ORDER BY revenue_model DESC, name"),
    sql_final="SELECT id, name, revenue_model FROM orgs WHERE status = 'VERIFIED' ORDER BY revenue_model DESC, name",
    sql_deps=("orgs",))

# The service-kind list is a fixed literal (it reads no given table), so it is
# unit-tested rather than registered.
ENTRIES.update({f"table_binding_{n}": _binding_entry(n) for n in OPERATIONAL_TABLES if n != "services"})


def _page_entry(build, rows: str, total: str) -> Entry:
    """A page's rows and TOTAL from one pass: by SQL the union of the two, each stated on its own."""
    r, t = ENTRIES[rows], ENTRIES[total]
    name = "" if rows == "revenue_overview" else "'TOTAL' AS name, "
    sql = (f"SELECT *, FALSE AS is_total FROM (\n{r.sql_final}\n) r\nUNION ALL BY NAME\n"
           f"SELECT {name}*, TRUE AS is_total FROM (\n{t.sql_final}\n) t")
    if not name:
        sql = f"SELECT * REPLACE (CASE WHEN is_total THEN 'TOTAL' ELSE name END AS name) FROM (\n{sql}\n) p"
    return Entry(build, sql_final=sql, sql_deps=tuple(dict.fromkeys((*r.sql_deps, *t.sql_deps))), doubles=tuple(dict.fromkeys((*r.doubles, *t.doubles))))


ENTRIES.update({
    "seat_page": _page_entry(lambda wh: ov.seat_page(_base(wh)), "seat_overview", "seat_overview_total"),
    "share_page": _page_entry(lambda wh: ov.share_page(_base(wh)), "share_overview", "share_overview_total"),
    "enrolment_page_seat": _page_entry(lambda wh: ov.enrolment_page_seat(_base(wh)), "enrolment_overview_seat", "enrolment_overview_seat_total"),
    "enrolment_page_share": _page_entry(lambda wh: ov.enrolment_page_share(_base(wh)), "enrolment_overview_share", "enrolment_overview_share_total"),
    "revenue_page": _page_entry(lambda wh: ov.revenue_page(wh, BILLING_START), "revenue_overview", "revenue_overview_total"),
})


# ---- 2.1 S07-S10 stored results --------------------------------------------
import uuid  # noqa: E402
from datetime import datetime  # noqa: E402

from ..streaming import snapshots as snap  # noqa: E402

# The refresh clock of the fixture runs (a past month, after it ended).
SNAPSHOT_NOW = datetime(2000, 7, 15, 12, 0, 0)


def _new_store(wh):
    """A store of its own for each call: what a query returns doesn't depend on what ran before."""
    return snap.SnapshotStore(wh.spark, f"{snap.default_root(wh.spark)}/{uuid.uuid4().hex}")


def _snapshot_read(wh):
    """The metric is computed, stored, and read back from the store within its time to live."""
    store, metric = _new_store(wh), "activity_counts_month_2000_06"
    store.read(metric, snap.TTL_LIVE, SNAPSHOT_NOW, lambda: act.activity_counts_month(wh, PAST))
    return store.read("activity_counts_month_2000_06", snap.TTL_LIVE, SNAPSHOT_NOW,
                      lambda: act.activity_counts_month(wh, PAST))


def _snapshot_refresh(wh):
    store = _new_store(wh)
    return snap.refresh(store, snap.month_tasks(wh, PAST, store=store, now=SNAPSHOT_NOW), SNAPSHOT_NOW).select(
        "key", "status", "rows")


# A refresh's report by SQL: every key of the month, stored, with its metric's number of rows.
_REFRESH_COUNTS = {m.key(PAST): f"q_{m.name}" for m in snap.stored_metrics()} | {
    snap.month_report_key(PAST): "q_tenant_month_report", snap.overview_key(PAST): "q_overview_base"}
_REFRESH_SQL = "\nUNION ALL ".join(f"SELECT '{k}' AS key, 'ok' AS status, (SELECT COUNT(*) FROM {t}) AS rows" for k, t in sorted(_REFRESH_COUNTS.items()))


def _rollup(wh, p):
    """Closed months in a store that later runs on the same tables find again."""
    from ..streaming.rollup import ActivityRollup

    store = snap.SnapshotStore(wh.spark, f"{snap.default_root(wh.spark)}/rollup-{wh.tag}")
    return ActivityRollup.for_period(store, wh, p, datetime(p.as_of.year, p.as_of.month, p.as_of.day, 12))


# The metrics over many months, from the incremental rollup: the results of their plain forms.
ENTRIES.update({
    "monthly_mtd_history_rollup": Entry(lambda wh: act.monthly_mtd_history(wh, PAST, rollup=_rollup(wh, PAST)), **_q("monthly_mtd_history", dates=("mo",))),
    "completion_rates_rollup": Entry(lambda wh: act.completion_rates(wh, CURRENT, rollup=_rollup(wh, CURRENT)),
                                     **_q("completion_rates", doubles=("completion_rate", "avg_full_month"), period="current")),
    "activity_counts_prior_rollup": Entry(lambda wh: act.activity_counts_prior(wh, CURRENT, rollup=_rollup(wh, CURRENT)),
                                          **_q("activity_counts_prior", period="current")),
    "tenant_trend_rollup": Entry(lambda wh: act.tenant_trend(wh, CURRENT, rollup=_rollup(wh, CURRENT)), **_q("tenant_trend", period="current")),
})

ENTRIES.update({
    "snapshot_read": Entry(_snapshot_read, **_q("activity_counts_month")),
    "snapshot_refresh": Entry(_snapshot_refresh, sql_final=_REFRESH_SQL, sql_deps=tuple(sorted(set(_REFRESH_COUNTS.values())))),
})
