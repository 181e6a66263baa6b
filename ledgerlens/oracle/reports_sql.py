"""DuckDB formulations of the report layer (R01-R28) on top of the metric CTEs."""

from __future__ import annotations

from ..functions.periods import Period

COUNTS = ("new_enrol", "pauses", "archives", "new_enrol_m1", "pauses_m1", "archives_m1", "new_enrol_m1_mtd",
          "new_enrol_y1", "new_enrol_y1_mtd")


def _delta(cur: str, prior: str, name: str) -> str:
    diff = f"({cur} - {prior})"
    return (f"{diff} AS {name}, "
            f"CASE WHEN {prior} <> 0 THEN round_even(CAST({diff} AS DOUBLE) / {prior} * 100, 1) END AS {name}_pct, "
            f"CASE WHEN {diff} > 0 THEN 'up' WHEN {diff} < 0 THEN 'down' ELSE 'flat' END AS {name}_dir")


def _change_text(cur: str, prior: str) -> str:
    diff = f"({cur} - {prior})"
    head = (f"CASE WHEN {diff} > 0 THEN '▲' ELSE '▼' END || ' ' || CASE WHEN {diff} > 0 THEN '+' ELSE '' END"
            f" || CAST({diff} AS VARCHAR)")
    pct = f"CAST(round_even(CAST({diff} AS DOUBLE) / {prior} * 100, 1) AS VARCHAR)"
    return (f"CASE WHEN {diff} = 0 THEN '→ 0' WHEN {prior} = 0 THEN {head} "
            f"ELSE {head} || ' (' || {pct} || '%)' END")


def _money(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN '$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)) END"


def report_ctes(p: Period) -> dict[str, tuple[str, tuple[str, ...]]]:
    key = p.projection_key
    count_cols = ",\n  ".join(
        [f"COALESCE(a.{c}, 0) AS {c}" for c in COUNTS[:3]] + [f"COALESCE(h.{c}, 0) AS {c}" for c in COUNTS[3:]])
    return {
        "q_tenant_month_report": (f"""SELECT t.id AS college_id, t.name, t.revenue_model,
  {count_cols},
  CASE WHEN t.revenue_model = 'SEAT_BASED' THEN COALESCE(ab.active_base, 0) END AS active_base,
  COALESCE(lc.st_till_last_month, 0) AS st_till_last_month, COALESCE(lc.st_new_this_month, 0) AS st_new_this_month,
  COALESCE(cc.st_converted_this_month, 0) AS st_converted_this_month, COALESCE(cc.pba_count, 0) AS pba_count,
  COALESCE(ex.rpl_low, 0) AS rpl_low, COALESCE(ex.rpl_high, 0) AS rpl_high,
  COALESCE(fc.featured_enrolments, 0) AS featured_enrolments, COALESCE(rw.archived_30d, 0) AS archived_30d,
  pc.phase_start, pc.seat_fee_min, pc.seat_fee_max, pc.seat_overage_fee, pc.airlock_fee, pc.exemption_fee,
  pc.import_fee, pc.pba_fee, pc.rpl_fee, pc.enrollment_pct, pc.min_rev_share,
  es.exp_rev_usd, es.est_from_min_rev, se.seat_exp_rev, cr.completion_rate, cr.avg_full_month,
  COALESCE(a.new_enrol, 0) - COALESCE(h.pauses_m1, 0) - COALESCE(h.archives_m1, 0) AS net_additions,
  COALESCE(a.new_enrol, 0) - COALESCE(rw.archived_30d, 0) AS net_revsh
FROM q_verified_tenants t
LEFT JOIN q_activity_counts_month a ON a.college_id = t.id
LEFT JOIN q_activity_counts_prior h ON h.college_id = t.id
LEFT JOIN q_active_base ab ON ab.college_id = t.id
LEFT JOIN q_lead_counts lc ON lc.college_id = t.id
LEFT JOIN q_conversion_admission_counts cc ON cc.college_id = t.id
LEFT JOIN q_exemption_counts ex ON ex.college_id = t.id
LEFT JOIN q_featured_course_counts fc ON fc.college_id = t.id
LEFT JOIN q_refund_window_archives rw ON rw.college_id = t.id
LEFT JOIN q_pricing_config pc ON pc.college_id = t.id
LEFT JOIN q_expected_share_revenue es ON es.college_id = t.id
LEFT JOIN q_seat_expected_revenue se ON se.college_id = t.id
LEFT JOIN q_completion_rates cr ON cr.college_id = t.id""",
                                  ("q_verified_tenants", "q_activity_counts_month", "q_activity_counts_prior",
                                   "q_active_base", "q_lead_counts", "q_conversion_admission_counts",
                                   "q_exemption_counts", "q_featured_course_counts", "q_refund_window_archives",
                                   "q_pricing_config", "q_expected_share_revenue", "q_seat_expected_revenue",
                                   "q_completion_rates")),
        "q_enrolment_extras": ("""SELECT COALESCE(r.college_id, w.college_id) AS college_id,
  CAST(COALESCE(r.rpl_admission, 0) AS BIGINT) AS rpl_admission, CAST(COALESCE(w.st_wlh_count, 0) AS BIGINT) AS st_wlh_count
FROM q_rpl_admissions r FULL OUTER JOIN q_lead_workload w ON w.college_id = r.college_id""",
                               ("q_rpl_admissions", "q_lead_workload")),
        "q_ob0": (f"""SELECT r.*, pj.projected, fe.fee AS course_fee,
  COALESCE(x.rpl_admission, 0) AS rpl_admission, COALESCE(x.st_wlh_count, 0) AS st_wlh_count,
  COALESCE(sn.short_name, r.name) AS label, COALESCE(r.completion_rate >= 0.25, false) AS rel
FROM q_tenant_month_report r
LEFT JOIN projections pj ON pj.name = r.name AND pj.month = '{key}'
LEFT JOIN fees fe ON fe.name = r.name
LEFT JOIN q_enrolment_extras x ON x.college_id = r.college_id
LEFT JOIN short_names sn ON sn.name = r.name""",
                  ("q_tenant_month_report", "projections", "fees", "q_enrolment_extras", "short_names")),
        "q_ob1": ("""SELECT *,
  CASE WHEN rel THEN CAST(round_even(new_enrol / completion_rate, 0) AS BIGINT) ELSE new_enrol END AS eom_enrol,
  CASE WHEN rel THEN CAST(round_even(new_enrol / completion_rate, 0) AS BIGINT)
       WHEN avg_full_month IS NOT NULL AND avg_full_month <> 0 AND avg_full_month > new_enrol
         THEN CAST(round_even(avg_full_month, 0) AS BIGINT)
       ELSE new_enrol END AS eom_enrol_fallback,
  CASE WHEN seat_exp_rev > 0 THEN seat_exp_rev END AS seat_rev,
  CASE WHEN exp_rev_usd > 0 THEN exp_rev_usd END AS share_rev,
  st_converted_this_month * airlock_fee AS lead_rev,
  rpl_low * airlock_fee + rpl_high * 2 * airlock_fee + pba_count * airlock_fee + 0 AS rpl_pba_rev,
  CAST(featured_enrolments * course_fee AS DOUBLE) AS course_rev
FROM q_ob0""", ("q_ob0",)),
        "q_ob2": (f"""SELECT *,
  {_delta('new_enrol', 'new_enrol_m1_mtd', 'delta_m1')},
  {_delta('new_enrol', 'new_enrol_y1_mtd', 'delta_y1')},
  CASE WHEN projected IS NOT NULL THEN
    CASE WHEN rel THEN CAST(round_even(new_enrol / completion_rate, 0) AS BIGINT) - projected
         ELSE new_enrol - projected END END AS variance,
  CASE WHEN projected IS NOT NULL THEN NOT rel END AS variance_mtd_based,
  CASE WHEN projected IS NOT NULL THEN eom_enrol_fallback END AS eom_est,
  CASE WHEN projected IS NOT NULL THEN NOT rel END AS eom_est_fallback,
  CASE WHEN projected IS NOT NULL THEN eom_enrol_fallback >= projected END AS eom_met,
  CASE WHEN projected > 0 THEN CAST(round_even(eom_enrol_fallback / projected * 100, 0) AS BIGINT) END AS eom_pct_of_proj,
  CASE WHEN revenue_model = 'SEAT_BASED' THEN seat_rev ELSE share_rev END AS expected_rev
FROM q_ob1""", ("q_ob1",)),
        "q_overview_base": ("""SELECT *,
  CASE WHEN expected_rev IS NULL AND lead_rev IS NULL AND rpl_pba_rev IS NULL AND course_rev IS NULL THEN NULL
       ELSE COALESCE(expected_rev, 0) + COALESCE(lead_rev, 0) + COALESCE(rpl_pba_rev, 0) + COALESCE(course_rev, 0)
  END AS total_rev
FROM q_ob2""", ("q_ob2",)),
        "q_tenant_trend_net": ("SELECT *, new_enrol - pauses - archives AS net FROM q_tenant_trend", ("q_tenant_trend",)),
    }


def sum_i(c: str, alias: str | None = None) -> str:
    return f"CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS {alias or c}"


def sum_money(c: str) -> str:
    return f"NULLIF(COALESCE(SUM({c}), 0), 0) AS {c}"


def totals_sql(model: str, sums: list[str], extra_final: str = "") -> str:
    inner = ",\n  ".join(sums)
    return f"""SELECT * EXCLUDE (proj_sum),
  NULLIF(proj_sum, 0) AS projected,
  {extra_final}
  {_delta('new_enrol', 'new_enrol_m1_mtd', 'delta_m1')},
  {_delta('new_enrol', 'new_enrol_y1_mtd', 'delta_y1')}
FROM (SELECT CAST(COALESCE(SUM(projected), 0) AS BIGINT) AS proj_sum,
  {inner}
  FROM q_overview_base WHERE revenue_model = '{model}') t"""


def display_sql() -> str:
    approx = "COALESCE(est_from_min_rev, 0) > 0"
    money_exp = _money("expected_rev")
    return f"""SELECT college_id,
  CASE WHEN seat_fee_min IS NOT NULL THEN
    CASE WHEN seat_fee_min = seat_fee_max THEN '$' || CAST(CAST(TRUNC(seat_fee_min) AS BIGINT) AS VARCHAR)
         ELSE '$' || CAST(CAST(TRUNC(seat_fee_min) AS BIGINT) AS VARCHAR) || '/$' || CAST(CAST(TRUNC(seat_fee_max) AS BIGINT) AS VARCHAR) END
  END AS seat_fee_text,
  CASE WHEN enrollment_pct IS NOT NULL THEN printf('%.1f%%', enrollment_pct * 100) END AS enrollment_pct_text,
  CASE WHEN revenue_model = 'SEAT_BASED' THEN {money_exp}
       ELSE CASE WHEN {money_exp} IS NULL THEN NULL WHEN {approx} THEN '~' || {money_exp} ELSE {money_exp} END
  END AS expected_rev_text,
  {_money('total_rev')} AS total_rev_text,
  {_change_text('new_enrol', 'new_enrol_m1_mtd')} AS vs_m1_text,
  {_change_text('new_enrol', 'new_enrol_y1_mtd')} AS vs_y1_text,
  CASE WHEN variance IS NOT NULL THEN
    CASE WHEN variance > 0 THEN '▲ +' || CAST(variance AS VARCHAR) WHEN variance < 0 THEN '▼ ' || CAST(variance AS VARCHAR) ELSE '→ 0' END
    || CASE WHEN variance_mtd_based THEN '*' ELSE '' END
  END AS variance_text
FROM q_overview_base"""
