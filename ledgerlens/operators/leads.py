"""Lead (study-track student) metrics and the enrolment funnel: M07, M13, M18, M21a-c, M21."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datetime import date

from ..functions.exprs import count_if, day, day_on_or_before, is_false, is_true, on_or_between
from ..functions.periods import Period
from ..sources.warehouse import Warehouse
from .activity import ENROL

# Lead workload threshold in minutes (25 hours).
WORKLOAD_MINUTES = 1500
# Conversion age bands (upper bounds in days) and their labels.
AGE_BANDS = (("0-6m", 180), ("6-12m", 365))
AGE_BAND_LAST = "12+m"

FUNNEL_COLUMNS = ("wlh_count", "age_0_6m", "age_6_12m", "age_12pm", "conv_total",
                  "adm_standard", "adm_pba", "adm_rpl", "enrol_total")


def _leads(wh: Warehouse, lo: date | None = None, hi: date | None = None) -> DataFrame:
    st = (wh.slice("st_students", lo, hi) if (lo or hi) else wh.table("st_students")).select(
        F.col("student_id"), "created", "workload_count", "degree_count")
    s = wh.table("students").select(F.col("id").alias("student_id"), "college_id")
    return st.join(s, "student_id")


def lead_counts(wh: Warehouse, p: Period) -> DataFrame:
    """Leads created by the end of M-1 and leads created in the month, per tenant."""
    return _leads(wh).groupBy("college_id").agg(
        count_if(day_on_or_before("created", p.m1_last)).alias("st_till_last_month"),
        count_if(on_or_between("created", p.first, p.last)).alias("st_new_this_month"),
    )


def _workload_filter():
    return (F.col("workload_count") >= WORKLOAD_MINUTES) & (F.col("degree_count") == 0)


def _before(p: Period) -> date:
    return date.fromordinal(p.first.toordinal() - 1)


def lead_workload(wh: Warehouse, p: Period) -> DataFrame:
    """Unconverted leads created before the month with at least 25 h of work."""
    return (_leads(wh, hi=_before(p)).where(_workload_filter()).groupBy("college_id")
            .agg(F.count(F.lit(1)).alias("st_wlh_count")))


def lead_trend(wh: Warehouse, p: Period, months: int = 14, college_id=None) -> DataFrame:
    """New leads per (tenant, month) since as_of - months."""
    leads = _leads(wh, lo=p.trend_first(months))
    if college_id is not None:
        leads = leads.where(F.col("college_id") == F.lit(college_id))
    return (leads.groupBy("college_id", F.date_format(day("created"), "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("new_st"))
            .orderBy("college_id", "month"))


def workload_total(wh: Warehouse, p: Period) -> DataFrame:
    """M13 over all leads, without the tenant join."""
    st = wh.slice("st_students", hi=_before(p))
    return st.where(_workload_filter()).agg(F.count(F.lit(1)).alias("wlh_count"))


def conversion_age_bands(wh: Warehouse, p: Period) -> DataFrame:
    """Conversions of the month by days between lead creation and enrolment.

    Joins enrolment -> student (by user) -> lead; a user with several student
    or lead rows fans out, as in the source definition.
    """
    # The enrolment side is reduced to (user, day, n) first: at most 31 rows per
    # user in a month. Each lead row then meets its user's enrolment days and
    # carries their multiplicity, so the joined-row count of the source
    # definition is kept exactly without emitting enrolment x lead pairs.
    ds_days = (wh.slice("degree_students", p.first, p.last)
               .where(is_true("has_activity_before_invitation"))
               .groupBy("user_id", day("created").alias("ds_day"))
               .agg(F.count(F.lit(1)).alias("n_ds")))
    s = wh.table("students").select(F.col("id").alias("student_id"), "user_id")
    st = wh.table("st_students").select("student_id", day("created").alias("st_day"))
    age = F.datediff(F.col("ds_day"), F.col("st_day"))
    band = F.when(age < AGE_BANDS[0][1], AGE_BANDS[0][0])
    for label, upper in AGE_BANDS[1:]:
        band = band.when(age < upper, label)
    band = band.otherwise(AGE_BAND_LAST)
    # From the month's users outwards: their students, then those students' leads.
    return (s.join(ds_days, "user_id").join(st, "student_id")
            .groupBy(band.alias("band")).agg(F.sum("n_ds").cast("bigint").alias("cnt")))


def admission_mix(wh: Warehouse, p: Period) -> DataFrame:
    """Enrol events of the month joined to enrolments on (user, tenant, degree).

    SUM(CASE ...) semantics: NULL when the join is empty; a NULL PBA flag
    counts in no bucket (Q6).
    """
    keys = ["user_id", "college_id", "degree_id"]
    # Enrol events of the month reduced to one row per key with their count:
    # each enrolment row meets at most one such row and contributes that
    # count, which equals the event x enrolment fan-out without building it.
    a = (wh.slice("activities", p.first, p.last).where(F.col("kind") == ENROL)
         .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events")))
    ds = wh.table("degree_students").select(*keys, "is_pba_converted", "rpl_exemption_request_id")
    pba = is_true("is_pba_converted")
    rpl = F.col("rpl_exemption_request_id").isNotNull() & is_false("is_pba_converted")
    std = is_false("is_pba_converted") & F.col("rpl_exemption_request_id").isNull()

    def flag_sum(c):
        return F.sum(F.when(c, F.col("n_events")).otherwise(0)).cast("bigint")

    return ds.join(a, keys).agg(flag_sum(pba).alias("pba"), flag_sum(rpl).alias("rpl"),
                                flag_sum(std).alias("standard"))


def funnel_extras(wh: Warehouse, p: Period) -> DataFrame:
    """The one-row funnel banner; a missing band or empty join is 0."""
    wl = workload_total(wh, p)
    bands = conversion_age_bands(wh, p).agg(
        *[F.coalesce(F.sum(F.when(F.col("band") == lbl, F.col("cnt"))), F.lit(0)).cast("bigint").alias(name)
          for lbl, name in (("0-6m", "age_0_6m"), ("6-12m", "age_6_12m"), ("12+m", "age_12pm"))],
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("conv_total"),
    )
    adm = admission_mix(wh, p).select(
        F.coalesce("standard", F.lit(0)).cast("bigint").alias("adm_standard"),
        F.coalesce("pba", F.lit(0)).cast("bigint").alias("adm_pba"),
        F.coalesce("rpl", F.lit(0)).cast("bigint").alias("adm_rpl"),
    ).withColumn("enrol_total", F.col("adm_standard") + F.col("adm_pba") + F.col("adm_rpl"))
    # Three one-row aggregates side by side (J12): stack them and take the
    # one value each column has, instead of a cartesian product.
    stacked = wl.unionByName(bands, allowMissingColumns=True).unionByName(adm, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in FUNNEL_COLUMNS])
