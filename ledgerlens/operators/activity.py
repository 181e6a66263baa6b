"""Activity-event metrics: M02, M03, M14a-d, M14, M17.

All of them count enrolment / pause / archive events per tenant over date
ranges. They share one building block, ``activity_daily``: a per
(tenant, day) rollup of the three event kinds over a bounded date range.
The range filter is pushed into the scan; the partial aggregate runs
map-side, so what is shuffled is at most (tenants x days) rows however hot
one tenant is. A report that needs several of these metrics builds the
rollup once over the union of their ranges and passes it in, so the fact
table is scanned once.

M03, M14a, M14, M17 and the report's pass also take ``rollup``, an object whose
``months(lo, hi)`` gives counts by tenant, month and day of the month
(``streaming.rollup.ActivityRollup``): closed months are then read from stored
rows, and only the open month's events are scanned.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_if, day, safe_div, sqlround
from ..functions.periods import Period, add_months, lit_date
from ..sources.warehouse import Warehouse

# The activity kinds counted by the metric layer.
ENROL = "addDegreeStudent"
PAUSE = "pauseDegreeStudent"
ARCHIVE = "archiveDegreeStudent"
KINDS = (ENROL, PAUSE, ARCHIVE)


def activity_daily(wh: Warehouse, lo: date | None = None, hi: date | None = None) -> DataFrame:
    """(college_id, d, n_enrol, n_pause, n_archive) for days in [lo, hi]."""
    a = wh.slice("activities", lo, hi)
    return (
        a.where(F.col("kind").isin(*KINDS))
        .groupBy("college_id", day("created").alias("d"))
        .agg(
            count_if(F.col("kind") == ENROL).alias("n_enrol"),
            count_if(F.col("kind") == PAUSE).alias("n_pause"),
            count_if(F.col("kind") == ARCHIVE).alias("n_archive"),
        )
    )


def _between(lo: date, hi: date):
    return F.col("d").between(lit_date(lo), lit_date(hi))


def _sum_if(cond, col: str):
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast("bigint")


def activity_counts_month(wh: Warehouse, p: Period, daily: DataFrame | None = None) -> DataFrame:
    """new_enrol, pauses, archives per tenant in the selected month."""
    if daily is None:        # alone: one aggregation by tenant
        a = wh.slice("activities", p.first, p.last).where(F.col("kind").isin(*KINDS))
        return a.groupBy("college_id").agg(
            count_if(F.col("kind") == ENROL).alias("new_enrol"), count_if(F.col("kind") == PAUSE).alias("pauses"),
            count_if(F.col("kind") == ARCHIVE).alias("archives"))
    return (
        daily.where(_between(p.first, p.last))
        .groupBy("college_id")
        .agg(
            F.sum("n_enrol").cast("bigint").alias("new_enrol"),
            F.sum("n_pause").cast("bigint").alias("pauses"),
            F.sum("n_archive").cast("bigint").alias("archives"),
        )
    )


def activity_counts_prior(wh: Warehouse, p: Period, daily: DataFrame | None = None, rollup=None) -> DataFrame:
    """Full and capped M-1 / Y-1 counts from one bounded scan [y1_first, m1_last]."""
    if rollup is not None:
        monthly = activity_monthly(wh, p.y1_first, p.m1_last, p.today_day, rollup)
        return monthly.groupBy("college_id").agg(
            *[_in_month(p.m1_first, c).alias(n) for c, n in (("n_enrol", "new_enrol_m1"), ("n_pause", "pauses_m1"), ("n_archive", "archives_m1"),
                                                             ("n_enrol_mtd", "new_enrol_m1_mtd"))],
            _in_month(p.y1_first, "n_enrol").alias("new_enrol_y1"), _in_month(p.y1_first, "n_enrol_mtd").alias("new_enrol_y1_mtd"))
    if daily is None:        # alone: one aggregation by tenant, each event its own day
        a = wh.slice("activities", p.y1_first, p.m1_last).where(F.col("kind").isin(*KINDS))
        daily = a.select("college_id", day("created").alias("d"), *[
            (F.col("kind") == k).cast("bigint").alias(n) for k, n in ((ENROL, "n_enrol"), (PAUSE, "n_pause"), (ARCHIVE, "n_archive"))])
    m1 = _between(p.m1_first, p.m1_last)
    return (
        daily.where(_between(p.y1_first, p.m1_last))
        .groupBy("college_id")
        .agg(
            _sum_if(m1, "n_enrol").alias("new_enrol_m1"),
            _sum_if(m1, "n_pause").alias("pauses_m1"),
            _sum_if(m1, "n_archive").alias("archives_m1"),
            _sum_if(_between(p.m1_first, p.m1_cap), "n_enrol").alias("new_enrol_m1_mtd"),
            _sum_if(_between(p.y1_first, p.y1_last), "n_enrol").alias("new_enrol_y1"),
            _sum_if(_between(p.y1_first, p.y1_cap), "n_enrol").alias("new_enrol_y1_mtd"),
        )
    )


def _in_month(month: date, col: str):
    return _sum_if(F.col("mo") == lit_date(month), col)


def activity_monthly(wh: Warehouse, lo: date, hi: date | None, through_day: int, rollup=None) -> DataFrame:
    """(college_id, mo, n_enrol, n_enrol_mtd, n_pause, n_archive) for days in [lo, hi] (``hi`` None: open).

    ``n_enrol_mtd`` counts enrolments on or before day ``through_day`` of the
    month: the capped month-to-date count of M03 and the MTD count of M14.
    From a ``rollup`` the counts are sums over its rows' own days: no exchange.
    """
    if rollup is not None:
        return _monthly_of(rollup.months(lo, hi), lo, hi, through_day)
    a = wh.slice("activities", lo, hi)
    d = day("created")
    enrol = F.col("kind") == ENROL
    return (
        a.where(F.col("kind").isin(*KINDS))
        .groupBy("college_id", F.trunc(d, "MM").alias("mo"))
        .agg(
            count_if(enrol).alias("n_enrol"),
            count_if(enrol & (F.dayofmonth(d) <= F.lit(through_day))).alias("n_enrol_mtd"),
            count_if(F.col("kind") == PAUSE).alias("n_pause"),
            count_if(F.col("kind") == ARCHIVE).alias("n_archive"),
        )
    )


def _monthly_of(rolled: DataFrame, lo: date, hi: date | None, through_day: int) -> DataFrame:
    """``activity_monthly`` of rollup rows (college_id, mo, days)."""
    def inside(x):
        d = F.date_add("mo", x["dom"] - 1)
        return (d >= lit_date(lo)) if hi is None else d.between(lit_date(lo), lit_date(hi))

    def total(col: str, upto=None):
        kept = F.filter("days", lambda x: inside(x) if upto is None else inside(x) & (x["dom"] <= F.lit(upto)))
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, x: acc + x[col])

    counts = rolled.select("college_id", "mo", total("n_enrol").alias("n_enrol"), total("n_enrol", through_day).alias("n_enrol_mtd"),
                           total("n_pause").alias("n_pause"), total("n_archive").alias("n_archive"))
    # a month with events of other kinds only, or outside the days, is no row
    return counts.where(F.col("n_enrol") + F.col("n_pause") + F.col("n_archive") > 0)


def month_report_activity(wh: Warehouse, p: Period, rollup=None) -> DataFrame:
    """M02, M03 and M14 columns per tenant from a single bounded scan of ``activities``.

    The monthly rollup is aggregated once more per tenant. The 18-month
    history needed by M14 travels as a per-tenant array of at most 18
    (month, mtd, total) entries - bounded by the calendar, not by the data -
    and the top-4 / same-month-last-year / preceding-months averages are
    array expressions, so no window and no second scan is needed.
    """
    monthly = activity_monthly(wh, p.history_first, p.last, p.today_day, rollup)
    mo, at = F.col("mo"), _in_month
    in_hist = (mo >= lit_date(p.history_first)) & (mo < lit_date(p.first)) & (F.col("n_enrol") > 0)
    entry = F.struct(mo.alias("mo"), F.col("n_enrol_mtd").alias("mtd"), F.col("n_enrol").alias("total"))
    agg = monthly.groupBy("college_id").agg(
        at(p.first, "n_enrol").alias("new_enrol"),
        at(p.first, "n_pause").alias("pauses"),
        at(p.first, "n_archive").alias("archives"),
        at(p.m1_first, "n_enrol").alias("new_enrol_m1"),
        at(p.m1_first, "n_pause").alias("pauses_m1"),
        at(p.m1_first, "n_archive").alias("archives_m1"),
        at(p.m1_first, "n_enrol_mtd").alias("new_enrol_m1_mtd"),
        at(p.y1_first, "n_enrol").alias("new_enrol_y1"),
        at(p.y1_first, "n_enrol_mtd").alias("new_enrol_y1_mtd"),
        F.sort_array(F.collect_list(F.when(in_hist, entry)), asc=False).alias("hist"),
    )
    return completion_from_history(agg, p).drop("hist")


def _rate(x):
    return x["mtd"].cast("double") / x["total"].cast("double")


def _avg(arr, value):
    n = F.size(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + value(x))
    return F.when(n > 0, total / n)


def completion_from_history(df: DataFrame, p: Period) -> DataFrame:
    """M14 from ``hist`` (months with enrolments, newest first): adds completion_rate, avg_full_month."""
    top4 = F.slice(F.col("hist"), 1, 4)
    y1 = lit_date(add_months(p.first, -12))
    prev_lo = lit_date(add_months(p.first, -16))
    y1_rows = F.filter(F.col("hist"), lambda x: x["mo"] == y1)
    prev_rows = F.filter(F.col("hist"), lambda x: (x["mo"] >= prev_lo) & (x["mo"] < y1))
    momentum = _avg(top4, _rate)
    y1_rate = F.when(F.size(y1_rows) > 0, _rate(F.element_at(y1_rows, 1)))
    factor = safe_div(y1_rate, _avg(prev_rows, _rate))
    return df.select(
        "*",
        F.coalesce(F.try_multiply(momentum, factor), momentum).alias("completion_rate"),
        sqlround(_avg(top4, lambda x: x["total"].cast("double")), 0).alias("avg_full_month"),
    )


# ---- M14: seasonality-aware completion rate ------------------------------

def monthly_mtd_history(wh: Warehouse, p: Period, through_day: int | None = None,
                        daily: DataFrame | None = None, rollup=None) -> DataFrame:
    """(college_id, mo, mtd_count, total_month) over the 18 months before the month.

    One exchange, by (tenant, month); none from a ``rollup`` of closed months.
    """
    through_day = p.today_day if through_day is None else through_day
    lo, hi = p.history_first, date.fromordinal(p.first.toordinal() - 1)
    if daily is None:
        monthly = activity_monthly(wh, lo, hi, through_day, rollup)
        return monthly.where(F.col("n_enrol") > 0).select("college_id", "mo", F.col("n_enrol_mtd").alias("mtd_count"), F.col("n_enrol").alias("total_month"))
    # Window membership is a condition inside the sums (not a row filter) so
    # a shared rollup stays one subtree; empty months drop out afterwards.
    window = _between(lo, hi)
    return (
        daily.groupBy("college_id", F.trunc("d", "MM").alias("mo"))
        .agg(
            _sum_if(window & (F.dayofmonth("d") <= F.lit(through_day)), "n_enrol").alias("mtd_count"),
            _sum_if(window, "n_enrol").alias("total_month"),
        )
        .where(F.col("total_month") > 0)
    )


def mtd_rates(hist: DataFrame) -> DataFrame:
    """rate = mtd / total for months with enrolments."""
    return hist.where(F.col("total_month") > 0).select(
        "college_id", "mo", safe_div(F.col("mtd_count"), F.col("total_month")).alias("rate"), "total_month")


def momentum_last4(rates: DataFrame) -> DataFrame:
    """Average rate and rounded average month size over the latest 4 months with rows."""
    w = Window.partitionBy("college_id").orderBy(F.col("mo").desc())
    return (
        rates.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= 4)
        .groupBy("college_id")
        .agg(F.avg("rate").alias("momentum_rate"),
             sqlround(F.avg("total_month"), 0).alias("avg_full_month"))
    )


def seasonal_factor(rates: DataFrame, p: Period) -> DataFrame:
    """M14d: y1_rate (same month last year) and y1_prev_rate (avg of months -16..-13)."""
    y1_mo = lit_date(add_months(p.first, -12))
    prev_lo = lit_date(add_months(p.first, -16))
    return rates.groupBy("college_id").agg(
        F.max(F.when(F.col("mo") == y1_mo, F.col("rate"))).alias("y1_rate"),
        F.avg(F.when((F.col("mo") >= prev_lo) & (F.col("mo") < y1_mo), F.col("rate"))).alias("y1_prev_rate"),
    )


def completion_rates(wh: Warehouse, p: Period, through_day: int | None = None, rollup=None) -> DataFrame:
    """completion_rate = momentum x y1_rate / y1_prev_rate (else momentum); avg_full_month.

    One bounded scan: the 18-month monthly rollup is folded into a per-tenant
    history array (at most 18 entries) and the averages are array expressions.
    Tenants without any month of enrolments have no row.
    """
    through_day = p.today_day if through_day is None else through_day
    hi = date.fromordinal(p.first.toordinal() - 1)
    monthly = activity_monthly(wh, p.history_first, hi, through_day, rollup).where(F.col("n_enrol") > 0)
    entry = F.struct(F.col("mo").alias("mo"), F.col("n_enrol_mtd").alias("mtd"), F.col("n_enrol").alias("total"))
    hist = monthly.groupBy("college_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("hist"))
    return completion_from_history(hist, p).select("college_id", "completion_rate", "avg_full_month")


def completion_rates_windowed(wh: Warehouse, p: Period, through_day: int | None = None,
                              daily: DataFrame | None = None) -> DataFrame:
    """M14 spelled with M14a-d (window top-4 and joins); the same result as ``completion_rates``."""
    rates = mtd_rates(monthly_mtd_history(wh, p, through_day, daily))
    m = momentum_last4(rates)
    s = seasonal_factor(rates, p)
    factor = safe_div(F.col("y1_rate"), F.col("y1_prev_rate"))
    return m.join(s, "college_id", "left").select(
        "college_id",
        F.coalesce(F.try_multiply(F.col("momentum_rate"), factor), F.col("momentum_rate")).alias("completion_rate"),
        "avg_full_month",
    )


# ---- M17: per-tenant monthly trend ---------------------------------------

def tenant_trend(wh: Warehouse, p: Period, months: int = 14, college_id=None, rollup=None) -> DataFrame:
    """(college_id, month, new_enrol, pauses, archives) since as_of - months.

    Built for every tenant at once; pass ``college_id`` for the one-tenant view.
    """
    monthly = activity_monthly(wh, p.trend_first(months), None, 31, rollup)
    if college_id is not None:
        monthly = monthly.where(F.col("college_id") == F.lit(college_id))
    return monthly.select(
        "college_id", F.date_format("mo", "yyyy-MM").alias("month"),
        F.col("n_enrol").alias("new_enrol"), F.col("n_pause").alias("pauses"), F.col("n_archive").alias("archives"),
    ).orderBy("college_id", "month")
