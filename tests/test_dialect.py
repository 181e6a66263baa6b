"""Dialect points and column helpers on hand-made frames."""
import calendar
from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X
from ledgerlens.functions.periods import Period, add_months


def test_strict_greatest_is_null_with_a_null_input(spark):
    df = spark.createDataFrame([(None, 3.0), (2.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(X.strict_greatest(F.col("a"), F.col("b"))).collect()]
    assert got == [None, 3.0]
    # Spark's own greatest skips NULLs - the reason the helper exists
    assert df.select(F.greatest("a", "b")).first()[0] == 3.0


def test_two_rounding_rules(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double")
    r = df.select(X.sqlround(F.col("x"), 0).alias("a"), X.pyround(F.col("x"), 0).alias("b")).collect()
    assert [x.a for x in r] == [3.0, 4.0, -3.0]
    assert [x.b for x in r] == [2.0, 4.0, -2.0]


def test_safe_div_returns_null_on_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a bigint, b bigint")
    assert [r[0] for r in df.select(X.safe_div(F.col("a"), F.col("b"))).collect()] == [None, 0.25]


def test_count_if_vs_sum_case_on_empty_input(spark):
    df = spark.createDataFrame([], "flag boolean")
    r = df.agg(X.count_if(F.col("flag")).alias("c"), F.sum(F.when(F.col("flag"), 1).otherwise(0)).alias("s")).first()
    assert r.c == 0 and r.s is None


def test_three_valued_flags(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert df.where(X.is_true("f")).count() == 1
    assert df.where(X.is_false("f")).count() == 1


def test_distinct_from_keeps_null(spark):
    df = spark.createDataFrame([("STUDYTRACK",), ("DEGREE",), (None,)], "c string")
    assert sorted(str(r.c) for r in df.where(X.distinct_from("c", "STUDYTRACK")).collect()) == ["DEGREE", "None"]


def test_sum_known(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (None, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(X.sum_known(F.col("a"), F.col("b"))).collect()] == [None, 1.0, 0.0]


def test_add_months_clips_to_month_end():
    assert add_months(date(2026, 5, 31), -3) == date(2026, 2, 28)
    assert add_months(date(2000, 3, 31), -1) == date(2000, 2, 29)
    assert add_months(date(2000, 1, 15), -18) == date(1998, 7, 15)


@settings(max_examples=200, deadline=None)
@given(st.integers(1990, 2030), st.integers(1, 12), st.integers(1, 31), st.booleans())
def test_capped_prior_days(y, m, d, current):
    first = date(y, m, 1)
    last_day = calendar.monthrange(y, m)[1]
    as_of = date(y, m, min(d, last_day)) if current else add_months(first, 1)
    p = Period(first, as_of)
    assert p.is_current == current
    assert p.today_day == (min(d, last_day) if current else last_day)
    for cap, month_first in ((p.m1_cap, p.m1_first), (p.y1_cap, p.y1_first)):
        assert (cap.year, cap.month) == (month_first.year, month_first.month)
        assert cap.day == min(p.today_day, calendar.monthrange(cap.year, cap.month)[1])
    assert p.m1_last == date(p.m1_first.year, p.m1_first.month,
                             calendar.monthrange(p.m1_first.year, p.m1_first.month)[1])
    assert (p.last - p.refund_window_first).days == 30
