"""Physical-plan checks: pushed filters, one activities scan per report, no Python in the plan."""
import collections
import re

from ledgerlens.operators import activity as act
from ledgerlens.plans.catalog import PAST
from ledgerlens.plans.month_report import tenant_month_report


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_date_filter_reaches_the_scan(spark, wh_small):
    text = _formatted(spark, act.activity_counts_month(wh_small, PAST))
    pushed = " ".join(line for line in text.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(created,2000-06-01T00:00)" in pushed
    assert "LessThan(created,2000-07-01T00:00)" in pushed
    assert "In(kind" in pushed


def test_point_in_time_bound_reaches_the_scan(spark, wh_small):
    from ledgerlens.operators.enrolment import active_base

    text = _formatted(spark, active_base(wh_small, PAST))
    pushed = " ".join(line for line in text.splitlines() if "PushedFilters" in line)
    assert "LessThan(created,2000-07-01T00:00)" in pushed


def test_scan_reads_only_needed_columns(spark, wh_small):
    text = _formatted(spark, act.activity_counts_month(wh_small, PAST))
    schemas = [line for line in text.splitlines() if "ReadSchema" in line]
    assert schemas and all("user_id" not in line for line in schemas)


def test_top4_uses_window_group_limit(wh_small):
    rates = act.mtd_rates(act.monthly_mtd_history(wh_small, PAST))
    assert "WindowGroupLimit" in _plan(act.momentum_last4(rates))


def test_report_has_no_python_udf(wh_small):
    plan = _plan(tenant_month_report(wh_small, PAST))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan


def test_report_scans_activities_once(spark, wh_small):
    df = tenant_month_report(wh_small, PAST)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")     # else long locations are cut, and not counted
    try:
        plan = _plan(df)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    locations = re.findall(r"Location: [^\[]*\[[^\]]*/([a-z_]+)(?:\.parquet)?\]", plan)
    assert len(locations) == len(re.findall(r"FileScan parquet", plan))
    scans = collections.Counter(locations)
    assert scans["activities"] == 1           # M02, M03, M14 from one bounded rollup
    assert scans["degree_students"] == 4      # enrolment pass, month slice (M09e) with its overrides' ids, ids (M11)
    assert scans["purchases"] == 1            # one pass for M09c and M09d


def test_report_has_no_cartesian_product(wh_small):
    plan = _plan(tenant_month_report(wh_small, PAST))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_month_partitions_are_pruned(spark, wh_small):
    from ledgerlens.operators.enrolment import refund_window_archives

    text = _formatted(spark, act.activity_counts_month(wh_small, PAST))
    parts = " ".join(line for line in text.splitlines() if "PartitionFilters" in line)
    assert "created_month" in parts and "2000-06-01" in parts
    text = _formatted(spark, refund_window_archives(wh_small, PAST))
    parts = " ".join(line for line in text.splitlines() if "PartitionFilters" in line)
    assert "2000-05-01" in parts and "2000-06-01" in parts


def test_public_schema_has_no_partition_column(wh_small):
    for name in ("activities", "degree_students", "purchases"):
        assert not any(c.endswith("_month") for c in wh_small.table(name).columns)
