"""The incremental monthly rollup: equal to the full scan, built once, rebuilt where events came late."""
import os
import tempfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.periods import Period
from ledgerlens.operators import activity as act
from ledgerlens.plans.catalog import CURRENT, PAST
from ledgerlens.sources.warehouse import Warehouse, month_column
from ledgerlens.streaming import snapshots as snap
from ledgerlens.streaming.rollup import ActivityRollup, months_between

NOW = datetime(2000, 6, 17, 12)
SCHEMA = "user_id bigint, college_id bigint, degree_id bigint, kind string, created timestamp_ntz"


def _store(spark):
    return snap.SnapshotStore(spark, tempfile.mkdtemp(prefix="rollup-", dir="/tmp"))


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def _metrics(wh, p, rollup=None):
    kw = {} if rollup is None else {"rollup": rollup}
    return [act.monthly_mtd_history(wh, p, **kw), act.completion_rates(wh, p, **kw), act.activity_counts_prior(wh, p, **kw),
            act.tenant_trend(wh, p, **kw), act.month_report_activity(wh, p, **kw)]


def _event(day, college=1, kind=act.ENROL):
    return (1, college, 1, kind, day and datetime.fromisoformat(day))


def _laid_out(spark, events, root=None):
    """Events as a folder laid out by month, and the warehouse over it."""
    root = root or tempfile.mkdtemp(prefix="events-", dir="/tmp")
    df = spark.createDataFrame(events, SCHEMA)
    df.withColumn(month_column("activities"), F.trunc("created", "MM")).write.mode("append").partitionBy(month_column("activities")).parquet(root)
    return root, Warehouse.from_tables(spark, {"activities": spark.read.parquet(root)})


def _same(wh, p, rollup):
    for plain, rolled in zip(_metrics(wh, p), _metrics(wh, p, rollup)):
        assert plain.columns == rolled.columns
        assert dict(plain.dtypes) == dict(rolled.dtypes)
        assert _rows(rolled) == _rows(plain)


@pytest.mark.parametrize("p", [PAST, CURRENT], ids=["past", "current"])
def test_metrics_equal_the_full_scan(spark, wh_small, p):
    store = _store(spark)
    first = ActivityRollup.for_period(store, wh_small, p, NOW)
    _same(wh_small, p, first)
    assert first.built and max(first.built) < first.closed_before
    again = ActivityRollup.for_period(store, wh_small, p, NOW)
    _same(wh_small, p, again)
    assert again.built == []                        # every closed month was stored before


def test_a_month_with_late_events_is_reduced_again_and_no_other(spark):
    events = [_event(f"2000-{m:02d}-{d:02d}") for m in (1, 2, 3, 4, 5, 6) for d in (3, 14, 20)]
    root, wh = _laid_out(spark, events)
    store = _store(spark)
    ActivityRollup.for_period(store, wh, CURRENT, NOW).months(date(2000, 1, 1)).collect()
    _, wh = _laid_out(spark, [_event("2000-03-09"), _event("2000-03-25", college=2, kind=act.PAUSE)], root)
    late = ActivityRollup.for_period(store, wh, CURRENT, NOW)
    _same(wh, CURRENT, late)
    assert late.built.count(date(2000, 3, 1)) == 1 and date(2000, 2, 1) not in late.built
    march = {r["college_id"]: r for r in act.tenant_trend(wh, CURRENT, rollup=late).where("month = '2000-03'").collect()}
    assert march[1]["new_enrol"] == 4 and march[2]["pauses"] == 1


def test_only_open_months_are_scanned(spark, wh_small):
    store = _store(spark)
    ActivityRollup.for_period(store, wh_small, CURRENT, NOW).months(CURRENT.history_first).collect()
    rollup = ActivityRollup.for_period(store, wh_small, CURRENT, NOW)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        history = act.monthly_mtd_history(wh_small, CURRENT, rollup=rollup)._jdf.queryExecution().explainString(mode)
        report = act.month_report_activity(wh_small, CURRENT, rollup=rollup)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "/activities" not in history and "Exchange" not in history       # closed months alone: no event, no shuffle
    of_events = [line for line in report.splitlines() if "PartitionFilters" in line and "created_month" in line]
    assert len(of_events) == 1 and "2000-06-01" in of_events[0] and "1998" not in of_events[0]


def test_a_damaged_month_is_reduced_again(spark):
    _, wh = _laid_out(spark, [_event("2000-04-03"), _event("2000-05-04")])
    store = _store(spark)
    ActivityRollup.for_period(store, wh, CURRENT, NOW).months(date(2000, 4, 1)).collect()
    path = store.data_path("activity_rollup_2000_04")
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            with open(os.path.join(path, name), "ab") as fh:
                fh.write(b"more")
    rollup = ActivityRollup.for_period(store, wh, CURRENT, NOW)
    assert rollup.months(date(2000, 4, 1)).count() == 2
    assert rollup.built == [date(2000, 4, 1)]


def test_empty_tables_empty_months_and_odd_events(spark):
    # no event at all; then a null tenant, an event without a time, a kind that isn't counted
    empty = Warehouse.from_tables(spark, {"activities": spark.createDataFrame([], SCHEMA)})
    for df in _metrics(empty, CURRENT, ActivityRollup.for_period(_store(spark), empty, CURRENT, NOW)):
        assert df.collect() == []
    _, wh = _laid_out(spark, [_event("2000-05-03", college=None), _event(None), _event("2000-03-02", college=7, kind="graduateDegreeStudent"),
                              _event("2000-05-31", college=7), _event("1999-06-30", college=7, kind=act.ARCHIVE)])
    store = _store(spark)
    _same(wh, CURRENT, ActivityRollup.for_period(store, wh, CURRENT, NOW))
    again = ActivityRollup.for_period(store, wh, CURRENT, NOW)
    _same(wh, CURRENT, again)
    assert again.built == []                        # months without events are known to have none


def test_without_a_month_layout_a_month_is_rebuilt_by_name(spark):
    store, early, more = _store(spark), [_event("2000-05-03")], [_event("2000-05-03"), _event("2000-05-09")]
    flat = lambda ev: Warehouse.from_tables(spark, {"activities": spark.createDataFrame(ev, SCHEMA)})
    ActivityRollup.for_period(store, flat(early), CURRENT, NOW).months(date(2000, 5, 1)).collect()
    wh = flat(more)
    named = ActivityRollup.for_period(store, wh, CURRENT, NOW, rebuild=(date(2000, 5, 1),))
    _same(wh, CURRENT, named)
    assert date(2000, 5, 1) in named.built


def test_a_month_that_closes_joins_the_stored_ones(spark):
    _, wh = _laid_out(spark, [_event("2000-05-03"), _event("2000-06-03")])
    store, july = _store(spark), Period(date(2000, 7, 1), date(2000, 7, 5))
    ActivityRollup.for_period(store, wh, CURRENT, NOW).months(date(2000, 5, 1)).collect()
    rollup = ActivityRollup.for_period(store, wh, july, NOW)
    rollup.months(date(2000, 5, 1)).collect()
    assert rollup.built == [date(2000, 6, 1)]


def test_months_between():
    assert months_between(date(1999, 11, 20), date(2000, 1, 1)) == [date(1999, 11, 1), date(1999, 12, 1), date(2000, 1, 1)]
    assert months_between(date(2000, 2, 1), date(2000, 1, 31)) == []
