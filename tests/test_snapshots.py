"""S07-S10 with a controlled clock."""
import os
import tempfile
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming import snapshots as snap

NOW = datetime(2000, 7, 15, 12, 0, 0)


def _store(spark):
    return snap.SnapshotStore(spark, tempfile.mkdtemp(prefix="snap-", dir="/tmp"))


def test_write_then_fresh_read_does_not_recompute(spark):
    store = _store(spark)
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)

    assert store.read("k", 1.0, NOW, compute).count() == 5
    assert store.read("k", 1.0, NOW + timedelta(minutes=30), compute).count() == 5
    assert len(calls) == 1
    # older than the TTL -> recomputed
    store.read("k", 1.0, NOW + timedelta(hours=2), compute)
    assert len(calls) == 2


def test_corrupt_entry_is_recomputed(spark):
    store = _store(spark)
    store.write("k", spark.range(3), NOW)
    path = store.data_path("k")
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            with open(os.path.join(path, name), "wb") as fh:
                fh.write(b"not parquet")
    got = store.read("k", 24.0, NOW, lambda: spark.range(7))
    assert got.count() == 7


def test_one_damaged_file_of_several_is_recomputed(spark):
    store = _store(spark)
    store.write("k", spark.range(100).repartition(4), NOW)
    path = store.data_path("k")
    victim = sorted(n for n in os.listdir(path) if n.endswith(".parquet"))[-1]
    with open(os.path.join(path, victim), "r+b") as fh:
        fh.seek(4)
        fh.write(b"\xff" * 24)
    assert store.read("k", 24.0, NOW, lambda: spark.range(7)).count() == 7


def test_a_failed_write_keeps_the_old_result(spark):
    store = _store(spark)
    assert store.write("k", spark.range(3), NOW)
    bad = spark.range(1).select(F.raise_error(F.lit("boom")).alias("id"))
    assert not store.write("k", bad, NOW + timedelta(hours=1)) and "boom" in store.last_error
    assert store.read("k", 24.0, NOW + timedelta(hours=2), lambda: spark.range(9)).count() == 3


def test_failure_to_store_is_not_fatal(spark):
    store = snap.SnapshotStore(spark, "/proc/ledgerlens-cannot-write")
    assert store.write("k", spark.range(2), NOW) is False
    assert store.read("k", 1.0, NOW, lambda: spark.range(2)).count() == 2


def test_stale_keys_fixture(spark):
    rows = [("activity_counts_month", 1.0, 0.5), ("active_base", 1.0, 1.0), ("pricing_config", 168.0, 200.0),
            ("completion_rates", 24.0, 3.0), ("lead_workload", 720.0, None)]
    m = spark.createDataFrame(rows, "metric string, ttl_hours double, age_hours double").withColumnRenamed("metric", "key")
    out = snap.stale_keys(m.select("key", "ttl_hours"), m.select("key", "age_hours").where(F.col("age_hours").isNotNull()))
    assert {r.key for r in out.where("stale").collect()} == {"active_base", "pricing_config", "lead_workload"}
    forced = snap.stale_keys(m.select("key", "ttl_hours"), m.select("key", "age_hours"), force=True)
    assert forced.where("stale").count() == 5


def test_refresh_reports_each_key(spark):
    store = _store(spark)
    tasks = {"ok": snap.Task(24.0, lambda: spark.range(4)),
             "bad": snap.Task(24.0, lambda: spark.range(1).select(F.raise_error(F.lit("boom")).alias("x")))}
    report = snap.refresh(store, tasks, NOW)
    assert len(snap.failures(report)) == 1 and "boom" in snap.failures(report)[0]
    res = {r.key: (r.status, r.rows) for r in report.collect()}
    assert res["ok"] == ("ok", 4)
    assert res["bad"][0] == "failed"
    again = {r.key: r.status for r in snap.refresh(store, tasks, NOW + timedelta(hours=1)).collect()}
    assert again["ok"] == "fresh"


def test_month_refresh_then_pages_from_store_match_fresh_pages(spark, wh_small):
    from ledgerlens.plans import overview as ov
    from ledgerlens.plans.catalog import PAST

    store = _store(spark)
    tasks = snap.month_tasks(wh_small, PAST, store=store, now=NOW)
    status = {r.key: r.status for r in snap.refresh(store, tasks, NOW).collect()}
    assert set(status.values()) == {"ok"} and len(status) == len(tasks)
    stored = snap.stored_overview(store, wh_small, PAST, NOW)
    fresh = ov.overview_base(wh_small, PAST)
    for page in (ov.seat_overview, ov.share_overview_total, ov.enrolment_overview_share):
        a = sorted(map(tuple, page(stored).collect()), key=repr)
        b = sorted(map(tuple, page(fresh).collect()), key=repr)
        assert a == b, page.__name__
    # a second run an hour later finds everything fresh except the 1-hour entries
    again = {r.key: r.status for r in snap.refresh(store, tasks, NOW + timedelta(hours=2)).collect()}
    assert again["verified_tenants"] == "fresh"
    assert again["activity_counts_month_2000_06"] == "ok"


def test_independent_results_are_computed_at_once_and_readers_after_them(spark):
    store, met, order = _store(spark), threading.Barrier(2, timeout=60), []

    def meet(n):
        met.wait()                  # comes back only if the other one is running, too
        order.append(n)
        return spark.range(n)

    tasks = {"sum": snap.Task(24.0, lambda: order.append("sum") or store.read("a", 1.0, NOW, lambda: 1 / 0).unionByName(store.read("b", 1.0, NOW, lambda: 1 / 0)), after=("a", "b")),
             "a": snap.Task(24.0, lambda: meet(3)), "b": snap.Task(24.0, lambda: meet(4))}
    res = {r.key: (r.status, r.rows) for r in snap.refresh(store, tasks, NOW).collect()}
    assert res == {"a": ("ok", 3), "b": ("ok", 4), "sum": ("ok", 7)} and order[-1] == "sum"


def test_results_that_read_each_other_are_an_error():
    tasks = {k: snap.Task(1.0, lambda: None, after=(other,)) for k, other in (("a", "b"), ("b", "a"))}
    with pytest.raises(ValueError):
        snap.levels(tasks, ["a", "b"])
    assert snap.levels(tasks, ["a"]) == [["a"]]


@pytest.mark.parametrize("harm", ["missing", "extra", "shorter", "same length"])
def test_damage_is_seen_without_reading_rows(spark, harm):
    store = _store(spark)
    store.write("k", spark.range(100).repartition(4), NOW)
    path = store.data_path("k")
    victim = os.path.join(path, sorted(n for n in os.listdir(path) if n.endswith(".parquet"))[1])
    assert store._intact(store.latest("k")) is not None
    if harm == "missing":
        os.remove(victim)
    elif harm == "extra":
        with open(victim, "rb") as src, open(os.path.join(path, "part-extra.parquet"), "wb") as dst:
            dst.write(src.read())
    else:
        with open(victim, "r+b") as fh:
            fh.write(b"\xff" * 4)
            if harm == "shorter":
                fh.truncate(20)
    found = store.latest("k")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert store._intact(found) is None
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert store.read("k", 24.0, NOW, lambda: spark.range(7)).count() == 7


def test_many_refreshes_leave_a_bounded_number_of_files(spark):
    store, counts = _store(spark), []
    for k in range(24):
        at = NOW + timedelta(hours=3 * k)
        assert store.write("metric_2000_06", spark.range(k + 1).coalesce(1), at)
        folder = os.path.join(store.root, "data/metric=metric/month=2000-06")
        counts.append((len(os.listdir(folder)), len([n for n in os.listdir(store.manifest_path) if n.endswith(".parquet")])))
        assert store.read("metric_2000_06", 1.0, at, lambda: 1 / 0).count() == k + 1
    assert max(c for c, _ in counts) <= 2 * snap.MANIFEST_FILES + 2 and max(m for _, m in counts) <= snap.MANIFEST_FILES + 1


def test_a_replaced_result_stays_for_its_readers(spark):
    store = _store(spark)
    store.write("k", spark.range(5), NOW)
    held = store.read("k", 24.0, NOW, lambda: 1 / 0)
    for k in range(2 * snap.MANIFEST_FILES):
        store.write("k", spark.range(9), NOW + timedelta(minutes=1))
    assert held.count() == 5


def test_layout_names_metric_and_month(spark):
    store = _store(spark)
    for key, where in (("active_base_2000_06", "metric=active_base/month=2000-06"), ("completion_rates_2000_06_30", "metric=completion_rates/month=2000-06-30"),
                       ("pricing_config", "metric=pricing_config/month=all")):
        assert f"/data/{where}/" in store.new_path(key)
