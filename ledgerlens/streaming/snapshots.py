"""Stored metric results and their scheduled refresh: S07-S10.

The reference has no streams; freshness comes from a batch job that
recomputes stale metric results on a schedule and from pages that read
stored results. Here each write of a result is a new parquet folder under
``data/metric=<name>/month=<yyyy-mm>`` in the session's shared checkpoint
folder, and a manifest records each write with the list of its files. Reads go
through the manifest: a result younger than its TTL, whose folder still lists
exactly the recorded files, is read back; anything else is recomputed and
stored. Replaced folders are removed once no reader can still be on them, and
the manifest is compacted, so a store's size doesn't grow with the number of
refreshes. Time is passed in (``now``), never read from the clock inside the
logic, so tests control ages exactly.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

MANIFEST_SCHEMA = ("key string, refreshed_at timestamp_ntz, row_count bigint, path string, written bigint, "
                   "files array<struct<name: string, length: bigint, modified: bigint, checksum: string>>")
MANIFEST_FILES = 8      # more are compacted to one
KEPT_HOURS = 2.0        # a replaced result stays so long for readers that are still on it
AT_ONCE = 12            # stale results recomputed at a time

# Time-to-live rules in hours.
TTL_LIVE = 1.0          # current-month activity, current active base
TTL_DAILY = 24.0        # everything that moves with daily enrolments
TTL_WEEKLY = 168.0      # tenant list and pricing configuration
TTL_FROZEN = 720.0      # prior periods, past-month active base, lead workload


def default_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-snapshots"


class Files:
    """The store's files, by the cluster's own file system: any that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def list(self, path: str) -> list[Row]:
        """Result files of a folder by name; empty if there is no such folder."""
        at, out = self.hadoop.Path(path), []
        if not self.fs.exists(at):
            return out
        for f in self.fs.listStatus(at):
            name = f.getPath().getName()
            if f.isFile() and not name.startswith(("_", ".")):
                sum_ = self.fs.getFileChecksum(f.getPath())         # none where the file system keeps none
                out.append(Row(name=name, length=f.getLen(), modified=f.getModificationTime(), checksum=sum_.toString() if sum_ else None))
        return sorted(out)

    def remove(self, path: str) -> None:
        self.fs.delete(self.hadoop.Path(path), True)


@dataclass
class SnapshotStore:
    spark: SparkSession
    root: str
    # Results written in the current refresh run, not yet in the manifest.
    pending: dict = field(default_factory=dict)
    last_error: str | None = None

    @classmethod
    def for_session(cls, spark: SparkSession) -> "SnapshotStore":
        return cls(spark, default_root(spark))

    # ---- paths -----------------------------------------------------------
    def new_path(self, key: str) -> str:
        """A folder that no result was written to before: a write never touches what readers may be using."""
        month = re.fullmatch(r"(.+)_(\d{4})_(\d{2})((?:_\d+)?)", key)
        where = f"metric={month[1]}/month={month[2]}-{month[3]}{month[4].replace('_', '-')}" if month else f"metric={key}/month=all"
        return f"{self.root.rstrip('/')}/data/{where}/{uuid.uuid4().hex}"

    def data_path(self, key: str) -> str | None:
        """Folder of the newest recorded result of ``key``."""
        found = self.latest(key)
        return found.path if found else None

    @property
    def manifest_path(self) -> str:
        return f"{self.root.rstrip('/')}/manifest"

    # ---- S07 ---------------------------------------------------------------
    def write(self, key: str, df: DataFrame, now: datetime) -> bool:
        """Store ``df`` under ``key`` and record it; a failure to store is reported, not raised."""
        try:
            self.record([self.write_data(key, df)], now)
            return True
        except Exception as exc:  # noqa: BLE001 - storing is best effort here; `refresh` reports errors in full
            self.last_error = str(exc)
            return False

    def write_data(self, key: str, df: DataFrame) -> "Stored":
        """Write the result files to a new folder, counting rows on the way. Errors of the query or the folder are raised.

        The result replaces the former one when ``record`` names it: until
        then, and if anything fails, the former one stays as it is.
        """
        seen, path = Observation(), self.new_path(key)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return Stored(key, path, seen.get["n"], tuple(Files(self.spark, path).list(path)))

    def record(self, entries: "list[Stored]", now: datetime) -> None:
        """Append manifest rows for stored results (one small write for many keys).

        Data is written before its manifest row: a crash in between leaves an
        unrecorded result, which the next read simply recomputes.
        """
        if entries:
            rows = [(e.key, now, e.rows, e.path, time.time_ns(), list(e.files)) for e in entries]     # `written` orders writes of one `now`
            self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(self.manifest_path)
        for e in entries:
            self.pending.pop(e.key, None)
        if entries:
            self.tidy(now)

    def tidy(self, now: datetime) -> None:
        """Compact the manifest where it has many files, and remove results replaced more than ``KEPT_HOURS`` ago.

        The compacted rows are appended before the files they come from are
        removed: at every moment the manifest names each newest result. A
        folder goes before its row, so that a run that is cut short tries again.
        """
        files = Files(self.spark, self.root)
        old = files.list(self.manifest_path)
        if len(old) <= MANIFEST_FILES:
            return
        rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(*(f"{self.manifest_path}/{f.name}" for f in old)).collect()
        rows = list({r["path"]: r for r in rows}.values())       # one row a stored result: newest and kept ones, not all that ever were
        by_key: dict[str, list[Row]] = {}
        for r in sorted(rows, key=lambda r: (r["refreshed_at"], r["written"])):
            by_key.setdefault(r["key"], []).append(r)
        done = [r for own in by_key.values() for r, follower in zip(own, own[1:]) if follower["refreshed_at"] <= now - timedelta(hours=KEPT_HOURS)]
        for r in done:
            files.remove(r["path"])
        gone = {r["path"] for r in done}
        kept = [r for r in rows if r["path"] not in gone]
        self.spark.createDataFrame(kept, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(self.manifest_path)
        for f in old:
            files.remove(f"{self.manifest_path}/{f.name}")

    def _rows(self) -> DataFrame:
        # asked of the file system first: a read of a path that isn't there is an error in Spark's log, too
        if not Files(self.spark, self.root).list(self.manifest_path):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self.manifest_path)

    def manifest(self) -> DataFrame:
        """Latest write per key: (key, refreshed_at, row_count, path, files)."""
        newest = F.max_by(F.struct("refreshed_at", "row_count", "path", "files"), F.struct("refreshed_at", "written")).alias("top")
        return self._rows().groupBy("key").agg(newest).select("key", "top.*")

    def latest(self, key: str) -> "Stored | None":
        """The newest recorded result of ``key``; of this refresh run, if it has written one."""
        if key in self.pending:
            return self.pending[key]
        row = self.manifest().where(F.col("key") == key).first()
        return Stored(key, row["path"], row["row_count"], tuple(row["files"] or ()), row["refreshed_at"]) if row else None

    def ages(self, now: datetime) -> DataFrame:
        """(key, age_hours) of every stored result."""
        now_ntz = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
        # Both sides are zone-free; casting both the same way keeps the difference exact.
        age = (F.unix_micros(now_ntz.cast("timestamp"))
               - F.unix_micros(F.col("refreshed_at").cast("timestamp"))) / 3.6e9
        return self.manifest().select("key", age.alias("age_hours"))

    # ---- S08 ---------------------------------------------------------------
    def read(self, key: str, max_age_hours: float, now: datetime,
             compute: Callable[[], DataFrame]) -> DataFrame:
        """Stored result if younger than ``max_age_hours`` and whole, else recompute, store and return it."""
        found = self.latest(key)
        if found and (found.refreshed_at is None or now - found.refreshed_at < timedelta(hours=max_age_hours)):
            df = self._intact(found)
            if df is not None:
                return df
        result = compute()
        if self.write(key, result, now):
            return self.spark.read.parquet(self.data_path(key))
        return result

    def _intact(self, found: "Stored") -> DataFrame | None:
        """The stored result, if its folder lists exactly the recorded files, unchanged: no row is read for that.

        A file that is missing, extra, of another length, written again since,
        or of another checksum where the file system keeps checksums, makes
        the result count as damaged.
        """
        try:
            whole = found.files and tuple(map(tuple, Files(self.spark, found.path).list(found.path))) == tuple(map(tuple, found.files))
            return self.spark.read.parquet(found.path) if whole else None
        except Exception:  # noqa: BLE001 - whatever the damage: recompute
            return None


@dataclass(frozen=True)
class Stored:
    """A result that was written: its folder, row count and files; when, if that is recorded."""

    key: str
    path: str
    rows: int
    files: tuple = ()
    refreshed_at: datetime | None = None


# ---- S09 -------------------------------------------------------------------

def stale_keys(ttl: DataFrame, ages: DataFrame, force: bool = False) -> DataFrame:
    """Keys to refresh: never stored, at or past their TTL, or everything when forced.

    ``ttl``: (key, ttl_hours); ``ages``: (key, age_hours).
    """
    j = ttl.join(ages, "key", "left")
    stale = F.col("age_hours").isNull() | (F.col("age_hours") >= F.col("ttl_hours")) | F.lit(force)
    return j.select("key", "ttl_hours", "age_hours", stale.alias("stale"))


# ---- S10 -------------------------------------------------------------------

@dataclass
class Task:
    ttl_hours: float
    compute: Callable[[], DataFrame]
    after: tuple[str, ...] = ()         # keys whose results this one reads


def levels(tasks: dict[str, Task], todo: list[str]) -> list[list[str]]:
    """``todo`` in levels: each key after all keys of ``todo`` that it reads; those of one level don't depend on each other."""
    left, out = list(todo), []
    while left:
        ready = [k for k in left if not set(tasks[k].after) & set(left)]
        if not ready:
            raise ValueError(f"results that read each other: {left}")
        out.append(ready)
        left = [k for k in left if k not in ready]
    return out


def refresh(store: SnapshotStore, tasks: dict[str, Task], now: datetime, force: bool = False,
            at_once: int = AT_ONCE) -> DataFrame:
    """Recompute and store every stale task; returns (key, status, rows, error).

    The list of tasks is a small job list (one row per metric), so choosing
    the stale ones is a driver-side decision over that list; every metric
    itself runs as a Spark job. Results that don't read each other are computed
    ``at_once``, each in a scheduler pool of its own, so one slow metric leaves no
    executor idle. A failing metric does not stop the others; what reads it
    computes it again for itself.
    """
    spark = store.spark
    ttl = spark.createDataFrame([(k, float(t.ttl_hours)) for k, t in tasks.items()], "key string, ttl_hours double")
    stale = {r["key"] for r in stale_keys(ttl, store.ages(now), force).where("stale").select("key").collect()}
    todo = [key for key in tasks if key in stale]
    results, stored = [], []

    def run(key: str):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", key)
        try:
            return key, store.write_data(key, tasks[key].compute()), None
        except Exception as exc:  # noqa: BLE001 - reported per key, in full
            return key, None, str(exc)

    for level in levels(tasks, todo):
        with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(level)))) as pool:
            ended = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), key) for key in level]]
        for key, done, error in ended:
            if done is None:
                results.append((key, "failed", None, error))
                continue
            stored.append(done)
            store.pending[key] = done
            results.append((key, "ok", done.rows, None))
    try:
        store.record(stored, now)
    except Exception as exc:  # noqa: BLE001 - nothing of this run counts as stored
        results = [(k, "not_stored" if st == "ok" else st, n, e or str(exc)) for k, st, n, e in results]
    store.pending.clear()
    for key in sorted(set(tasks) - set(todo)):
        results.append((key, "fresh", None, None))
    return spark.createDataFrame(results, "key string, status string, rows bigint, error string")


def failures(report: DataFrame) -> list[str]:
    """Messages of a refresh run's failures (a job's exit code is 1 if there are any)."""
    bad = report.where(F.col("status").isin("failed", "not_stored")).orderBy("key").collect()
    return [f"{r['key']}: {r['status']}: {r['error']}" for r in bad]


def month_tasks(wh, p, now_is_current: bool | None = None, store: SnapshotStore | None = None,
                now: datetime | None = None) -> dict[str, Task]:
    """The refresh registry of one month (keys carry the period, TTLs follow the source rules).

    With a store, the metrics over many months read closed months from the
    store's rollup, which the run brings up to date first.
    """
    from .rollup import ActivityRollup

    current = p.is_current if now_is_current is None else now_is_current
    rollup = ActivityRollup.for_period(store, wh, p, now) if store is not None and now is not None else None
    tasks = {m.key(p): Task(m.ttl_hours(current), lambda m=m: m.compute(wh, p, rollup=rollup) if m.many_months else m.compute(wh, p)) for m in stored_metrics()}
    daily = TTL_LIVE if current else TTL_DAILY
    tasks[month_report_key(p)] = Task(daily, lambda: _month_report(wh, p, store, now), after=tuple(tasks))
    tasks[overview_key(p)] = Task(daily, lambda: _overview(wh, p, store, now), after=(month_report_key(p),))
    return tasks


@dataclass(frozen=True)
class Metric:
    """A stored metric: how long it keeps, and what of the period its key carries ('', 'month' or 'day')."""

    name: str
    compute: Callable
    ttl: float
    scope: str = "month"
    live: bool = False          # a current month keeps for an hour only
    many_months: bool = False   # takes the rollup of closed months

    def key(self, p) -> str:
        month = f"_{p.first.year}_{p.first.month:02d}"
        return self.name + {"": "", "month": month, "day": f"{month}_{p.today_day}"}[self.scope]

    def ttl_hours(self, current: bool) -> float:
        return TTL_LIVE if self.live and current else self.ttl


def stored_metrics() -> list[Metric]:
    """The registry of one month, by how fast the metrics age."""
    from ..operators import activity as act
    from ..operators import enrolment as enr
    from ..operators import leads as lds
    from ..operators import pricing as prc
    from ..operators import revenue_share as rsh
    from ..sources import dims

    return [
        Metric("activity_counts_month", act.activity_counts_month, TTL_LIVE),
        Metric("completion_rates", act.completion_rates, TTL_DAILY, "day", many_months=True),
        Metric("conversion_admission_counts", enr.conversion_admission_counts, TTL_DAILY),
        Metric("exemption_counts", enr.exemption_counts, TTL_DAILY),
        Metric("expected_share_revenue", rsh.expected_share_revenue, TTL_DAILY),
        Metric("featured_course_counts", lambda wh, p: enr.featured_course_counts(wh, p, dims.featured_courses(wh)), TTL_DAILY),
        Metric("lead_counts", lds.lead_counts, TTL_DAILY),
        Metric("refund_window_archives", enr.refund_window_archives, TTL_DAILY),
        Metric("rpl_admissions", enr.rpl_admissions, TTL_DAILY),
        Metric("seat_expected_revenue", prc.seat_expected_revenue, TTL_DAILY),
        Metric("pricing_config", lambda wh, p: prc.pricing_config(wh), TTL_WEEKLY, ""),
        Metric("verified_tenants", lambda wh, p: enr.verified_tenants(wh), TTL_WEEKLY, ""),
        Metric("active_base", enr.active_base, TTL_FROZEN, "month", live=True),
        Metric("activity_counts_prior", act.activity_counts_prior, TTL_FROZEN, "day", many_months=True),
        Metric("lead_workload", lds.lead_workload, TTL_FROZEN),
    ]


def overview_key(p) -> str:
    return f"overview_base_{p.first.year}_{p.first.month:02d}_{p.today_day}"


def _overview(wh, p, store: SnapshotStore | None, now: datetime | None):
    from ..plans.overview import overview_base

    report = stored_month_report(store, wh, p, now) if store is not None and now is not None else None
    return overview_base(wh, p, report=report)


def stored_overview(store: SnapshotStore, wh, p, now: datetime) -> DataFrame:
    """The per-tenant page base (R01 + extras + R06-R10) as the pages read it."""
    ttl = TTL_LIVE if p.is_current else TTL_DAILY
    return store.read(overview_key(p), ttl, now, lambda: _overview(wh, p, store, now))


def month_report_key(p) -> str:
    return f"tenant_month_report_{p.first.year}_{p.first.month:02d}_{p.today_day}"


def _month_report(wh, p, store: SnapshotStore | None = None, now: datetime | None = None):
    """R01; with a store, from the stored metrics, each recomputed only where it is missing, too old or damaged."""
    from ..plans.month_report import tenant_month_report

    if store is None or now is None:
        return tenant_month_report(wh, p)
    metrics = {m.name: m for m in stored_metrics()}

    def stored(name: str) -> DataFrame:
        m = metrics[name]
        return store.read(m.key(p), m.ttl_hours(p.is_current), now, lambda: m.compute(wh, p))

    return tenant_month_report(wh, p, stored=stored)


def stored_month_report(store: SnapshotStore, wh, p, now: datetime) -> DataFrame:
    """R01 as the pages read it: the stored result when fresh, else computed and stored."""
    ttl = TTL_LIVE if p.is_current else TTL_DAILY
    return store.read(month_report_key(p), ttl, now, lambda: _month_report(wh, p, store, now))
