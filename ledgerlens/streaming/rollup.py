"""Incremental monthly rollup of the activity events, for M03, M14a-d, M14 and M17.

These metrics count events over 12 to 18 months, of which all but the last are
closed: nothing more happens in them. A closed month is reduced once to a row
for each tenant, with its counts by day of the month (at most 31 entries), and
stored in the snapshot store; later runs read those rows and scan events of the
open months only.

Late events are noticed without a scan. Each stored month is recorded with the
number of events that it counts; where the event table is laid out by month,
that number is compared with the month's row count, which Spark takes from the
file footers. A month whose count moved, whose files are damaged, or that is
named in ``rebuild`` is reduced again; the others stay as they are. What this
can't see is a change that keeps the number of a month's events, and any change
in a table without month layout: name such months in ``rebuild``.

Events without a time belong to no month. A tenant id that is null is a tenant
of its own, as in the metrics.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, day
from ..functions.periods import Period, add_months, lit_date, month_last
from ..operators.activity import ARCHIVE, ENROL, PAUSE
from ..sources.warehouse import Warehouse, month_column
from .snapshots import Files, SnapshotStore, Stored

KEY = "activity_rollup"
EVENTS = "activities"


def month_key(mo: date) -> str:
    return f"{KEY}_{mo.year}_{mo.month:02d}"


def months_between(lo: date, hi: date) -> list[date]:
    """First days of the months from that of ``lo`` to that of ``hi``, both included."""
    out, mo = [], lo.replace(day=1)
    while mo <= hi:
        out.append(mo)
        mo = add_months(mo, 1)
    return out


def reduce_months(wh: Warehouse, lo: date, hi: date | None, months: list[date] | None = None) -> DataFrame:
    """(college_id, mo, days) of the events in [lo, hi]: counts by day of the month, as (dom, n_enrol, n_pause, n_archive, n_events).

    ``months`` keeps only those months. Events are counted by (tenant, day)
    on the map side first, so a shuffle carries tenants x days rows.
    """
    events, d = wh.slice(EVENTS, lo, hi), day("created")
    if months is not None:
        events = events.where(F.trunc(d, "MM").isin([lit_date(m) for m in months]))
    kind = F.col("kind")
    daily = events.groupBy("college_id", F.trunc(d, "MM").alias("mo"), F.dayofmonth(d).alias("dom")).agg(
        count_if(kind == ENROL).alias("n_enrol"), count_if(kind == PAUSE).alias("n_pause"),
        count_if(kind == ARCHIVE).alias("n_archive"), F.count(F.lit(1)).alias("n_events"))
    entry = F.struct("dom", "n_enrol", "n_pause", "n_archive", "n_events")
    return daily.groupBy("college_id", "mo").agg(F.sort_array(F.collect_list(entry)).alias("days"))


@dataclass
class ActivityRollup:
    """Closed months from the store, open ones from the events.

    ``closed_before``: first day of the first open month. One object serves
    one run: each month is checked once, whichever metrics read it.
    """

    store: SnapshotStore
    wh: Warehouse
    now: datetime
    closed_before: date
    rebuild: tuple[date, ...] = ()
    built: list[date] = field(default_factory=list)             # months reduced by this object, for reports and tests
    _ready: dict[date, Stored] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    @classmethod
    def for_period(cls, store: SnapshotStore, wh: Warehouse, p: Period, now: datetime, rebuild: tuple[date, ...] = ()) -> "ActivityRollup":
        return cls(store, wh, now, p.as_of.replace(day=1), rebuild)

    def months(self, lo: date, hi: date | None = None) -> DataFrame:
        """(college_id, mo, days) of the months that [lo, hi] touches (``hi`` None: open), a row for each tenant with events.

        The first and the last month are whole: whoever reads them bounds the days.
        """
        lo = lo.replace(day=1)
        last = add_months(self.closed_before, -1)
        closed = months_between(lo, last if hi is None else min(hi, last))
        live = None
        if hi is None or hi >= self.closed_before:
            live = reduce_months(self.wh, max(lo, self.closed_before), None if hi is None else month_last(hi.replace(day=1)))
        paths = [s.path for s in self.ensure(closed) if s.rows]
        if not paths:
            return live if live is not None else reduce_months(self.wh, lo, lo).where(F.lit(False))
        stored = self.store.spark.read.parquet(*paths).select("college_id", "mo", "days")
        return stored if live is None else stored.unionByName(live)

    def ensure(self, months: list[date]) -> list[Stored]:
        """Each of these closed months as stored, reduced now where it is missing, damaged, late or named in ``rebuild``."""
        with self._lock:
            todo = [m for m in months if m not in self._ready]
            if todo:
                found, counts, files = self._recorded(todo), self._counts(todo), Files(self.store.spark, self.store.root)
                stale = []
                for m in todo:
                    s = found.get(m)
                    whole = s is not None and m not in self.rebuild and tuple(map(tuple, files.list(s.path))) == tuple(map(tuple, s.files))
                    if whole and (counts is None or counts.get(m, 0) == s.rows):
                        self._ready[m] = s
                    else:
                        stale.append(m)
                if stale:
                    self._reduce(stale)
            return [self._ready[m] for m in months]

    def _recorded(self, months: list[date]) -> dict[date, Stored]:
        by_key = {month_key(m): m for m in months}
        rows = self.store.manifest().where(F.col("key").isin(list(by_key))).collect()         # at most one a month
        return {by_key[r["key"]]: Stored(r["key"], r["path"], r["row_count"], tuple(r["files"] or ()), r["refreshed_at"]) for r in rows}

    def _counts(self, months: list[date]) -> dict[date, int] | None:
        """Number of events of each month, from partition values and file footers; None where the table has no month layout."""
        events, mo = self.wh.raw(EVENTS), month_column(EVENTS)
        if mo not in events.columns:
            return None
        rows = events.where(F.col(mo).isin([lit_date(m) for m in months])).groupBy(mo).count().collect()
        return {r[mo]: r["count"] for r in rows}

    def _reduce(self, months: list[date]) -> None:
        """Reduce months in one pass, write each to a folder of its own, and record them with the number of events they count."""
        spark, path = self.store.spark, self.store.new_path(KEY)
        rolled = reduce_months(self.wh, min(months), month_last(max(months)), months)
        # a month's rows together, split where they are many: few files, none of them large
        (rolled.withColumn("part", F.col("mo").cast("string")).hint("rebalance", "part")
         .write.partitionBy("part").parquet(path))
        events = F.aggregate("days", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n_events"])
        # the schema is given: months without any event leave a folder without files
        written = spark.read.schema("mo date, days array<struct<n_events: bigint>>").parquet(path)
        counted = {r["mo"]: r["n"] for r in written.groupBy("mo").agg(F.sum(events).alias("n")).collect()}
        files = Files(spark, self.store.root)
        entries = []
        for m in months:
            folder = f"{path}/part={m.isoformat()}"
            entries.append(Stored(month_key(m), folder, counted.get(m, 0), tuple(files.list(folder)), self.now))
        self.store.record(entries, self.now)
        self._ready.update(zip(months, entries))
        self.built += months
