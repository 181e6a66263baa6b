"""S01 table binding: the named tables every metric reads.

The metric layer is written against the operational schema of an enrolment
platform (tenants, enrolments, activity events, contract phases, prices,
purchases, invoices). ``Warehouse`` binds each of those names to a
DataFrame. Two bindings exist:

* ``Warehouse.from_tables(spark, {...})`` - bind real tables (catalog
  tables, parquet folders, JDBC reads) one to one;
* ``Warehouse.from_testdata(spark, sf_dir)`` - derive every table from the
  TPC-H-shaped test parquet files with the recipes of FIXTURES.md. The
  derivations are ordinary DataFrame plans, so Catalyst pushes the metric
  filters down through them into the parquet scans.

Every table is built lazily and memoised per instance, so one report plan
reuses the same logical subtree (and Spark reuses the exchange). A warehouse
that keeps its tables (``keep_by``) also stores each one when it is first asked
for: what nothing asks for is neither derived nor written.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import midnight
from ..functions.periods import lit_date

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
)

# Service kinds and their ids, as in the fixture recipe.
SERVICE_KINDS = [
    (0, "SEAT"), (1, "SEAT_OVERAGE"), (2, "AIRLOCK"), (3, "EXEMPTION"), (4, "IMPORT"),
    (5, "PBA"), (6, "RPL"), (7, "ENROLLMENT"), (8, "MIN_REV_SHARE"),
]

# Invoice kinds and their id offsets, as in the fixture recipe.
INVOICE_KINDS = [(0, "MONTHLY"), (1, "QUARTERLY")]

# Custom price lines put on every invoice by the fixture recipe.
CUSTOM_PRICE_LINES = [
    ("Historical SAAS", 1, "fee"),
    ("Prepaid Seats Q2", 12, "fee"),
    ("Carry-over", 2, "charge"),
]


def _days_after(start: str, n: Column) -> Column:
    """Timestamp (NTZ, midnight) ``n`` days after the date ``start``."""
    return F.date_add(F.lit(start).cast("date"), n.cast("int")).cast("timestamp_ntz")


def _plus_days(ts: Column, days: int) -> Column:
    return ts + F.expr(f"INTERVAL {days} DAYS")


def _int_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# Side dimensions that a warehouse may bind by name.
SIDE_TABLES = ("projections", "fees", "squads", "short_names", "featured_courses")


def _unbound(name: str) -> DataFrame:
    raise KeyError(f"table {name!r} is not bound")


class Warehouse:
    """Named DataFrames for one data set."""

    def __init__(self, spark: SparkSession, loader):
        self.spark = spark
        self._loader = loader
        self._bound: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}
        self._builders: dict[str, Callable] = {}        # views that are materialised when asked for
        self._keep: Callable[[str, Callable[[str], None]], DataFrame] | None = None
        self._locks: dict[str, threading.RLock] = {}
        self._sides: dict[str, DataFrame] = {}     # S02-S06 by name
        self.tag = "default"       # names this data set in shared folders

    # ---- construction -------------------------------------------------
    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        sf_dir = sf_dir.rstrip("/")

        def load(name: str) -> DataFrame:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")

        return cls(spark, load)

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> "Warehouse":
        """Bind operational tables, and side dimensions (S02-S06) among them, directly by name; a table that is missing raises ``KeyError``."""
        wh = cls(spark, _unbound)
        wh._bound.update({k: t for k, t in tables.items() if k not in SIDE_TABLES})
        wh.bind_sides(**{k: t for k, t in tables.items() if k in SIDE_TABLES})
        return wh

    def bind_sides(self, **tables: DataFrame) -> None:
        """Bind side dimensions by name (``SIDE_TABLES``)."""
        for name, df in tables.items():
            if name not in SIDE_TABLES:
                raise KeyError(f"{name!r} is no side dimension")
            self._sides[name] = df

    def side(self, name: str) -> DataFrame | None:
        """A side dimension bound by name, if there is one."""
        return self._sides.get(name)

    @classmethod
    def from_parquet_dir(cls, spark: SparkSession, root: str) -> "Warehouse":
        """Bind every operational table to ``{root}/{table}`` parquet folders."""
        root = root.rstrip("/")
        return cls.from_tables(spark, {n: spark.read.parquet(f"{root}/{n}") for n in OPERATIONAL_TABLES})

    def keep_by(self, keep: Callable[[str, Callable[[str], None]], DataFrame], views: dict[str, Callable]) -> None:
        """Store each table, and each ``name -> builder(wh)`` view, when it is first asked for.

        ``keep(name, write)`` returns the stored copy: one that it finds, or a
        new one by ``write(path)``. Later tables derive from the stored copy,
        not from its derivation. Threads that ask for the same table wait for
        one copy; different tables may be written at once. The views are
        slow-changing ones over the dimension tables (current phase, price
        configuration).
        """
        self._keep, self._builders = keep, views

    def bind_all(self) -> None:
        """Store now whatever a query might ask for."""
        for name in OPERATIONAL_TABLES:
            self.raw(name)
        for name in self._builders:
            self.view(name)

    def write(self, root: str) -> None:
        """Write every operational table as parquet under ``root`` and read it from there."""
        root = root.rstrip("/")
        for name in OPERATIONAL_TABLES:       # dependency order
            path = f"{root}/{name}"
            self._write(name, self.table(name), path)
            self._bound[name] = self.spark.read.parquet(path)

    def _write(self, name: str, rows: DataFrame, path: str, columns: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write a table to a new folder; ``columns`` makes it of ``rows`` once those are where they belong.

        Fact tables are laid out in month partitions (``<ts>_month``) and
        sorted by time within files: a date-bounded ``slice`` prunes whole
        months by partition and row groups inside them by statistics. A
        month's rows meet in one task; AQE splits a month that holds a large
        share of all rows and puts small ones together. Nothing reads the rows
        before that shuffle (a range partitioning would, for its bounds), and
        it carries no column that follows from others.
        """
        if name in PARTITIONED:
            mo, month = month_column(name), F.trunc(F.col(PARTITIONED[name]), "MM")
            rows = rows.withColumn(mo, month).hint("rebalance", mo)
            rows = (columns(rows) if columns else rows).withColumn(mo, month)
            if name in BLOCKED:
                rows = rows.withColumn(block_column(name), block(F.col(BLOCKED[name])))
            by = layout_columns(name)
            rows.sortWithinPartitions(*by, PARTITIONED[name]).write.partitionBy(*by).parquet(path)
        else:
            (columns(rows) if columns else rows).write.parquet(path)

    def _once(self, at: dict[str, DataFrame], name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in at:
            with self._locks.setdefault(name, threading.RLock()):
                if name not in at:
                    at[name] = build()
        return at[name]

    def view(self, name: str) -> DataFrame | None:
        """A materialised, period-independent dimension view, if this warehouse keeps one."""
        if name in self._builders:
            return self._once(self._views, name, lambda: self._keep(f"views/{name}", lambda path: self._builders[name](self).write.parquet(path)))
        return self._views.get(name)

    def base(self, name: str) -> DataFrame:
        if name not in self._bound:
            self._bound[name] = self._loader(name)
        return self._bound[name]

    def raw(self, name: str) -> DataFrame:
        """Operational table with its layout columns, where it has any (``month_column``)."""
        return self._bound[name] if name in self._bound else getattr(self, name)

    def table(self, name: str) -> DataFrame:
        """Operational table by name (bound directly or derived), data columns only."""
        return self.raw(name).drop(*layout_columns(name))

    def slice(self, name: str, lo: date | None = None, hi: date | None = None) -> DataFrame:
        """Rows of a fact table whose event day lies in [lo, hi] (None = open).

        The bound is applied as a timestamp range on the event column (pushed
        into parquet) and, when the table is month-partitioned, as a range on
        the month partition column as well (partition pruning).
        """
        df = self.raw(name)
        ts = PARTITIONED[name]
        pcol = month_column(name)
        partitioned = pcol in df.columns
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(ts) >= midnight(lo))
            if partitioned:
                cond = cond & (F.col(pcol) >= lit_date(lo.replace(day=1)))
        if hi is not None:
            cond = cond & (F.col(ts) < midnight(date.fromordinal(hi.toordinal() + 1)))
            if partitioned:
                cond = cond & (F.col(pcol) <= lit_date(hi.replace(day=1)))
        return df.where(cond).drop(*layout_columns(name))

    def bind_views(self, names: tuple[str, ...] | None = None) -> None:
        """Register operational tables, all by default, as temp views under their own names."""
        for name in OPERATIONAL_TABLES if names is None else names:
            self.table(name).createOrReplaceTempView(name)

    def run_query(self, sql: str) -> DataFrame:
        """Read-only SQL over the named operational tables, as a DataFrame.

        The views of all tables whose names stand in the text are (re)bound to
        this warehouse right before the statement is analysed; the returned plan
        keeps referring to these tables even if another warehouse binds the
        names later.
        """
        self.bind_views(tuple(n for n in OPERATIONAL_TABLES if re.search(rf"\b{n}\b", sql, re.IGNORECASE)))
        return self.spark.sql(sql)

    def _get(self, name: str, build, columns=None) -> DataFrame:
        """A table by its derivation, stored where the warehouse keeps its tables; ``columns``: see ``_write``."""
        def bind() -> DataFrame:
            if self._keep and name not in BY_ROW:
                return self._keep(name, lambda path: self._write(name, build(), path, columns))
            return columns(build()) if columns else build()

        return self._once(self._bound, name, bind)

    # ---- tenants and catalogue ----------------------------------------
    @property
    def orgs(self) -> DataFrame:
        def build():
            n = self.base("nation")
            return n.select(
                F.col("n_nationkey").alias("id"),
                F.col("n_name").alias("name"),
                F.when(F.col("n_nationkey") % 2 == 0, "SEAT_BASED").otherwise("REVENUE_SHARE").alias("revenue_model"),
                F.when(F.col("n_nationkey") % 12 == 11, "PENDING").otherwise("VERIFIED").alias("status"),
            )
        return self._get("orgs", build)

    @property
    def degrees(self) -> DataFrame:
        def build():
            n = self.base("nation")
            return n.withColumn("d", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
                (F.col("n_nationkey") * 10 + F.col("d")).alias("id"),
                F.col("n_nationkey").alias("college_id"),
                F.when(F.col("d") == 0, "USD").when(F.col("d") == 1, "EUR").alias("currency"),
                (F.lit(1000) + 250 * F.col("d") + 10 * F.col("n_nationkey")).cast("double").alias("tuition_cost"),
            )
        return self._get("degrees", build)

    @property
    def services(self) -> DataFrame:
        def build():
            rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("kind")) for i, k in SERVICE_KINDS])
            return self.spark.range(1).select(F.explode(rows).alias("s")).select("s.id", "s.kind")
        return self._get("services", build)

    @property
    def subscriptions(self) -> DataFrame:
        def build():
            n = self.base("nation")
            return n.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("college_id"))
        return self._get("subscriptions", build)

    @property
    def subscription_phases(self) -> DataFrame:
        def build():
            s = self.base("supplier")
            return s.select(
                F.col("s_suppkey").alias("id"),
                F.col("s_nationkey").alias("subscription_id"),
                _days_after("1998-06-01", F.col("s_suppkey") * 53 % 400).alias("version"),
            )
        return self._get("subscription_phases", build)

    @property
    def products(self) -> DataFrame:
        def build():
            d = self.degrees
            return d.withColumn("service_id", F.explode(_int_array([sid for sid, _ in SERVICE_KINDS]))).select(
                (F.col("id") * 10 + F.col("service_id")).alias("id"),
                "college_id",
                F.col("id").alias("degree_id"),
                "service_id",
            )
        return self._get("products", build)

    @property
    def prices(self) -> DataFrame:
        def build():
            ph = self.subscription_phases.alias("ph")
            su = self.subscriptions.alias("su")
            p = self.products.alias("p")
            j = ph.join(su, F.col("su.id") == F.col("ph.subscription_id")).join(
                p, F.col("p.college_id") == F.col("su.college_id"))
            price = (
                F.when(F.col("p.service_id") == 7, 0.05 * (1 + F.col("ph.id") % 3))
                .when(F.col("p.service_id") == 8, 30.0 + 15 * (F.col("p.degree_id") % 10))
                .when((F.col("ph.id") + F.col("p.id")) % 9 == 0, 0.0)
                .otherwise(10.0 * (1 + F.col("p.service_id")) + F.col("p.degree_id") % 10)
            ).cast("double")
            return j.where(~((F.col("p.service_id") == 7)
                             & ((F.col("p.degree_id") % 10 == 2) | (F.col("p.college_id") % 9 == 4)))).select(
                (F.col("ph.id") * 10000 + F.col("p.id")).alias("id"),
                F.col("ph.id").alias("phase_id"),
                F.col("p.id").alias("product_id"),
                price.alias("price"),
            )
        return self._get("prices", build)

    # ---- enrolments and activity --------------------------------------
    @property
    def degree_students(self) -> DataFrame:
        def build():
            o = self.base("orders")
            c = self.base("customer").select("c_custkey", "c_nationkey")
            return o.join(c, c["c_custkey"] == o["o_custkey"]).select(
                F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("c_nationkey").alias("college_id"),
                "o_orderstatus", F.col("o_orderdate").alias("created"))

        def columns(rows):
            k, od = F.col("id"), F.col("created")
            return rows.select(
                "id",
                "user_id",
                "college_id",
                (F.col("college_id") * 10 + k % 3).alias("degree_id"),
                F.when(F.col("o_orderstatus") == "O", "ACTIVE")
                .when(F.col("o_orderstatus") == "P", F.when(k % 2 == 0, "PENDING").otherwise("SUBMITTED"))
                .otherwise(F.when(k % 2 == 0, "ARCHIVED").otherwise("COMPLETED")).alias("status"),
                "created",
                F.when(k % 5 == 0, _plus_days(od, 20)).alias("pause_started"),
                F.when(k % 10 == 0, _plus_days(od, 80)).alias("pause_ended"),
                F.when((F.col("o_orderstatus") == "F") & (k % 2 == 0), _plus_days(od, 45)).alias("delisted_timestamp"),
                (k % 3 == 1).alias("has_activity_before_invitation"),
                F.when(k % 13 == 0, F.lit(None).cast("boolean")).otherwise(k % 4 == 0).alias("is_pba_converted"),
                F.when(k % 11 == 0, k).alias("rpl_exemption_request_id"),
            )
        return self._get("degree_students", build, columns)

    @property
    def activities(self) -> DataFrame:
        def build():
            ds = self.degree_students
            keys = ["user_id", "college_id", "degree_id"]

            def branch(kind: str, ts: str, cond: Column | None = None) -> DataFrame:
                src = ds if cond is None else ds.where(cond)
                return src.select(*keys, F.lit(kind).alias("kind"), F.col(ts).alias("created"))

            return (
                branch("addDegreeStudent", "created")
                .unionByName(branch("pauseDegreeStudent", "pause_started", F.col("pause_started").isNotNull()))
                .unionByName(branch("archiveDegreeStudent", "delisted_timestamp", F.col("delisted_timestamp").isNotNull()))
                .unionByName(branch("graduateDegreeStudent", "created", F.col("status") == "COMPLETED"))
            )
        return self._get("activities", build)

    @property
    def students(self) -> DataFrame:
        def build():
            c = self.base("customer")
            return c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_id"),
                            F.col("c_nationkey").alias("college_id"))
        return self._get("students", build)

    @property
    def st_students(self) -> DataFrame:
        def build():
            c = self.base("customer")
            k = F.col("c_custkey")
            return c.where(k % 3 != 0).select(
                k.alias("id"),
                k.alias("student_id"),
                _days_after("1998-01-01", k * 7 % 1000).alias("created"),
                (k * 37 % 3000).alias("workload_count"),
                F.when(k % 5 == 0, 1).otherwise(0).alias("degree_count"),
            )
        return self._get("st_students", build)

    @property
    def invoice_purchase_overrides(self) -> DataFrame:
        def build():
            ds = self.degree_students
            i = F.col("id")
            return ds.where(i % 7 == 0).select(
                i.alias("degree_student_id"),
                F.lit("ENROLLMENT").alias("service_kind"),
                F.when(i % 14 == 0, 0).otherwise(500 + i % 700).cast("double").alias("tuition_due"),
            )
        return self._get("invoice_purchase_overrides", build)

    @property
    def rpl_exemption_requests(self) -> DataFrame:
        def build():
            ds = self.degree_students
            i = F.col("id")
            return ds.where(F.col("rpl_exemption_request_id").isNotNull()).select(
                F.col("rpl_exemption_request_id").alias("id"),
                i.alias("degree_student_id"),
                (i % 40).alias("approved_credits"),
                F.when(i % 3 == 0, "REJECTED").otherwise("APPROVED").alias("status"),
                _plus_days(F.col("created"), 5).alias("processed"),
            )
        return self._get("rpl_exemption_requests", build)

    @property
    def degree_student_services(self) -> DataFrame:
        def build():
            ds = self.degree_students
            return ds.select(
                F.col("id").alias("degree_student_id"),
                F.when(F.col("id") % 6 == 0, F.col("created")).alias("rpl"),
            )
        return self._get("degree_student_services", build)

    # ---- courses -------------------------------------------------------
    @property
    def courses(self) -> DataFrame:
        def build():
            p = self.base("part")
            return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("college_id"),
                            F.col("p_name").alias("name"))
        return self._get("courses", build)

    @property
    def ams_course_students(self) -> DataFrame:
        def build():
            li = self.base("lineitem")
            return li.select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                F.col("l_partkey").alias("course_id"),
                F.col("l_shipdate").alias("created"),
            )
        return self._get("ams_course_students", build)

    # ---- billing -------------------------------------------------------
    @property
    def invoices(self) -> DataFrame:
        def build():
            n = self.base("nation")
            kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"))
                              for i, kind in INVOICE_KINDS])
            nk = F.col("n_nationkey")
            return n.withColumn("k", F.explode(kinds)).select("*", "k.i", "k.kind").where(
                ~((F.col("i") == 1) & (nk % 5 == 4)) & ~((F.col("i") == 0) & (nk % 7 == 6))
            ).select(
                (nk * 10 + F.col("i")).alias("id"),
                nk.alias("college_id"),
                F.col("kind"),
                F.concat(nk.cast("string"), F.lit("-"), F.col("kind")).alias("name"),
                F.when(nk % 3 == 0, "DRAFT").when(nk % 3 == 1, "OPEN").otherwise("PAID").alias("status"),
                (100.25 * (1 + nk)).cast("double").alias("amount"),
                F.lit("2000-04-01").cast("date").cast("timestamp_ntz").alias("billing_started"),
            )
        return self._get("invoices", build)

    @property
    def custom_prices(self) -> DataFrame:
        def build():
            i = self.invoices
            lines = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q"), F.lit(t).alias("item_type"))
                              for n, q, t in CUSTOM_PRICE_LINES])
            return i.select("id", "college_id").withColumn("t", F.explode(lines)).select("*", "t.*").select(
                F.col("id").alias("invoice_id"),
                F.col("name"),
                (33.4 + F.col("college_id")).cast("double").alias("price"),
                F.col("q").alias("quantity"),
                F.col("item_type"),
            )
        return self._get("custom_prices", build)

    @property
    def purchases(self) -> DataFrame:
        def build():
            li, k, day = self.base("lineitem"), F.col("l_orderkey"), F.col("l_shipdate")
            before = day < F.lit("2000-01-01").cast("date")
            # A degree's last digit is its enrolment's id % 3: lines whose degree is left out below don't travel to the join.
            # The others travel narrow: category and status as one number, the price joined where the rows end up.
            category = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
            billable = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
            li = li.where((k % 3 == 1) | ((k % 3 == 0) & before)).select(
                "l_orderkey", "l_linenumber", (category * 2 + billable).cast("tinyint").alias("marks"),
                F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * F.col("l_discount") / 20).alias("rev_share"),
                day.alias("created"))
            ds = self.degree_students.select(
                F.col("id").alias("ds_id"), "college_id", "degree_id")
            return li.join(ds, ds["ds_id"] == li["l_orderkey"]).where(
                (F.col("college_id") % 8 != 7)
                & ((F.col("degree_id") % 10 == 1)
                   | ((F.col("degree_id") % 10 == 0) & (F.col("created") < F.lit("2000-01-01").cast("date"))))
            ).drop("ds_id", "degree_id")

        def columns(rows):
            rows = rows.withColumn("degree_id", F.col("college_id") * 10 + F.col("l_orderkey") % 3)
            rows = rows.withColumn("product_id", F.col("degree_id") * 10 + F.col("l_orderkey") % 9)
            return rows.join(self._latest_prices, "product_id", "left").select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                "college_id",
                "degree_id",
                F.when(F.col("marks") >= 4, "DEGREE").when(F.col("marks") >= 2, "STUDYTRACK").alias("category"),
                "rev_share",
                "created",
                F.when(F.col("marks") % 2 == 1, "BILLABLE").otherwise("VOID").alias("status"),
                (F.col("college_id") * 10).alias("invoice_id"),
                "product_id",
                "price_id",
            )
        return self._get("purchases", build, columns)

    @property
    def _latest_prices(self) -> DataFrame:
        """A row a product. Where tables are kept it is one of them: a file's size, not an estimate, decides how purchases meet it."""
        return self._get("latest_prices", lambda: self.prices.groupBy("product_id").agg(F.max("id").alias("price_id")))


# Event-time column of each fact table: written month-partitioned and
# sorted by time; ``Warehouse.slice`` bounds scans on it.
PARTITIONED = {
    "degree_students": "created", "activities": "created", "purchases": "created",
    "ams_course_students": "created", "st_students": "created", "rpl_exemption_requests": "processed",
}


# Tables that rename and pick columns of one given table, row by row: read from there, since a copy would
# carry the same rows through a shuffle and to disk again.
BY_ROW = ("students", "courses", "ams_course_students")


def month_column(name: str) -> str:
    return f"{PARTITIONED[name]}_month"


# Tables laid out by blocks of another table's ids, too. Ids are given out in order of time, so a month's
# rows touch few blocks and a billing period's invoices lie in few: few folders, and a scan that skips most.
BLOCKED = {"purchases": "invoice_id"}
BLOCK_IDS = 1 << 16


def block_column(name: str) -> str:
    return f"{BLOCKED[name]}_block"


def block(ids: Column) -> Column:
    """The block of an id: a function of the id alone, so equal ids share a block."""
    return F.floor(ids / F.lit(BLOCK_IDS)).cast("bigint")


def layout_columns(name: str) -> list[str]:
    """Partition columns that ``Warehouse.write`` adds to a table; no part of its data."""
    return [column(name) for column, tables in ((month_column, PARTITIONED), (block_column, BLOCKED)) if name in tables]


OPERATIONAL_TABLES = (
    "orgs", "degrees", "services", "subscriptions", "subscription_phases", "products", "prices",
    "degree_students", "activities", "students", "st_students", "invoice_purchase_overrides",
    "rpl_exemption_requests", "degree_student_services", "courses", "ams_course_students",
    "invoices", "custom_prices", "purchases",
)
