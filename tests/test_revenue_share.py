"""M09c and M09d from one salted pass over purchases."""
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import revenue_share as rsh
from ledgerlens.operators.pricing import degree_fee_pivot
from ledgerlens.plans.catalog import PAST
from ledgerlens.sources.warehouse import OPERATIONAL_TABLES, Warehouse


@pytest.fixture
def hot(spark, wh_small):
    """The test tables with one tenant that holds half of all purchases and more."""
    purchases = wh_small.table("purchases")
    tenant = purchases.where("rev_share IS NOT NULL").groupBy("college_id").count().orderBy(F.desc("count"), "college_id").first()["college_id"]
    many = purchases.where(F.col("college_id") == tenant).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60))))
    many = many.withColumn("id", F.col("id") * 100 + F.col("copy")).withColumn("rev_share", F.col("rev_share") + F.col("copy")).drop("copy")
    tables = {n: wh_small.table(n) for n in OPERATIONAL_TABLES} | {"purchases": purchases.unionByName(many.select(*[F.col(c).cast(t).alias(c) for c, t in purchases.dtypes]))}
    return tenant, Warehouse.from_tables(spark, tables)


def _plain(wh):
    """Both averages row by row in Python."""
    floors = {(r["college_id"], r["degree_id"]): r["min_rev_share"] for r in degree_fee_pivot(wh).collect()}
    lowest, recent, ever = {}, {}, {}
    for (c, _), f in floors.items():
        if f is not None:
            lowest[c] = min(f, lowest.get(c, f))
    for r in wh.table("purchases").where("rev_share IS NOT NULL AND coalesce(category, '') <> 'STUDYTRACK'").collect():
        c, d = r["college_id"], r["degree_id"]
        ever.setdefault(c, []).append(max(r["rev_share"], lowest.get(c, 0.0)))
        if r["created"].date() >= PAST.three_months_ago and (c, d) in floors:
            recent.setdefault((c, d), []).append(max(r["rev_share"], floors[c, d] or 0.0))
    mean = lambda v: pytest.approx(sum(v) / len(v), rel=1e-12)
    return {k: mean(v) for k, v in recent.items()}, {k: mean(v) for k, v in ever.items()}


def test_averages_equal_the_plain_form_with_a_tenant_of_half_the_rows(hot):
    tenant, wh = hot
    rows = wh.table("purchases").where("rev_share IS NOT NULL")
    assert rows.where(F.col("college_id") == tenant).count() > rows.count() / 2
    recent, ever = _plain(wh)
    assert {(r[0], r[1]): r[2] for r in rsh.avg_share_per_degree_3m(wh, PAST).collect()} == recent
    assert {r[0]: r[1] for r in rsh.avg_share_per_tenant(wh).collect()} == ever
    shares = rsh.tenant_shares(rsh.share_sums(wh, PAST.three_months_ago)).collect()
    assert {r["college_id"]: r["tenant_avg"] for r in shares} == ever
    assert {(r["college_id"], d): v for r in shares for d, v in r["degree_avgs"].items()} == recent


def test_salts_do_not_change_the_sums(hot):
    _, wh = hot
    one, many = ({(r[0], r[1]): tuple(v or 0.0 for v in tuple(r)[2:]) for r in rsh.share_sums(wh, PAST.three_months_ago, salts=n).collect()} for n in (1, 7))
    assert one.keys() == many.keys()
    for key, sums in one.items():
        assert many[key] == pytest.approx(sums, rel=1e-9)


def test_purchases_are_dealt_by_tenant_and_salt_in_one_pass(spark, wh_small):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        plan = rsh.expected_share_revenue(wh_small, PAST)._jdf.queryExecution().sparkPlan().toString()
        full = rsh.expected_share_revenue(wh_small, PAST)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("rev_share#") and len(re.findall(r"Scan parquet .*rev_share", plan)) == 1
    # the line above the purchases' filter and projection is an exchange on (tenant, salt), never on the tenant alone
    lines = full.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "rev_share" in line)
    dealt = next(line for line in reversed(lines[:scan]) if "Exchange" in line)
    assert re.search(r"hashpartitioning\(college_id#\d+L?, salt#\d+", dealt), dealt
