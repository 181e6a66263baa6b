"""The report layer on a warehouse bound by name: nineteen tables and five maps, no test tables behind them."""
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import pricing as prc
from ledgerlens.plans import overview as ov
from ledgerlens.plans.catalog import PAST
from ledgerlens.plans.month_report import tenant_month_report
from ledgerlens.sources import dims
from ledgerlens.sources.warehouse import OPERATIONAL_TABLES, Warehouse


def _doc(spark, value):
    return spark.createDataFrame([(json.dumps(value),)], "doc string")


@pytest.fixture(scope="module")
def real(spark, wh_small):
    wh = Warehouse.from_tables(spark, {n: wh_small.table(n) for n in OPERATIONAL_TABLES})
    proj = {}
    for r in dims.projections(wh_small).collect():
        proj.setdefault(r["month"], {})[r["name"]] = r["projected"]
    squads = {}
    for r in dims.squads(wh_small).collect():
        squads.setdefault(r["squad"], []).append(r["name"])
    return dims.bind_maps(
        wh, _doc(spark, proj | {"_comment": "by month"}), _doc(spark, {r["name"]: r["fee"] for r in dims.fees(wh_small).collect()}),
        _doc(spark, squads), _doc(spark, {r["name"]: r["short_name"] for r in dims.short_names(wh_small).collect()}),
        dims.featured_courses(wh_small))


def _rows(df):
    return sorted((tuple(float(v) if isinstance(v, int) else v for v in r) for r in df.collect()), key=repr)


def test_reports_equal_those_of_the_test_binding(real, wh_small):
    assert _rows(tenant_month_report(real, PAST)) == _rows(tenant_month_report(wh_small, PAST))
    assert _rows(ov.squad_report(real, PAST)) == _rows(ov.squad_report(wh_small, PAST))
    mine, test = ov.overview_base(real, PAST), ov.overview_base(wh_small, PAST)
    for page in (ov.seat_overview, ov.share_overview, ov.enrolment_overview_seat):
        assert _rows(page(mine)) == _rows(page(test)), page.__name__


def test_unknown_side_dimension_is_an_error(spark):
    with pytest.raises(KeyError):
        Warehouse.from_tables(spark, {}).bind_sides(colours=spark.range(1))


def test_fractional_fees_stay_and_nan_drops_out(spark):
    got = dims.fees_from_map(_doc(spark, {"a": 12.5, "b": "x", "c": "NaN", "d": 3})).collect()
    assert {(r["name"], r["fee"]) for r in got} == {("a", 12.5), ("d", 3.0)}


def test_a_product_of_another_tenant_is_priced_to_the_tenant_of_the_phase(spark, wh_small):
    phase = prc.latest_phase(wh_small).orderBy("college_id").first()
    other = wh_small.table("products").where(F.col("college_id") != phase["college_id"]).orderBy("id").first()
    kind = wh_small.table("services").where("kind = 'MIN_REV_SHARE'").first()["id"]
    products, prices = wh_small.table("products"), wh_small.table("prices")
    one = spark.createDataFrame([{"id": -1, "college_id": other["college_id"], "degree_id": -7, "service_id": kind}]).select(
        *[F.col(c).cast(t).alias(c) if c in ("id", "college_id", "degree_id", "service_id") else F.lit(None).cast(t).alias(c) for c, t in products.dtypes])
    price = spark.range(1).select(*[
        F.lit({"id": -1, "product_id": -1, "phase_id": phase["phase_id"], "price": 123.0}.get(c)).cast(t).alias(c) for c, t in prices.dtypes])
    tables = {n: wh_small.table(n) for n in OPERATIONAL_TABLES} | {"products": products.unionByName(one), "prices": prices.unionByName(price)}
    got = prc.degree_fee_pivot(Warehouse.from_tables(spark, tables)).where("degree_id = -7").collect()
    assert [(r["college_id"], r["min_rev_share"]) for r in got] == [(phase["college_id"], 123.0)]


def test_one_day_of_a_fact_is_split_over_several_tasks(spark, tmp_path):
    from ledgerlens.sources.warehouse import PARTITIONED

    ts = PARTITIONED["activities"]
    day = spark.range(20000).select(F.col("id"), F.lit("2000-06-01 00:00:00").cast("timestamp_ntz").alias(ts))
    parts = day.repartitionByRange(4, F.col(ts), F.xxhash64(*day.columns)).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 10000


def test_changed_input_is_bound_anew(spark, tmp_path):
    import shutil

    from conftest import SF_SMALL
    from ledgerlens.sources.binding import bound_warehouse

    where = tmp_path / "sf"
    shutil.copytree(SF_SMALL, where)
    for f in where.iterdir():
        f.chmod(0o644)
    before = bound_warehouse(spark, str(where)).table("orgs").count()
    n = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    n.limit(5).toPandas().to_parquet(where / "nation.parquet")
    assert before == n.count() and bound_warehouse(spark, str(where)).table("orgs").count() == 5
