"""Binding on demand: a query derives and stores the tables that it reads; purchases against a plain form."""
import os
import tempfile
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest

from ledgerlens.sources import binding, dims
from ledgerlens.sources.warehouse import Warehouse

SCHEMAS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"}


def _rows():
    tenants = [-1, 0, 1, 7, 8, 11, None]
    customers = [(i, "c", tenants[i % 7], 0.0, "m") for i in range(14)] + [(3, "again", 5, 0.0, "m")]
    orders = [(k, k % 14, "OFP"[k % 3], 1.0, datetime(1999, 1 + k % 12, 3, 4), "1") for k in range(-6, 60)]
    orders += [orders[20], (None, 2, "O", 1.0, None, "1"), (70, 2, None, 1.0, None, "1")]
    lines = [(k, 1, 1, n, 1.0, 100.0 + k, 0.05 * n, 0.0, ("A", "R", "N", None)[(k + n) % 4], ("F", "O", None)[(k + 2 * n) % 3],
              (datetime(1999, 12, 31, 23), datetime(2000, 1, 1), datetime(2000, 5, 6, 7), None)[(k * 3 + n) % 4])
             for k in (*range(-6, 62), 70) for n in (1, 2, 7)]
    lines += [lines[30], (None, 1, 1, 1, 1.0, 1.0, 0.1, 0.0, "A", "F", datetime(2000, 1, 1)), (4, 1, 1, None, 1.0, 1.0, 0.1, 0.0, "R", "F", datetime(1999, 1, 1))]
    return {"region": [(0, "R")], "nation": [(n, f"N{n}", 0) for n in (-1, 0, 1, 5, 7, 8, 11)], "customer": customers,
            "supplier": [(i, "s", i % 12, 0.0) for i in range(1, 9)], "part": [(1, "blue x", 2.0), (2, "red y", 3.0)], "orders": orders, "lineitem": lines}


@pytest.fixture()
def data(spark):
    root = tempfile.mkdtemp(prefix="base-", dir="/tmp")
    for name, rows in _rows().items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def _folder(spark, root):
    return binding._published(spark, binding.warehouse_root(spark, root)).replace("file:", "")


def test_a_query_stores_the_tables_that_it_reads_and_no_others(spark, data):
    wh = binding.bound_warehouse(spark, data)
    assert dims.projections(wh).count() == 5
    assert [x for x in os.listdir(_folder(spark, data)) if not x.startswith(("_", "."))] == []
    assert wh.table("st_students").count() == len([c for c in _rows()["customer"] if c[0] % 3])
    assert os.listdir(_folder(spark, data) + "/st_students") and not os.path.exists(_folder(spark, data) + "/degree_students")
    assert wh.table("ams_course_students").count() == len(_rows()["lineitem"])           # read from lineitem, no copy of it
    assert not os.path.exists(_folder(spark, data) + "/ams_course_students")
    assert wh.run_query("SELECT COUNT(*) AS n FROM orgs").first().n == 7
    assert not os.path.exists(_folder(spark, data) + "/activities")


def test_one_copy_for_threads_that_ask_at_once_and_for_later_sessions(spark, data):
    wh = binding.bound_warehouse(spark, data)
    with ThreadPoolExecutor(6) as pool:
        files = list(pool.map(lambda name: tuple(sorted(wh.table(name).inputFiles())), ["activities", "rpl_exemption_requests"] * 3))
    assert len(set(files)) == 2
    for name in ("activities", "degree_students"):
        assert len([x for x in os.listdir(f"{_folder(spark, data)}/{name}") if not x.startswith(".")]) == 1
    binding._BOUND.pop((binding._session_id(spark), binding.warehouse_root(spark, data)))
    assert tuple(sorted(binding.bound_warehouse(spark, data).table("activities").inputFiles())) == files[0]


def test_purchases_equal_the_plain_form(spark, data):
    r = _rows()
    owner = [(o, c[2]) for o in r["orders"] for c in r["customer"] if o[1] == c[0]]
    phase, want = {}, []
    for s in r["supplier"]:
        phase[s[2]] = max(phase.get(s[2], 0), s[0])

    def rem(a, b):                      # SQL's remainder takes the dividend's sign
        return None if a is None else abs(a) % b * (1 if a >= 0 else -1)

    for k, _, _, n, _, price, discount, _, flag, state, day in r["lineitem"]:
        for o, tenant in owner:
            if o[0] is None or o[0] != k or tenant is None or rem(tenant, 8) == 7:
                continue
            degree = tenant * 10 + rem(k, 3)
            if not (rem(degree, 10) == 1 or rem(degree, 10) == 0 and day is not None and day < datetime(2000, 1, 1)):
                continue
            want.append((None if n is None else k * 10 + n, tenant, degree, {"A": "STUDYTRACK", "R": "DEGREE"}.get(flag),
                         price * discount / 20 if n is not None and n != 7 else None, day, "BILLABLE" if state == "F" else "VOID", tenant * 10, degree * 10 + rem(k, 9)))
    wh = binding.bound_warehouse(spark, data)
    plain = Warehouse.from_testdata(spark, data)
    prices = {p: i for p, i in plain.prices.groupBy("product_id").agg({"id": "max"}).collect()}
    names = ["id", "college_id", "degree_id", "category", "rev_share", "created", "status", "invoice_id", "product_id", "price_id"]
    want = sorted(((*w, prices.get(w[-1])) for w in want), key=repr)
    assert want and any(w[9] for w in want)
    for df in (wh.table("purchases"), plain.table("purchases")):
        assert sorted((tuple(x) for x in df.select(*names).collect()), key=repr) == want
    stored = wh.raw("purchases").where("created_month IS NOT NULL").select("created", "created_month").collect()
    assert all(x.created.date().replace(day=1) == x.created_month for x in stored)
