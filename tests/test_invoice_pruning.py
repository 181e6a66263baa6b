"""Purchases by blocks of invoice ids, pruned at run time by the billing period's invoices."""
import re
import tempfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import invoices as inv
from ledgerlens.plans.catalog import BILLING_START
from ledgerlens.sources.warehouse import BLOCK_IDS, Warehouse, block, block_column, layout_columns, month_column

APRIL, MAY = datetime(2000, 4, 1), datetime(2000, 5, 1)


def _tables(spark):
    """Two billing periods whose invoices lie in different blocks; one invoice holds most purchases."""
    may = 3 * BLOCK_IDS
    bills = [(10, 1, "MONTHLY", "a", "OPEN", 5.0, APRIL), (11, 2, "MONTHLY", "b", "OPEN", 6.0, APRIL), (12, 1, "QUARTERLY", "q", "PAID", 7.0, APRIL),
             (may, 1, "MONTHLY", "a", "OPEN", 8.0, MAY), (may + 1, 2, "MONTHLY", "b", "DRAFT", 9.0, MAY)]
    bought = [(i, 1, may if i % 3 else may + 1, 100 + i % 2, 1 + i % 2, "BILLABLE" if i % 5 else "VOID") for i in range(600)]
    bought += [(1000, 1, 10, 100, 1, "BILLABLE"), (1001, 2, 11, 101, None, "BILLABLE"), (1002, 2, None, 101, 2, "BILLABLE"), (1003, 2, 11, None, 2, "BILLABLE")]
    t = {"invoices": spark.createDataFrame(bills, "id bigint, college_id bigint, kind string, name string, status string, amount double, billing_started timestamp_ntz"),
         "purchases": spark.createDataFrame([(*b, datetime(2000, 3 + b[0] % 3, 2)) for b in bought],
                                            "id bigint, college_id bigint, invoice_id bigint, product_id bigint, price_id bigint, status string, created timestamp_ntz"),
         "products": spark.createDataFrame([(100, 1), (101, 2)], "id bigint, service_id int"),
         "services": spark.createDataFrame([(1, "SEAT_OVERAGE"), (2, "AIRLOCK")], "id int, kind string"),
         "prices": spark.createDataFrame([(1, 2.5), (2, 0.25)], "id bigint, price double")}
    return t, bought


def _laid_out(spark, tables):
    root = tempfile.mkdtemp(prefix="purchases-", dir="/tmp")
    p = tables["purchases"].withColumn(month_column("purchases"), F.trunc("created", "MM")).withColumn(block_column("purchases"), block(F.col("invoice_id")))
    p.write.mode("overwrite").partitionBy(*layout_columns("purchases")).parquet(f"{root}/purchases")
    tables["invoices"].write.parquet(f"{root}/invoices")
    return Warehouse.from_tables(spark, tables | {n: spark.read.parquet(f"{root}/{n}") for n in ("purchases", "invoices")})


@pytest.mark.parametrize("month", [APRIL, MAY])
def test_amounts_equal_the_plain_form_with_and_without_the_layout(spark, month):
    tables, bought = _tables(spark)
    kind, price, want = {100: "SEAT_OVERAGE", 101: "AIRLOCK"}, {1: 2.5, 2: 0.25}, {}
    bills = {r.id: r for r in tables["invoices"].collect() if r.kind == "MONTHLY" and r.billing_started == month}
    for _, _, invoice, product, at, status in bought:
        if status == "BILLABLE" and invoice in bills:
            row = want.setdefault(bills[invoice].college_id, [0.0, 0.0])
            if kind.get(product):
                row[kind[product] == "AIRLOCK"] += price.get(at, 0.0)
    for wh in (Warehouse.from_tables(spark, tables), _laid_out(spark, tables)):
        got = {r.college_id: [r.seat_overage, r.growth] for r in inv.monthly_invoice_purchases(wh, month.date()).collect()}
        assert got == want


def test_the_scan_is_pruned_by_the_periods_invoices(spark):
    tables, _ = _tables(spark)
    df = inv.monthly_invoice_purchases(_laid_out(spark, tables), date(2000, 4, 1))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    parts = [line for line in df._jdf.queryExecution().explainString(mode).splitlines() if "PartitionFilters" in line and "invoice_id_block" in line]
    assert len(parts) == 1 and "dynamicpruning" in parts[0]
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    # as run: April's invoices lie in block 0, so May's 600 purchases are not read
    found = []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet") and "invoice_id_block" in node.output().toString():
            found.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    assert found == [3]


def test_bound_tables_are_laid_out_and_keep_their_columns(spark, wh_small):
    assert layout_columns("purchases") == ["created_month", "invoice_id_block"] and layout_columns("orgs") == []
    assert set(layout_columns("purchases")) <= set(wh_small.raw("purchases").columns)
    for df in (wh_small.table("purchases"), wh_small.slice("purchases", date(2000, 1, 1))):
        assert not set(layout_columns("purchases")) & set(df.columns)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = inv.invoice_breakdown(wh_small, BILLING_START)._jdf.queryExecution().explainString(mode)
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", text)


def test_blocks(spark):
    ids = spark.createDataFrame([(0,), (BLOCK_IDS - 1,), (BLOCK_IDS,), (-1,), (None,)], "id bigint")
    assert [r[0] for r in ids.select(block(F.col("id"))).collect()] == [0, 0, 1, -1, None]
