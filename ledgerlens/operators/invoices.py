"""Invoice breakdown for one billing period: M22a, M22b, M22c, M22.

The billing start is a parameter (the source hard-codes one month, Q13).
Invoices and custom price lines are small; purchases are the fact. Where they
are laid out by blocks of invoice ids, the period's invoices prune their scan at
run time (dynamic partition pruning over the block, where Spark broadcasts the
measured invoice list). What is read is counted by (invoice, product, price) on
the map side before any join, so neither an invoice nor a tenant that holds a
large share of all purchases makes a large task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sqlround
from ..sources.warehouse import Warehouse, block, block_column

# Service kinds billed as growth on the monthly invoice.
GROWTH_KINDS = ("AIRLOCK", "PBA", "IMPORT", "RPL", "EXEMPTION")


def _invoices(wh: Warehouse, kind: str, billing_started: date) -> DataFrame:
    i = wh.table("invoices")
    start = F.lit(billing_started.isoformat()).cast("timestamp_ntz")
    return i.where((F.col("kind") == kind) & (F.col("billing_started") == start))


def _line_amount():
    return F.col("price") * F.col("quantity")


def quarterly_invoice_lines(wh: Warehouse, billing_started: date) -> DataFrame:
    """Per tenant, quarterly status and the monthly third of two named line groups."""
    inv = _invoices(wh, "QUARTERLY", billing_started).select(
        F.col("id").alias("invoice_id"), "college_id", "status")
    cp = wh.table("custom_prices").select("invoice_id", "name", "price", "quantity")
    lname = F.lower(F.col("name"))
    return cp.join(inv, "invoice_id").groupBy("college_id").agg(
        F.max("status").alias("quarterly_status"),
        (F.sum(F.when(lname.like("%historical%"), _line_amount()).otherwise(0.0)) / 3.0).alias("saas_fee"),
        (F.sum(F.when(lname.like("%prepaid seat%"), _line_amount()).otherwise(0.0)) / 3.0)
        .alias("seat_prepaid_monthly"),
    )


def monthly_invoice_purchases(wh: Warehouse, billing_started: date) -> DataFrame:
    """BILLABLE purchases on the period's monthly invoices: seat_overage and growth."""
    inv = _invoices(wh, "MONTHLY", billing_started).select(
        F.col("id").alias("invoice_id"), "college_id",
        F.col("name").alias("invoice_name"), F.col("status").alias("invoice_status"),
        F.col("amount").alias("invoice_total"))
    p, by, at = wh.raw("purchases").where(F.col("status") == "BILLABLE"), ["invoice_id"], block_column("purchases")
    if at in p.columns:         # laid out by blocks: the block joins, too, and prunes the scan
        by.append(at)
        inv = inv.withColumn(at, block(F.col("invoice_id")))
    p = p.groupBy(*by, "product_id", "price_id").agg(F.count(F.lit(1)).alias("n"))
    prod = wh.table("products").select(F.col("id").alias("product_id"), "service_id")
    svc = wh.table("services").select(F.col("id").alias("service_id"), "kind")
    pr = wh.table("prices").select(F.col("id").alias("price_id"), "price")
    j = (p.join(inv, by)
         .join(prod, "product_id", "left")
         .join(svc, "service_id", "left")
         .join(pr, "price_id", "left"))
    amount = F.coalesce(F.col("price"), F.lit(0.0)) * F.col("n")
    return j.groupBy("college_id", "invoice_name", "invoice_status", "invoice_total").agg(
        F.sum(F.when(F.col("kind") == "SEAT_OVERAGE", amount).otherwise(0.0)).alias("seat_overage"),
        F.sum(F.when(F.col("kind").isin(*GROWTH_KINDS), amount).otherwise(0.0)).alias("growth"),
    )


def additional_items(wh: Warehouse, billing_started: date) -> DataFrame:
    """M22c: 'charge' lines on the period's monthly invoices."""
    inv = _invoices(wh, "MONTHLY", billing_started).select(F.col("id").alias("invoice_id"), "college_id")
    cp = wh.table("custom_prices").where(F.col("item_type") == "charge")
    return (cp.join(inv, "invoice_id").groupBy("college_id")
            .agg(F.sum(_line_amount()).alias("additional_items")))


def invoice_breakdown(wh: Warehouse, billing_started: date) -> DataFrame:
    """One row per monthly invoice with the six revenue heads (2-digit ROUND)."""
    mp = monthly_invoice_purchases(wh, billing_started)
    q = quarterly_invoice_lines(wh, billing_started)
    ad = additional_items(wh, billing_started)
    j = mp.join(q, "college_id", "left").join(ad, "college_id", "left")

    def z(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    return j.select(
        "college_id", "invoice_name", "invoice_status", "quarterly_status",
        sqlround(z("saas_fee"), 2).alias("saas_fee"),
        sqlround(z("seat_prepaid_monthly") + z("seat_overage"), 2).alias("seat_fee"),
        sqlround(z("growth"), 2).alias("growth"),
        sqlround(z("additional_items"), 2).alias("additional_items"),
        sqlround(z("saas_fee") + z("seat_prepaid_monthly") + z("seat_overage") + z("growth")
                 + z("additional_items"), 2).alias("total_cv"),
        sqlround(F.col("invoice_total"), 2).alias("monthly_invoice_total"),
    )
