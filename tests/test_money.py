"""money is exact from the tuition to the rounded sum."""
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions.exprs import money, money_times
from ledgerlens.functions.periods import Period
from ledgerlens.operators import revenue_share as rsh
from ledgerlens.sources.warehouse import Warehouse

P = Period(date(2000, 6, 1), date(2000, 7, 15))


def _wh(spark, enrolments, tuition, overrides=(), money_type="double", purchases=()):
    created = datetime(2000, 6, 3, 10)
    typed = (lambda v: Decimal(v)) if money_type.startswith("decimal") else float
    return Warehouse.from_tables(spark, {
        "degree_students": spark.createDataFrame([(i, c, d, created) for i, c, d in enrolments], "id bigint, college_id int, degree_id bigint, created timestamp_ntz"),
        "degrees": spark.createDataFrame([(d, cur, typed(t)) for d, cur, t in tuition], f"id bigint, currency string, tuition_cost {money_type}"),
        "invoice_purchase_overrides": spark.createDataFrame([(i, "ENROLLMENT", typed(t)) for i, t in overrides],
                                                            f"degree_student_id bigint, service_kind string, tuition_due {money_type}"),
        "purchases": spark.createDataFrame(list(purchases), f"id bigint, college_id int, degree_id bigint, category string, rev_share {money_type}, created timestamp_ntz")})


def _fees(spark, rows):
    return spark.createDataFrame(rows, "college_id int, degree_id bigint, enrollment_pct double, min_rev_share double")


def test_a_half_that_doubles_miss_is_rounded_up(spark):
    # four times 0.35 x 22.50 is 31.50 exactly; summed as doubles it is 31.499999999999996
    assert sum([0.35 * 22.5] * 4) < 31.5
    for kind in ("double", "decimal(38,9)"):
        wh = _wh(spark, [(i, 7, 70) for i in range(4)], [(70, "USD", "22.5")], money_type=kind)
        got = rsh.expected_share_revenue(wh, P, fees=_fees(spark, [(7, 70, 0.35, None)])).collect()
        assert [(r.college_id, r.exp_rev_usd, r.est_from_min_rev) for r in got] == [(7, 32.0, 0)], kind


def test_cents_of_large_amounts_are_kept(spark):
    # 2^53 cents and more: a double no longer holds them
    wh = _wh(spark, [(1, 7, 70), (2, 7, 70)], [(70, "USD", "90071992547409.93")], [(2, "90071992547409.91")], money_type="decimal(38,9)")
    rows = sorted(r.tuition_usd for r in rsh.new_enrolment_tuition(wh, P).collect())
    assert rows == [Decimal("90071992547409.91"), Decimal("90071992547409.93")]
    assert dict(rsh.new_enrolment_tuition(wh, P).dtypes)["tuition_usd"] == "decimal(38,9)"


def test_every_branch_is_exact_and_unknown_stays_unknown(spark):
    paid = [(1, 7, 70, None, "0.1", datetime(2000, 5, 2)), (2, 8, 99, None, "0.7", datetime(1999, 1, 2))]
    wh = _wh(spark, [(1, 7, 70), (2, 7, 71), (3, 7, 72), (4, 8, 80), (5, 9, 90), (6, 9, 91)],
             [(70, "USD", "10"), (71, "USD", "10.01"), (72, "USD", "10"), (80, "EUR", "10"), (90, "EUR", "10")],
             purchases=[(i, c, d, k, float(s), t) for i, c, d, k, s, t in paid])
    fees = _fees(spark, [(7, 70, 0.1, None), (7, 71, 0.15, 0.2), (7, 72, None, 5.0), (8, 80, 0.1, 3.3), (9, 90, 0.1, 3.3)])
    rows = {r.degree_student_id: (r.branch, r.value) for r in rsh.expected_share_revenue(wh, P, with_rows=True, fees=fees).collect()}
    assert rows == {1: (1, Decimal("0.1")), 2: (2, Decimal("1.5015")), 3: (2, None), 4: (3, Decimal("3.3")), 5: (4, Decimal("3.3")), 6: (4, Decimal("0"))}


def test_a_product_is_rounded_once(spark):
    row = spark.range(1).select(money_times(F.lit(0.333333333), F.lit(1000000.000000001)).alias("p"), money(F.lit("0.1234567895").cast("decimal(20,10)")).alias("m"),
                                money_times(F.lit(None).cast("double"), F.lit(1.0)).alias("n")).first()
    exact = Decimal("0.333333333") * Decimal("1000000.000000001")
    assert row.p == exact.quantize(Decimal("1e-9"), rounding="ROUND_HALF_UP")
    assert row.m == Decimal("0.123456790") and row.n is None
