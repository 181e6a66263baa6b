"""Side dimensions from their JSON forms, and binding real tables directly."""
from datetime import date, datetime


from ledgerlens.functions.periods import Period
from ledgerlens.operators import enrolment as enr
from ledgerlens.operators import invoices as inv
from ledgerlens.operators import revenue_share as rsh
from ledgerlens.sources import dims
from ledgerlens.sources.warehouse import Warehouse

DOC = '{"_comment":"manual targets","2000-05":{"NATION_0":4},"2000-06":{"NATION_0":6,"NATION_1":0,"NATION_2":12}}'


def test_projections_from_json_drops_comments(spark):
    docs = spark.createDataFrame([(DOC,)], "doc string")
    got = sorted(tuple(r) for r in dims.projections_from_json(docs).collect())
    assert got == [("2000-05", "NATION_0", 4), ("2000-06", "NATION_0", 6), ("2000-06", "NATION_1", 0),
                   ("2000-06", "NATION_2", 12)]


def test_squads_and_fees_from_maps(spark):
    docs = spark.createDataFrame([('{"A":["x","y"],"B":["z"]}',)], "doc string")
    assert dims.squads_from_map(docs).count() == 3
    fees = spark.createDataFrame([('{"x":400,"_comment":"per enrolment"}',)], "doc string")
    assert [tuple(r) for r in dims.fees_from_map(fees).collect()] == [("x", 400)]


def test_label_falls_back_to_name(spark):
    t = spark.createDataFrame([("Long A",), ("Long B",)], "name string")
    s = spark.createDataFrame([("Long A", "A")], "name string, short_name string")
    assert sorted(r.label for r in dims.with_label(t, s).collect()) == ["A", "Long B"]


P = Period(date(2000, 6, 1), date(2000, 7, 15))


def _ts(y, m, d):
    return datetime(y, m, d, 10, 0, 0)


def test_multiple_overrides_duplicate_an_enrolment(spark):
    ds = spark.createDataFrame([(1, 7, 70, _ts(2000, 6, 3))], "id bigint, college_id int, degree_id bigint, created timestamp_ntz")
    degrees = spark.createDataFrame([(70, "USD", 1000.0)], "id bigint, currency string, tuition_cost double")
    ipo = spark.createDataFrame([(1, "ENROLLMENT", 300.0), (1, "ENROLLMENT", 400.0), (1, "ENROLLMENT", 0.0)],
                                "degree_student_id bigint, service_kind string, tuition_due double")
    wh = Warehouse.from_tables(spark, {"degree_students": ds, "degrees": degrees, "invoice_purchase_overrides": ipo})
    got = sorted(r.tuition_usd for r in rsh.new_enrolment_tuition(wh, P).collect())
    assert got == [300.0, 400.0]


def test_null_credits_count_in_neither_bucket(spark):
    r = spark.createDataFrame([(1, None, "APPROVED", _ts(2000, 6, 9)), (2, 25.0, "APPROVED", _ts(2000, 6, 9)),
                               (3, 5.0, "APPROVED", _ts(2000, 6, 9))],
                              "degree_student_id bigint, approved_credits double, status string, processed timestamp_ntz")
    ds = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "id bigint, college_id int")
    wh = Warehouse.from_tables(spark, {"rpl_exemption_requests": r, "degree_students": ds})
    row = enr.exemption_counts(wh, P).first()
    assert (row.rpl_low, row.rpl_high) == (1, 1)


def test_several_monthly_invoices_give_several_rows(spark):
    start = datetime(2000, 4, 1)
    invoices = spark.createDataFrame(
        [(10, 1, "MONTHLY", "a", "OPEN", 5.0, start), (11, 1, "MONTHLY", "b", "PAID", 6.0, start),
         (12, 1, "QUARTERLY", "q", "DRAFT", 9.0, start)],
        "id bigint, college_id int, kind string, name string, status string, amount double, billing_started timestamp_ntz")
    purchases = spark.createDataFrame([(10, "BILLABLE", 1, 1), (11, "BILLABLE", 1, 1)],
                                      "invoice_id bigint, status string, product_id bigint, price_id bigint")
    products = spark.createDataFrame([(1, 2)], "id bigint, service_id int")
    services = spark.createDataFrame([(2, "AIRLOCK")], "id int, kind string")
    prices = spark.createDataFrame([(1, 32.0)], "id bigint, price double")
    cp = spark.createDataFrame([(12, "Historical SAAS", 30.0, 1, "fee")],
                               "invoice_id bigint, name string, price double, quantity int, item_type string")
    wh = Warehouse.from_tables(spark, {"invoices": invoices, "purchases": purchases, "products": products,
                                       "services": services, "prices": prices, "custom_prices": cp})
    rows = inv.invoice_breakdown(wh, date(2000, 4, 1)).orderBy("invoice_name").collect()
    assert [r.invoice_name for r in rows] == ["a", "b"]
    assert all(r.saas_fee == 10.0 and r.growth == 32.0 for r in rows)
    assert rows[0].total_cv == 42.0


def test_hot_key_fan_out_is_counted_exactly(spark):
    from ledgerlens.operators import leads as lds

    start = datetime(2000, 6, 2, 9, 0, 0)
    acts = [(1, 5, 50, "addDegreeStudent", start)] * 40 + [(2, 5, 50, "addDegreeStudent", start)] * 3
    ds_rows = ([(i, 1, 5, 50, True, None) for i in range(10)] + [(100 + i, 1, 5, 50, False, 7) for i in range(8)]
               + [(200 + i, 1, 5, 50, False, None) for i in range(12)] + [(300, 1, 5, 50, None, None)]
               + [(400, 2, 5, 50, False, None)])
    a = spark.createDataFrame(acts, "user_id bigint, college_id int, degree_id bigint, kind string, created timestamp_ntz")
    ds = spark.createDataFrame(ds_rows, "id bigint, user_id bigint, college_id int, degree_id bigint, "
                                        "is_pba_converted boolean, rpl_exemption_request_id bigint")
    wh = Warehouse.from_tables(spark, {"activities": a, "degree_students": ds})
    r = lds.admission_mix(wh, P).first()
    # brute force over the event x enrolment pairs of each key
    assert (r.pba, r.rpl, r.standard) == (40 * 10, 40 * 8, 40 * 12 + 3 * 1)


def test_service_kind_list(wh_small):
    got = sorted((r.id, r.kind) for r in wh_small.table("services").collect())
    assert got == [(0, "SEAT"), (1, "SEAT_OVERAGE"), (2, "AIRLOCK"), (3, "EXEMPTION"), (4, "IMPORT"), (5, "PBA"),
                   (6, "RPL"), (7, "ENROLLMENT"), (8, "MIN_REV_SHARE")]
