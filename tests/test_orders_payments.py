import hashlib

import pytest
from pyspark.sql import functions as F

from tillstream.functions import first_names, last_name, nearest, padded, usd_from_vnd, vnd_from_usd
from tillstream.operators import finders, keys, lookup, orders, payments, quality


@pytest.fixture
def placed(spark):
    return spark.createDataFrame(
        [
            ("o1", 1, 5, "website", "2025-01-31T08:00:00", "completed", "paid", 100),
            ("o2", 2, 5, "website", "2025-01-30T08:00:00", "pending", "pending", 0),
            ("o3", 3, 6, "shopee", "2025-01-29", "pending", "pending", 50),
        ],
        "order_id string, ingest_ord bigint, customer_id bigint, channel string, created_at string, status string, "
        "payment_status string, total bigint",
    )


def _ids(df, column="order_id"):
    return [r[column] for r in df.collect()]


def test_end_date_excludes_later_times_of_that_day(placed):
    assert _ids(finders.find_orders(placed, end_date="2025-01-31")) == ["o2", "o3"]


def test_zero_total_means_no_filter(placed):
    assert _ids(finders.find_orders(placed, min_total=0)) == ["o1", "o2", "o3"]
    assert _ids(finders.find_orders(placed, min_total=1)) == ["o1", "o3"]


def test_pages_and_total(placed):
    assert _ids(finders.find_orders(placed, limit=1, offset=1)) == ["o2"]
    plan = finders.find_orders(placed, limit=1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_no_completed_orders(placed):
    (row,) = orders.order_totals(placed.filter("status <> 'completed'")).collect()
    assert (row.average_order_value_vnd, row.conversion_rate, row.total_revenue_vnd) == (0, 0.0, 0)
    (stats,) = orders.customer_order_stats(placed.filter("customer_id = 6")).collect()
    assert (stats.total_orders, stats.average_order_value) == (1, 0)


def test_nested_lines(spark):
    ddl = (
        "order_id string, status string, ingest_ord bigint, subtotal bigint, line_items array<struct<product_id: bigint, "
        "product_name: string, quantity: bigint, unit_price: bigint, discount_percent: bigint, discount_amount: bigint, "
        "line_total: bigint, weight_kg: double>>"
    )
    df = spark.createDataFrame(
        [
            ("o1", "completed", 1, 2548, [(1, "A", 3, 999, 15, 449, 2548, 1.5)]),
            ("o2", "completed", 2, 11, [(2, "B", 1, 10, 0, 0, 10, 0.5), (1, "A2", 2, 7, 0, 0, 14, 0.25)]),
            ("o3", "pending", 3, 7, [(3, "C", 1, 7, 0, 0, 7, None)]),
        ],
        ddl,
    )
    top = orders.top_products_sold(orders.exploded_lines(df)).collect()
    assert [(r.product_id, r.name, r.quantity_sold, r.revenue_vnd) for r in top] == [(1, "A", 5, 2562), (2, "B", 1, 10)]
    assert _ids(quality.nested_subtotal_check(df)) == ["o2"]
    row = df.select("order_id", *[c.alias(n) for n, c in orders.line_measures().items()]).filter("order_id = 'o2'").first()
    assert (row.item_count, row.total_quantity, row.discount_total, row.total_weight_kg) == (2, 3, 0, 0.75)
    lines = orders.exploded_lines(df)
    assert quality.line_pricing_check(lines).count() == 0


def test_rounding_rules(spark):
    row = spark.range(1).select(
        nearest(F.lit(2500), 1000).alias("a"),
        nearest(F.lit(3500), 1000).alias("b"),
        usd_from_vnd(F.lit(100000)).alias("usd"),
        vnd_from_usd(F.lit(1.5)).alias("vnd"),
        padded("NV", F.lit(7), 4).alias("code"),
        padded("NV", F.lit(123456), 4).alias("long"),
        first_names(F.lit("Nguyen Van Hung")).alias("first"),
        last_name(F.lit("Nguyen Van Hung")).alias("last"),
        quality.pos_line_discount(F.lit(9990), F.lit(1), F.lit(15)).alias("discount"),
    ).first()
    assert tuple(row) == (2000, 4000, 4.17, 36000, "NV0007", "NV123456", "Nguyen Van", "Hung", 1000)


def test_status_zero_is_a_wallet_filter(spark):
    tx = spark.createDataFrame(
        [(1, 0, 10, 5), (2, 99, 20, 6)], "ingest_ord bigint, resultCode bigint, amount bigint, responseTime bigint"
    ).withColumn("responseTimeISO", F.lit("2025"))
    assert _ids(finders.find_momo(tx, status=0), "ingest_ord") == [1]
    assert _ids(finders.find_momo(tx), "ingest_ord") == [2, 1]


def test_bank_and_channel_names(spark):
    tx = spark.createDataFrame(
        [(1, 10, 99, ""), (1, 5, 38, None), (1, 1, 38, "VCB"), (2, 7, 38, "VCB"), (1, 3, None, "ACB")],
        "return_code bigint, amount bigint, channel bigint, bank_code string",
    )
    banks = {r.bank: (r.transactions, r.total_vnd) for r in payments.zalopay_by_bank(tx).collect()}
    assert banks == {"ZaloPay": (1, 10), "Unknown": (1, 5), "VCB": (1, 1), "ACB": (1, 3)}
    channels = {r.channel_name: r.total_vnd for r in payments.zalopay_by_channel(tx).collect()}
    assert channels == {"Channel 99": 10, "ZaloPay Wallet": 6, "Channel 0": 3}


def test_wallet_enquiries(spark):
    tx = spark.createDataFrame(
        [(1, "o1", "r1", 0), (2, "o2", "r2", 11), (3, "o1", "r3", 12)],
        "ingest_ord bigint, orderId string, requestId string, resultCode bigint",
    )
    answer, missing = ["orderId", "resultCode"], {"resultCode": 99}
    asked = spark.createDataFrame(
        [("a", "o1", None), ("b", None, "r2"), ("c", "zz", "zz"), ("d", "o2", "r1")],
        "query_id string, order_id string, request_id string",
    )
    rows = finders.wallet_lookup(tx, asked, {"order_id": "orderId", "request_id": "requestId"}, answer, missing).collect()
    assert {r.query_id: (r.found, r.resultCode) for r in rows} == {
        "a": (True, 0),
        "b": (True, 11),
        "c": (False, 99),
        "d": (True, 0),
    }
    one = lambda **k: tuple(finders.wallet_query(tx, k, answer, missing).first())
    assert one(orderId="o2", requestId=None) == ("o2", 11)
    assert one(orderId="nope", requestId=None) == ("nope", 99)


def test_refunds_signatures_and_json(spark):
    good = hashlib.sha256(b"7o1100").hexdigest()
    tx = spark.createDataFrame(
        [(7, "o1", 100, good, [(50,)]), (8, "o2", 40, "bad", [(40,)]), (9, "o3", 5, "bad", None)],
        "transId bigint, orderId string, amount bigint, signature string, refundTrans array<struct<amount: bigint>>",
    )
    refunds = {r.orderId: (r.refunded, r.net_amount, r.refund_kind) for r in payments.refund_summary(tx, "refundTrans", "orderId").collect()}
    assert refunds == {"o1": (50, 50, "partial"), "o2": (40, 0, "full")}
    assert sorted(_ids(quality.momo_signature_check(tx), "orderId")) == ["o2", "o3"]
    text = '{"columninfo": {"store_id": "TS001", "customer_name": "An"}}'
    zp = spark.createDataFrame([(1, text)], "zp_trans_id bigint, embed_data string")
    assert tuple(payments.embedded_store(zp).first()) == (1, "TS001", "An")


def test_reconciliation_statuses(spark):
    placed = spark.createDataFrame([("m",), ("g",), ("b",), ("w",)], "transaction_id string").withColumn(
        "order_amount", F.lit("125.50").cast("decimal(18,2)")
    )
    money = "transaction_id string, a string, f string, ingest_ord bigint"
    gateway = spark.createDataFrame(
        [("m", "125.50", "4.56", 1), ("m", "1.00", "0", 2), ("b", "125.50", "4.56", 3), ("w", "125.50", "4.56", 4), ("x", "9", "1", 5)],
        money,
    ).selectExpr("transaction_id", "cast(a as decimal(18,2)) amount", "cast(f as decimal(18,2)) fee", "ingest_ord")
    bank = spark.createDataFrame([("m", "120.94", "", 1), ("w", "120.00", "", 2)], money).selectExpr(
        "transaction_id", "cast(a as decimal(18,2)) deposit", "ingest_ord"
    )
    found = {r.transaction_id: r for r in lookup.payment_reconciliation(placed, gateway, bank).collect()}
    assert {k: r.status for k, r in found.items()} == {
        "m": "matched",
        "g": "missing_gateway",
        "b": "missing_bank",
        "w": "net_mismatch",
    }
    assert str(found["m"].net_amount) == "120.94"
    full = {r.transaction_id: r.status for r in lookup.payment_reconciliation(placed, gateway, bank, "full").collect()}
    assert full["x"] == "unknown_order"


def test_transaction_lookup_counts_a_source_once(spark):
    ddl = "transaction_id string, ingest_ord bigint"
    sources = {
        "paypal": spark.createDataFrame([("t", 2), ("t", 1)], ddl),
        "momo": spark.createDataFrame([("x", 1, 77)], ddl + ", transId bigint"),
        "sapo": spark.createDataFrame([("t", 9)], ddl),
    }
    keys_df = spark.createDataFrame([("t",), ("77",), ("none",)], "transaction_id string")
    found = {r.transaction_id: (r.found_in_sources, r.matches) for r in lookup.transaction_lookup(keys_df, sources).collect()}
    assert found == {"t": (["paypal", "sapo"], 2), "77": (["momo"], 1), "none": ([], 0)}
    rows = lookup.transaction_matches(keys_df, sources).filter("source = 'paypal'").collect()
    assert [r.data for r in rows] == ['{"transaction_id":"t","ingest_ord":1}']
    one = lookup.find_transaction("77", sources).collect()
    assert [(r.transaction_id, r.source) for r in one] == [("77", "momo")]


def test_ids_continue_after_the_highest(spark):
    existing = spark.createDataFrame([(7,), (1000,)], "id bigint")
    new = spark.range(500).selectExpr("id * 10 as ingest_ord")
    rows = keys.append_surrogate_ids(existing, new, block=100).orderBy("ingest_ord").collect()
    assert [r.id for r in rows] == list(range(1001, 1501))
    assert keys.append_surrogate_ids(existing.limit(0), new).agg(F.min("id")).first()[0] == 1


def test_rules(spark, placed):
    assert _ids(quality.payment_status_check(placed.withColumn("payment_status", F.lit("paid")))) == ["o2", "o3"]
    tx = spark.createDataFrame([("incomingAch", -1.0), ("fee", -1.0), ("fee", 2.0)], "kind string, amount double")
    assert [tuple(r) for r in quality.signed_amount_check(tx).collect()] == [("incomingAch", -1.0), ("fee", 2.0)]
    ids = spark.createDataFrame([("TXN2024112400000001",), ("TXN1",), (None,)], "t string")
    assert [r.t for r in quality.id_format_check(ids, "t", "transaction_id").collect()] == ["TXN1", None]
    fx = spark.createDataFrame([(24000, 1.0), (24000, 1.5)], "vnd bigint, usd double")
    assert quality.fx_check(fx, "vnd", "usd").count() == 1
    assert [r.rows for r in lookup.orphans(placed, "customer_id", spark.createDataFrame([(5,)], "id bigint")).collect()] == [1]


def test_text_filters_are_literal(spark):
    staff = spark.createDataFrame([(1, "Sales 100%", "active"), (2, "Sales", "Active")], "id bigint, position string, status string")
    assert _ids(finders.find_staff(staff, position="100%"), "id") == [1]
    assert _ids(finders.find_staff(staff, position="s_l"), "id") == []
    assert _ids(finders.find_staff(staff, status="ACTIVE", offset=1), "id") == [2]
