"""The registered queries: every operator over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.functions import (
    epoch_millis,
    first_names,
    half_even,
    iso_text,
    iso_timestamp,
    last_name,
    nearest,
    padded,
    usd_from_vnd,
    vnd_from_usd,
)
from tillstream.operators import cart, cleaning, finders, keys, lookup, metrics, orders, pages, payments, quality, sessions
from tillstream.plans import pipeline, report, versions
from tillstream.plans.shared import Shared
from tillstream.session import apply_settings, materialise, scratch_path
from tillstream.sources import readers, sinks
from tillstream.sources import testtables as tt
from tillstream.streaming import activity, ingest, progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-31 00:00:00"


def plain(df: DataFrame) -> DataFrame:
    """Times as text, whole numbers as bigint, decimals as double: one form for every engine."""

    def column(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            return c.cast("bigint").alias(f.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(apply_settings(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _prepared(spark, d) -> DataFrame:
    return cleaning.prepared_events(tt.cart_events(spark, d))


def _written(spark, d) -> DataFrame:
    """The prepared events as a table, for operators that go over them more than once."""
    return materialise(_prepared(spark, d), "prepared")


def _sessions(spark, d) -> DataFrame:
    return sessions.session_metrics(_written(spark, d))


def _typed(spark, d, session_by="user") -> DataFrame:
    return cleaning.typed_events(tt.cart_events(spark, d, session_by))


EVENT_COLUMNS = [
    "event_id",
    "ingest_ord",
    "session_id",
    "customer_id",
    "event_type",
    "timestamp",
    "date",
    "hour",
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "referrer",
    "product_id",
    "product_price_vnd",
    "product_price_usd",
    "quantity",
    "line_total_vnd",
    "line_total_usd",
]
RAW_COLUMNS = ["event_id", "ingest_ord", "session_id", "customer_id", "event_type", "timestamp", "source", "device"]


def _events_out(df: DataFrame) -> DataFrame:
    return rounded(df.select(*EVENT_COLUMNS), "product_price_usd", "line_total_usd", digits=6)


# --- pipeline --------------------------------------------------------------------


@query
def clean_events(spark, d):
    return _events_out(cleaning.clean_events(tt.cart_events(spark, d)))


@query
def dedup_events(spark, d):
    return _events_out(_prepared(spark, d))


@query
def new_events(spark, d):
    events = _prepared(spark, d)
    return cleaning.new_events(events, events.filter("date < DATE'2024-01-15'")).select("event_id", "timestamp")


@query
def run_statistics(spark, d):
    return cleaning.run_statistics(tt.cart_events(spark, d))


@query
def event_sequence(spark, d):
    return sessions.event_sequence(_written(spark, d))


@query
def session_metrics(spark, d):
    return _sessions(spark, d)


ENRICHED = [
    "event_id",
    "session_id",
    "date",
    "event_sequence_num",
    "session_start",
    "session_end",
    "session_duration_seconds",
    "total_events",
    "event_journey",
]


@query
def enriched_events(spark, d):
    return sessions.enrich_events(_written(spark, d)).select(*ENRICHED)


@query
def journey_parts(spark, d):
    return sessions.journey_parts(_written(spark, d))


@query
def daily_summary(spark, d):
    pairs = F.transform(F.map_entries("event_type_distribution"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return metrics.daily_summary(_prepared(spark, d)).withColumn(
        "event_type_distribution", F.array_join(F.array_sort(pairs), ",")
    )


@query
def event_epochs(spark, d):
    """Event times as epoch milliseconds and back as ISO text."""
    millis = epoch_millis(iso_timestamp(F.col("timestamp")))
    again = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return tt.cart_events(spark, d).select("event_id", "ingest_ord", millis.alias("timestamp_unix"), again.alias("iso"))


@query
def name_parts(spark, d):
    """Names split into all words but the last, and the last."""
    return tt.products(spark, d).select(
        "id", first_names(F.col("name")).alias("first_name"), last_name(F.col("name")).alias("last_name")
    )


# --- metrics ---------------------------------------------------------------------


@query
def session_duration_stats(spark, d):
    stats = metrics.session_duration_stats(_sessions(spark, d))
    return rounded(stats, *[c for c in stats.columns if c != "total_sessions"])


@query
def purchase_intent(spark, d):
    return rounded(metrics.purchase_intent(_prepared(spark, d)), "purchase_intent_rate")


@query
def purchase_intent_sessions(spark, d):
    return metrics.purchase_intent_sessions(_prepared(spark, d))


@query
def event_stats(spark, d):
    return rounded(metrics.event_stats(_prepared(spark, d)), "average_events_per_session")


@query
def event_type_distribution(spark, d):
    return rounded(metrics.distribution(_prepared(spark, d), "event_type"), "percentage")


@query
def source_distribution(spark, d):
    return rounded(metrics.distribution(_prepared(spark, d), "source"), "percentage")


@query
def device_distribution(spark, d):
    return rounded(metrics.distribution(_prepared(spark, d), "device"), "percentage")


@query
def journey_patterns(spark, d):
    return sessions.journey_patterns(_written(spark, d))


@query
def journey_length(spark, d):
    return rounded(metrics.journey_length(_prepared(spark, d)), "average_journey_length")


@query
def events_by_date(spark, d):
    return metrics.events_by_date(_prepared(spark, d))


@query
def events_by_hour(spark, d):
    return metrics.events_by_hour(_prepared(spark, d))


@query
def events_by_dow(spark, d):
    return metrics.events_by_weekday(_prepared(spark, d))


@query
def sessions_by_date(spark, d):
    return metrics.sessions_by_date(_prepared(spark, d))


@query
def conversion_by_source(spark, d):
    return metrics.conversion_by_source(_prepared(spark, d))


@query
def longest_sessions(spark, d):
    return metrics.longest_sessions(_sessions(spark, d)).select(
        "session_id", "total_events", "session_duration_seconds"
    )


@query
def aggregation_report(spark, d):
    """All metrics as numbers, from one aggregate of the events and the sessions' pieces."""
    events = _written(spark, d)
    shared = Shared(events)
    found = report.metric_values(events, sessions.session_metrics(None, pieces=shared.pieces), shared=shared)
    return rounded(found, "value", digits=6)


@query
def aggregation_files(spark, d):
    """A whole run from raw events, and the metrics read back from the file it writes."""
    out = scratch_path(spark, "run")
    pipeline.run_pipeline(tt.cart_events(spark, d), out)
    return rounded(report.read_metrics(spark, out), "value", digits=6)


@query
def metrics_json(spark, d):
    names = ["events_by_hour", "events_by_day_of_week", "journey_patterns", "sessions_by_date"]
    events = _prepared(spark, d)
    return report.metric_rows(events, sessions.session_metrics(events), names)


# --- cart ------------------------------------------------------------------------


@query
def cart_statistics(spark, d):
    stats = cart.cart_statistics(_typed(spark, d, "day"))
    return rounded(stats, "add_remove_exact", digits=6)


@query
def cart_distribution(spark, d):
    return cart.cart_distribution(_typed(spark, d))


@query
def top_products_added(spark, d):
    return cart.top_products_added(_typed(spark, d))


@query
def cart_items(spark, d):
    return cart.cart_items(_typed(spark, d))


def _item_texts(carts: DataFrame) -> DataFrame:
    item = lambda i: F.concat_ws(":", i["product_name"], i["quantity"], i["price_vnd"])
    return carts.withColumn("cart_items", F.array_join(F.transform("cart_items", item), ","))


@query
def abandoned_carts(spark, d):
    return _item_texts(cart.abandoned_carts(_typed(spark, d), AS_OF, 24, 50))


@query
def abandoned_carts_all(spark, d):
    return _item_texts(cart.abandoned_carts(_typed(spark, d), AS_OF, 1, None))


# --- reads with filters ----------------------------------------------------------


@query
def find_events(spark, d):
    events = tt.cart_events(spark, d)
    return finders.find_events(
        events, 100, 20, event_type="add_to_cart", source="website", start_date="2024-01-05", end_date="2024-01-20"
    ).select(*RAW_COLUMNS)


@query
def find_events_total(spark, d):
    from tillstream.operators.ranking import total

    events = tt.cart_events(spark, d)
    return total(finders.events_where(events, device="mobile", start_date="2024-01-05", end_date="2024-01-20"))


@query
def events_for_customer(spark, d):
    return finders.events_for_customer(tt.cart_events(spark, d), 42).select(*RAW_COLUMNS)


@query
def events_for_product(spark, d):
    return finders.events_for_product(tt.cart_events(spark, d), 3, 500).select(*RAW_COLUMNS)


@query
def events_for_session(spark, d):
    return finders.events_for_session(tt.cart_events(spark, d, "user"), "u42").select(*RAW_COLUMNS)


@query
def events_for_keys(spark, d):
    """Events of all customers of one market segment."""
    wanted = tt.customers(spark, d).filter("city = 'BUILDING'").selectExpr("id as customer_id")
    return finders.rows_for_keys(tt.cart_events(spark, d), wanted, "customer_id").select(*RAW_COLUMNS)


ORDER_COLUMNS = ["order_id", "customer_id", "channel", "created_at", "status", "payment_status", "total"]


@query
def find_orders(spark, d):
    return finders.find_orders(
        tt.online_orders(spark, d),
        100,
        10,
        channel="website",
        status="completed",
        start_date="1996-01-01",
        end_date="2000-06-30",
        min_total=200000,
        max_total=0,
    ).select(*ORDER_COLUMNS)


@query
def find_orders_by_payment(spark, d):
    return finders.find_orders(tt.online_orders(spark, d), 200, payment_status="paid", max_total=90000).select(
        *ORDER_COLUMNS
    )


@query
def order_by_id(spark, d):
    return finders.order_by_id(tt.online_orders(spark, d), "ORD777").select(*ORDER_COLUMNS)


@query
def orders_for_customer(spark, d):
    return finders.orders_for_customer(tt.online_orders(spark, d), 42).select(*ORDER_COLUMNS)


@query
def orders_for_channel(spark, d):
    return finders.orders_for_channel(tt.online_orders(spark, d), "lazada", "processing").select(*ORDER_COLUMNS)


@query
def shopify_orders_page(spark, d):
    return finders.numbered_page(tt.shopify_orders(spark, d), 3, 40, payment_status="paid").select(
        "id", "order_number", "payment_status", "total_vnd"
    )


@query
def sapo_orders_page(spark, d):
    return finders.numbered_page(tt.sapo_orders(spark, d), 2, 25, location_id=7, status="completed").select(
        "id", "code", "location_id", "status", "total_vnd"
    )


@query
def find_payments(spark, d):
    tx = tt.paypal_transactions(spark, d)
    return finders.find_payments(tx, "COMPLETED", "1997-01-01", "1999-12-31", 100).select(
        "transaction_id", "transaction_initiation_date", "transaction_status"
    )


@query
def find_momo(spark, d):
    return finders.find_momo(tt.momo_transactions(spark, d), 0, "1996-01-01", None, 100000, 300000).select(
        "orderId", "resultCode", "amount", "responseTimeISO"
    )


@query
def find_zalopay(spark, d):
    return finders.find_zalopay(tt.zalopay_transactions(spark, d), 1, None, "2000-01-01", None, None, 38).select(
        "app_trans_id", "return_code", "amount", "channel", "server_time_iso"
    )


@query
def account_transactions(spark, d):
    return finders.account_transactions(tt.mercury_transactions(spark, d), "ACC1", "posted", "1996-01-01").select(
        "transaction_id", "account_id", "amount", "kind", "created_at"
    )


@query
def bank_transactions(spark, d):
    return finders.bank_transactions(tt.mercury_transactions(spark, d), "incomingAch", 100).select(
        "transaction_id", "account_id", "amount", "kind", "created_at"
    )


MOMO_ANSWER = ["partnerCode", "orderId", "amount", "transId", "payType", "resultCode", "message"]


@query
def momo_lookup(spark, d):
    """One enquiry per order line's order (some ids unknown), by order or request id."""
    asked = tt.order_lines(spark, d).selectExpr(
        "concat(order_id, '#', product_id) as query_id",
        "if(product_id % 4 = 0, null, if(product_id % 9 = 0, concat(order_id, 'X'), order_id)) as order_id",
        "if(product_id % 4 = 0, concat('MOMO', product_id), null) as request_id",
    ).distinct()
    code, message = payments.MOMO_NOT_FOUND
    return finders.wallet_lookup(
        tt.momo_transactions(spark, d),
        asked,
        {"order_id": "orderId", "request_id": "requestId"},
        MOMO_ANSWER,
        {"partnerCode": "MERCHANT01", "resultCode": code, "message": message},
    )


@query
def zalopay_lookup(spark, d):
    """One enquiry per order, by the wallet's own number; two in three are unknown."""
    asked = tt.online_orders(spark, d).selectExpr(
        "order_id as query_id", "200000000000000 + ingest_ord * 3 as zp_trans_id", "cast(null as string) as app_trans_id"
    )
    code, message = payments.ZALOPAY_NOT_FOUND
    return finders.wallet_lookup(
        tt.zalopay_transactions(spark, d),
        asked,
        {"zp_trans_id": "zp_trans_id", "app_trans_id": "app_trans_id"},
        ["return_code", "return_message", "sub_return_code", "sub_return_message", "amount"],
        {"return_code": code, "return_message": message, "sub_return_code": 0, "sub_return_message": ""},
    )


@query
def momo_query(spark, d):
    code, message = payments.MOMO_NOT_FOUND
    tx = tt.momo_transactions(spark, d)
    return finders.wallet_query(
        tx, {"orderId": "ORD778", "requestId": "MOMO777"}, MOMO_ANSWER, {"resultCode": code, "message": message}
    )


@query
def find_products(spark, d):
    return finders.find_products(tt.products(spark, d), "economy", "BRAND#2", 90000, 105000, 40, 2)


@query
def find_staff(spark, d):
    return finders.find_staff(tt.staff(spark, d), "manager", "Active")


@query
def find_customers(spark, d):
    return finders.find_customers(tt.customers(spark, d), "build", "nation_1", 80, 5)


@query
def find_locations(spark, d):
    return finders.find_locations(tt.shops(spark, d).select("id", "name", "city"), "nation_2")


@query
def find_shops(spark, d):
    return finders.find_shops(tt.shops(spark, d), "A", "vnd")


@query
def customer_by_id(spark, d):
    return finders.by_id(tt.customers(spark, d), 42)


@query
def product_by_id(spark, d):
    return finders.by_id(tt.products(spark, d), 42)


@query
def staff_by_id(spark, d):
    return finders.by_id(tt.staff(spark, d), 7)


@query
def entity_details(spark, d):
    """Every order with its customer's name and country, kept when the customer is unknown."""
    facts = tt.online_orders(spark, d).select("order_id", "customer_id")
    return lookup.with_details(facts, tt.customers(spark, d), "customer_id", ["full_name", "country"], "customer")


# --- orders ----------------------------------------------------------------------


@query
def customer_order_stats(spark, d):
    return orders.customer_order_stats(tt.online_orders(spark, d))


@query
def channel_stats(spark, d):
    return orders.channel_stats(tt.online_orders(spark, d))


@query
def order_status_counts(spark, d):
    return orders.order_counts(tt.online_orders(spark, d), "status")


@query
def order_payment_counts(spark, d):
    return orders.order_counts(tt.online_orders(spark, d), "payment_method")


@query
def order_totals(spark, d):
    return rounded(orders.order_totals(tt.online_orders(spark, d)), "conversion_exact")


@query
def top_products_sold(spark, d):
    done = tt.online_orders(spark, d).select("order_id", "status").filter("status = 'completed'")
    names = tt.products(spark, d).selectExpr("id as product_id", "name as product_name")
    return orders.top_products_sold(tt.order_lines(spark, d).join(done, "order_id"), names=names)


@query
def customer_history(spark, d):
    history = orders.all_channel_orders(tt.shopify_orders(spark, d), tt.sapo_orders(spark, d))
    wanted = tt.customers(spark, d).filter("city = 'MACHINERY'").selectExpr("id as customer_id")
    return finders.rows_for_keys(history, wanted, "customer_id")


@query
def customer_channel_summary(spark, d):
    return orders.customer_channel_summary(
        orders.all_channel_orders(tt.shopify_orders(spark, d), tt.sapo_orders(spark, d))
    )


# --- payments --------------------------------------------------------------------


@query
def momo_statistics(spark, d):
    return rounded(payments.momo_statistics(tt.momo_transactions(spark, d)), "success_exact")


@query
def momo_by_pay_type(spark, d):
    return payments.momo_by_pay_type(tt.momo_transactions(spark, d))


@query
def zalopay_statistics(spark, d):
    return rounded(payments.zalopay_statistics(tt.zalopay_transactions(spark, d)), "success_exact")


@query
def zalopay_by_channel(spark, d):
    return payments.zalopay_by_channel(tt.zalopay_transactions(spark, d))


@query
def zalopay_by_bank(spark, d):
    return payments.zalopay_by_bank(tt.zalopay_transactions(spark, d))


@query
def zalopay_items(spark, d):
    return payments.zalopay_items(tt.zalopay_transactions(spark, d))


@query
def payment_view(spark, d):
    return payments.payment_view(tt.paypal_transactions(spark, d))


@query
def momo_query_view(spark, d):
    view = payments.momo_query_view(tt.momo_transactions(spark, d))
    return view.withColumns(
        {
            "extraData": F.col("extraData.store_id"),
            "refundTrans": F.size("refundTrans"),
            "promotionInfo": F.size("promotionInfo"),
        }
    )


@query
def zalopay_query_view(spark, d):
    return payments.zalopay_query_view(tt.zalopay_transactions(spark, d))


@query
def balance_view(spark, d):
    return payments.balance_view(tt.bank_accounts(spark, d), AS_OF)


@query
def account_activity(spark, d):
    return rounded(payments.account_activity(tt.mercury_transactions(spark, d)), "net_amount", "credits", digits=2)


@query
def momo_refunds(spark, d):
    return payments.refund_summary(tt.momo_transactions(spark, d), "refundTrans", "orderId")


@query
def zalopay_refunds(spark, d):
    return payments.refund_summary(tt.zalopay_transactions(spark, d), "refund_history", "app_trans_id")


# --- lookup and reconciliation ---------------------------------------------------


def _sources(spark, d) -> dict[str, DataFrame]:
    return {
        "paypal": tt.paypal_transactions(spark, d),
        "mercury": tt.mercury_transactions(spark, d),
        "momo": tt.momo_transactions(spark, d),
        "zalopay": tt.zalopay_transactions(spark, d),
        "shopify": tt.shopify_orders(spark, d),
        "sapo": tt.sapo_orders(spark, d),
        "odoo": tt.odoo_orders(spark, d),
    }


@query
def transaction_lookup(spark, d):
    """Every online order's transaction id, searched for in all seven sources."""
    found = lookup.transaction_lookup(tt.online_orders(spark, d), _sources(spark, d))
    return found.withColumn("found_in_sources", F.array_join("found_in_sources", ","))


@query
def transaction_matches(spark, d):
    """The matches themselves, reduced to the row each source answered with."""
    found = lookup.transaction_matches(tt.online_orders(spark, d), _sources(spark, d))
    return found.select(
        "transaction_id", "source", F.get_json_object("data", "$.ingest_ord").cast("bigint").alias("row_no")
    )


@query
def find_transaction(spark, d):
    found = lookup.find_transaction("TXN105", _sources(spark, d))
    return found.select(
        "transaction_id", "source", F.get_json_object("data", "$.ingest_ord").cast("bigint").alias("row_no")
    )


def _reconciled(spark, d, how):
    amount = lambda c: F.col(c).cast("decimal(18,2)")
    placed = tt.table(spark, d, "orders").select(
        F.concat(F.lit("TXN"), "o_orderkey").alias("transaction_id"), amount("o_totalprice").alias("order_amount")
    )
    bank = tt.mercury_transactions(spark, d).select("transaction_id", F.col("amount_usd").alias("deposit"), "ingest_ord")
    return lookup.payment_reconciliation(placed, quality.gateway_fees(tt.paypal_transactions(spark, d)), bank, how)


@query
def payment_reconciliation(spark, d):
    return rounded(_reconciled(spark, d, "left"), "net_amount", "bank_delta", digits=2)


@query
def reconciliation_summary(spark, d):
    """All rows of orders, gateway and bank, matched or not, counted by outcome."""
    return _reconciled(spark, d, "full").groupBy("status").agg(F.count(F.lit(1)).alias("transactions"))


@query
def referential_check(spark, d):
    placed, lines = tt.online_orders(spark, d), tt.order_lines(spark, d)
    return lookup.referential_check(
        {
            "order_customer": (placed, "customer_id", tt.customers(spark, d)),
            "line_product": (lines, "product_id", tt.products(spark, d)),
            "event_customer": (tt.cart_events(spark, d), "customer_id", tt.staff(spark, d)),
        }
    )


# --- rules -----------------------------------------------------------------------


@query
def line_pricing_check(spark, d):
    return quality.line_pricing_check(tt.order_lines(spark, d))


@query
def order_pricing_check(spark, d):
    return quality.order_pricing_check(tt.online_orders(spark, d)).select(
        "order_id", "tax_amount", "expected_tax", "total", "expected_total"
    )


@query
def order_line_totals(spark, d):
    return quality.order_line_totals(tt.online_orders(spark, d), tt.order_lines(spark, d))


@query
def pos_pricing_check(spark, d):
    return quality.pos_pricing_check(tt.sapo_orders(spark, d)).select("id", "vat_amount", "expected_vat")


@query
def shop_pricing_check(spark, d):
    return quality.shop_pricing_check(tt.shopify_orders(spark, d)).select("id", "tax_vnd", "total_vnd")


@query
def fx_check(spark, d):
    return quality.fx_check(tt.shopify_orders(spark, d), "subtotal_vnd", "subtotal_usd").select("id", "subtotal_vnd")


@query
def gateway_fee_check(spark, d):
    return quality.gateway_fee_check(tt.paypal_transactions(spark, d)).drop("ingest_ord")


@query
def payment_status_rule(spark, d):
    return quality.payment_status_check(tt.online_orders(spark, d)).select(
        "order_id", "status", "payment_status", "expected_payment_status"
    )


@query
def signed_amount_rule(spark, d):
    return quality.signed_amount_check(tt.mercury_transactions(spark, d)).select("transaction_id", "kind", "amount")


@query
def momo_signature_check(spark, d):
    return quality.momo_signature_check(tt.momo_transactions(spark, d)).select("orderId", "amount")


@query
def zalopay_mac_check(spark, d):
    return quality.zalopay_mac_check(tt.zalopay_transactions(spark, d)).select("app_trans_id", "amount")


@query
def id_format_check(spark, d):
    """Ids of three tables against their formats; wallet numbers must have six digits."""
    checked = [
        (tt.zalopay_transactions(spark, d), "app_trans_id", "app_trans_id"),
        (tt.shopify_orders(spark, d), "order_number", "order_number"),
        (tt.staff(spark, d), "code", "staff_code"),
    ]
    parts = [
        quality.id_format_check(df, column, kind).select(F.lit(kind).alias("kind"), F.col(column).alias("bad_id"))
        for df, column, kind in checked
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _coded_orders(spark, d) -> DataFrame:
    """Orders with ids of four kinds; some have too few digits, some a day that isn't one."""
    day = "if(o_orderkey % 53 = 0, '20230231', date_format(o_orderdate, 'yyyyMMdd'))"
    number = "substring(cast(1000000000 + o_orderkey as string), if(o_orderkey % 59 = 0, 8, 3))"
    return tt.table(spark, d, "orders").selectExpr(
        f"concat('TXN', {day}, {number}) as transaction_id",
        f"concat('CN', substring({number}, 6)) as location_code",
        f"concat('HD', substring({day}, 3), {number}) as pos_code",
        f"concat('POS-', {number}) as pos_order_code",
    )


@query
def code_format_check(spark, d):
    """The other four formats."""
    coded = _coded_orders(spark, d)
    parts = [quality.id_format_check(coded, kind, kind).select(F.lit(kind).alias("kind"), F.col(kind).alias("bad_id")) for kind in coded.columns]
    return reduce(DataFrame.unionByName, parts)


@query
def id_date_check(spark, d):
    """Well-formed ids whose date doesn't exist."""
    coded = _coded_orders(spark, d)
    wallets = tt.zalopay_transactions(spark, d).select("app_trans_id")
    shop = tt.shopify_orders(spark, d).select("order_number")
    checked = [(coded, "transaction_id"), (coded, "pos_code"), (wallets, "app_trans_id"), (shop, "order_number")]
    parts = [quality.id_date_check(df, kind, kind).select(F.lit(kind).alias("kind"), F.col(kind).alias("bad_id")) for df, kind in checked]
    return reduce(DataFrame.unionByName, parts)


@query
def shop_usd_check(spark, d):
    """Web-shop orders whose USD side was cut to cents, not rounded."""
    recorded = tt.shopify_orders(spark, d).withColumn("subtotal_usd", F.expr("floor(subtotal_vnd / 240) / 100")).selectExpr(
        "id", "shipping_vnd", "subtotal_usd", "floor(subtotal_usd * 10) / 100 as tax_usd", "floor(shipping_vnd / 240) / 100 as shipping_usd"
    )
    found = quality.shop_usd_check(recorded.withColumn("total_usd", F.expr("subtotal_usd + tax_usd + shipping_usd")))
    return rounded(found, "total_usd")


@query
def money_columns(spark, d):
    """Prices over to the other currency and back, and rounded to the thousand and to cents."""
    vnd = F.col("price_vnd")
    usd = usd_from_vnd(vnd)
    return tt.products(spark, d).select(
        "id", usd.alias("usd"), vnd_from_usd(usd).alias("vnd"), nearest(vnd, 1000).alias("thousands"), half_even(vnd / 8, 2).alias("eighth")
    )


@query
def code_columns(spark, d):
    """Numbers padded into codes, and times without their zone mark."""
    return tt.cart_events(spark, d).where("customer_id is not null").select(
        "event_id",
        "ingest_ord",
        padded("CUST", F.col("customer_id"), 4).alias("code"),
        iso_text(F.concat("timestamp", F.lit("Z"))).alias("zulu"),
        iso_text(F.concat("timestamp", F.lit("+00:00"))).alias("utc"),
    )


def _nested_orders(spark, d) -> DataFrame:
    """Orders with their lines inside, and the subtotal that the lines record."""
    lines = tt.order_lines(spark, d).withColumn("weight_kg", F.col("quantity") * 0.125)
    line = F.struct("line_number", "product_id", "quantity", "unit_price", "discount_percent", "discount_amount", "line_total", "weight_kg")
    return lines.groupBy("order_id").agg(
        F.sort_array(F.collect_list(line)).alias("line_items"), F.sum("line_total").alias("subtotal"), F.min("ingest_ord").alias("ingest_ord")
    )


@query
def nested_order_measures(spark, d):
    return _nested_orders(spark, d).select("order_id", *[c.alias(n) for n, c in orders.line_measures().items()])


@query
def nested_subtotal_check(spark, d):
    return quality.nested_subtotal_check(_nested_orders(spark, d)).select("order_id", "subtotal", "expected_subtotal")


@query
def exploded_lines(spark, d):
    return orders.exploded_lines(_nested_orders(spark, d), ["order_id"]).select("order_id", "line_pos", "product_id", "quantity", "line_total")


@query
def pos_line_discounts(spark, d):
    """Discounts of store lines, rounded half-even to the thousand."""
    discount = quality.pos_line_discount(F.col("unit_price"), F.col("quantity"), F.col("discount_percent"))
    return tt.order_lines(spark, d).select("order_id", "line_number", discount.alias("discount"))


@query
def embedded_store(spark, d):
    """Store and customer out of the JSON text of wallet payments."""
    tx = tt.zalopay_transactions(spark, d)
    store = F.struct(F.concat(F.lit("TS"), F.col("customer_id") % 50).alias("store_id"), F.concat(F.lit('An "'), "customer_id").alias("customer_name"))
    return payments.embedded_store(tx.withColumn("embed_data", F.to_json(F.struct(store.alias("columninfo")))))


@query
def malformed_events(spark, d):
    """Raw events whose time can't be read."""
    garbled = F.when(F.col("ingest_ord") % 97 == 0, F.concat("timestamp", F.lit("?"))).when(F.col("ingest_ord") % 89 != 0, F.col("timestamp"))
    return cleaning.malformed_events(tt.cart_events(spark, d).withColumn("timestamp", garbled)).select("event_id", "ingest_ord", "timestamp")


@query
def duplicate_ids(spark, d):
    return quality.duplicate_ids(tt.cart_events(spark, d), "event_id")


@query
def duplicate_transactions(spark, d):
    return quality.duplicate_ids(tt.sapo_orders(spark, d), "transaction_id")


@query
def line_total_check(spark, d):
    return quality.line_total_check(_typed(spark, d)).select(
        "event_id", "ingest_ord", "product_price_vnd", "quantity", "line_total_vnd"
    )


# --- ids, sinks, streams ---------------------------------------------------------


@query
def max_ids(spark, d):
    return keys.max_ids(
        {
            "products": (tt.products(spark, d), "id"),
            "customers": (tt.customers(spark, d), "id"),
            "staff": (tt.staff(spark, d), "id"),
            "orders": (tt.shopify_orders(spark, d), "id"),
        }
    )


@query
def append_surrogate_ids(spark, d):
    """All order lines' orders appended behind the customers' ids, in order-key order."""
    new = tt.table(spark, d, "orders").selectExpr("o_orderkey as ingest_ord", "o_custkey as customer_id")
    return keys.append_surrogate_ids(tt.customers(spark, d), new, block=1000)


@query
def pipeline_events_table(spark, d):
    out = scratch_path(spark, "pipeline")
    paths = pipeline.run_transformation(tt.cart_events(spark, d), out)
    return readers.read_table(spark, paths[pipeline.EVENTS]).select(*ENRICHED)


@query
def pipeline_run_statistics(spark, d):
    """The counters that the run itself observes."""
    paths = pipeline.run_transformation(tt.cart_events(spark, d), scratch_path(spark, "pipeline"))
    return readers.read_table(spark, paths[pipeline.STATISTICS])


@query
def pipeline_rerun_smaller(spark, d):
    """A run over everything, then one over fewer dates into the same folder: the second is all there is."""
    out, raw = scratch_path(spark, "rerun"), tt.cart_events(spark, d)
    pipeline.run_transformation(raw, out)
    paths = pipeline.run_transformation(raw.where(F.col("timestamp") < "2024-01-05"), out)
    return readers.read_table(spark, paths[pipeline.EVENTS]).select(*ENRICHED)


def _appended(spark, d) -> str:
    """The first days as a run, the rest as an appended batch; sessions span both."""
    out, raw = scratch_path(spark, "append"), tt.cart_events(spark, d)
    early = F.col("timestamp") < "2024-01-16"
    pipeline.run_transformation(raw.where(early), out)
    pipeline.append_events(spark, raw.where(~early | F.col("timestamp").isNull()), out)
    return out


@query
def pipeline_append(spark, d):
    return readers.read_table(spark, f"{_appended(spark, d)}/{pipeline.EVENTS}").select(*ENRICHED)


@query
def pipeline_append_sessions(spark, d):
    return readers.read_table(spark, f"{_appended(spark, d)}/{pipeline.SESSIONS}")


def _published(spark, d) -> str:
    """The first days as a published run, then two batches; sessions span them."""
    out, raw = scratch_path(spark, "published"), tt.cart_events(spark, d)
    early, late = F.col("timestamp") < "2024-01-16", F.col("timestamp") >= "2024-01-24"
    versions.publish_run(raw.where(early), out)
    versions.publish_append(spark, raw.where(~early & ~late), out)
    versions.publish_append(spark, raw.where(late | F.col("timestamp").isNull()), out)
    return out


@query
def published_events(spark, d):
    return versions.published_events(spark, _published(spark, d)).select(*ENRICHED)


@query
def published_summary(spark, d):
    """The summary after two batches, each of which computed its own dates."""
    found = versions.published_table(spark, _published(spark, d), pipeline.SUMMARY)
    counts = [F.col(c).cast("bigint").alias(c) for c in ("total_events", "unique_sessions", "unique_customers")]
    return found.select("date", *counts, _kinds("event_type_distribution").alias("event_type_distribution"))


@query
def pipeline_session_table(spark, d):
    out = scratch_path(spark, "sessions")
    sinks.write_table(_sessions(spark, d), out)
    return readers.read_table(spark, out)


def _kinds(column: str):
    """A written map of counts as sorted text."""
    pairs = F.map_entries(F.from_json(column, "map<string, bigint>"))
    return F.array_join(F.array_sort(F.transform(pairs, lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")


@query
def pipeline_summary_csv(spark, d):
    out = scratch_path(spark, "summary")
    sinks.write_csv(metrics.daily_summary(_prepared(spark, d)), out)
    csv = spark.read.option("header", True).schema(
        "date string, total_events bigint, unique_sessions bigint, unique_customers bigint, event_type_distribution string"
    )
    # quotes inside a field are escaped by a backslash, Spark's default on both sides
    return csv.csv(out).withColumn("event_type_distribution", _kinds("event_type_distribution"))


@query
def json_lines_roundtrip(spark, d):
    out = scratch_path(spark, "jsonl")
    sinks.write_json_lines(tt.cart_events(spark, d).drop("ingest_ord"), out)
    back = readers.read_json_lines(spark, "cart_events", out)
    return back.select("event_id", "event_type", "timestamp", "session_id", "customer_id", "product_price_vnd", "quantity")


@query
def guarded_append(spark, d):
    """A first load, an append of the rest, and the whole table read back sorted by time."""
    out = scratch_path(spark, "orders")
    placed = tt.online_orders(spark, d)
    sinks.write_guarded(placed.filter("status = 'completed'"), out)
    sinks.write_guarded(placed.filter("status = 'processing'"), out, method="new")
    sinks.append_sorted(placed.filter("status = 'cancelled'"), out, [F.desc("created_at"), "ingest_ord"])
    return readers.read_table(spark, out).select(*ORDER_COLUMNS)


def _array_files(spark, d, folder) -> None:
    """Customers as numbered files of one JSON array each, by their number.

    One job writes them all, each in a folder with its file's name: ``name=customers_batch_<n>.json``.
    """
    rows = tt.customers(spark, d).selectExpr("id", "full_name", "city", "country", f"(id - 1) div {readers.CUSTOMER_BATCH // 50} as batch")
    texts = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("id", F.to_json(F.struct("id", "full_name", "city", "country")).alias("j"))))["j"].alias("all"))
    name = F.format_string("customers_batch_%s.json", F.coalesce(F.col("batch").cast("string"), F.lit("")))
    whole = texts.select(name.alias("name"), F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")).alias("value"))
    whole.write.partitionBy("name").text(folder)


@query
def batched_files(spark, d):
    """All numbered array files of a table, with the file each row came from and its place there."""
    folder = scratch_path(spark, "batched")
    _array_files(spark, d, folder)
    rows = readers.read_batched(spark, "customers", folder)
    place = F.row_number().over(W.partitionBy("batch").orderBy("ingest_ord"))
    return rows.select("id", "full_name", "city", "country", "batch", place.alias("place"))


@query
def converted_batch(spark, d):
    """One batch out of the converted table: a filter on its folder."""
    folder, out = scratch_path(spark, "batched"), scratch_path(spark, "converted")
    _array_files(spark, d, folder)
    readers.convert_batched(spark, "customers", folder, out)
    return readers.read_converted(spark, out, 3).select("id", "full_name", "city", "country")


@query
def path_fallback(spark, d):
    """The first place that exists: an absent one before the older one, and nothing where none does."""
    folder = scratch_path(spark, "batched")
    _array_files(spark, d, folder)
    found = readers.read_json_arrays(spark, "customers", f"{folder}/new/*.json", f"{folder}/name=customers_batch_1.json")
    none = readers.read_json_arrays(spark, "customers", f"{folder}/nowhere/*.json")
    return found.unionByName(none).select("id", "full_name")


PAGE_ORDER = [("created_at", False), ("ingest_ord", True)]


@query
def deep_page(spark, d):
    """Page 250 of the orders, newest first, out of the one range that holds it."""
    path = scratch_path(spark, "pages")
    pages.write_pages(tt.online_orders(spark, d), PAGE_ORDER, path, 32)
    return pages.read_page(spark, path, PAGE_ORDER, 50, 249 * 50).select(*ORDER_COLUMNS)


@query
def page_after(spark, d):
    """The completed orders that follow a given row."""
    path = scratch_path(spark, "pages")
    pages.write_pages(tt.online_orders(spark, d), PAGE_ORDER, path, 32)
    cursor = {"created_at": "1995-06-01T00:00:00", "ingest_ord": 0}
    return pages.read_page(spark, path, PAGE_ORDER, 50, after=cursor, where=F.col("status") == "completed").select(*ORDER_COLUMNS)


STREAM_COLUMNS = ["event_id", "session_id", "event_type", "timestamp", "date", "hour", "utm_source", "referrer"]

DELIVERIES = 4
# By hour of the day every delivery has events of all dates, mostly out of order; by date they are in order.
_DELIVERY = {
    "hour": "least(cast(substring(timestamp, 12, 2) as int) div 6 + if(ingest_ord >= 1000000000000, 1, 0), 3)",
    "date": "(cast(substring(timestamp, 9, 2) as int) - 1) div 8",
}


def _delivered(spark, d, receive, by="hour", session_by="day") -> None:
    """All raw events in four deliveries; ``receive`` runs a stream over each, from its last checkpoint.

    By hour, the second copy of an event comes one delivery after the first.
    """
    staged, arriving = scratch_path(spark, "staged"), scratch_path(spark, "arriving")
    part = F.coalesce(F.expr(_DELIVERY[by]), F.lit(0)).cast("int")
    tt.cart_events(spark, d, session_by).withColumn("delivery", part).write.partitionBy("delivery").parquet(staged)
    parts = spark.read.parquet(staged)
    for n in range(DELIVERIES):
        parts.where(F.col("delivery") == n).drop("delivery").write.mode("append").parquet(arriving)
        receive(readers.stream_parquet(spark, arriving, files_per_batch=1_000_000))


#: Files of a micro-batch of ``_arriving``.
FILES = 8


def _arriving(spark, d, session_by="day") -> DataFrame:
    """All raw events as a stream of ten micro-batches: four days each, some hours one or two batches late.

    Each is written to ``FILES`` files by as many tasks, from its own folder of the staged table. A task
    without rows writes none, so empty files make up the number.
    """
    staged, folder = scratch_path(spark, "staged"), scratch_path(spark, "arriving")
    part = F.coalesce(F.expr("(cast(substring(timestamp, 9, 2) as int) - 1) div 4 + cast(substring(timestamp, 12, 2) as int) % 3"), F.lit(0))
    tt.cart_events(spark, d, session_by).withColumn("delivery", part).write.partitionBy("delivery").parquet(staged)
    raw = spark.read.parquet(staged)
    for n in range(10):
        raw.where(F.col("delivery") == n).drop("delivery").repartition(FILES).write.mode("append").parquet(folder)
        for _ in range(readers.count_files(spark, f"{folder}/*.parquet"), (n + 1) * FILES):
            raw.limit(0).drop("delivery").coalesce(1).write.mode("append").parquet(folder)
    return readers.stream_parquet(spark, folder, files_per_batch=FILES)


@query
def stream_cleaned_events(spark, d):
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    _delivered(spark, d, lambda raw: ingest.append_by_date(ingest.dedup_stream(ingest.clean_stream(raw)), out, checkpoint))
    return readers.read_table(spark, out).select(*STREAM_COLUMNS)


@query
def stream_exact_events(spark, d):
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    _delivered(spark, d, lambda raw: ingest.run_batches(raw, ingest.exact_writer(out), checkpoint))
    return _events_out(readers.read_table(spark, out))


@query
def stream_json_files(spark, d):
    """All raw events as files of JSON lines, streamed from there into the exact table."""
    lines, out, checkpoint = scratch_path(spark, "lines"), scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    sinks.write_json_lines(tt.cart_events(spark, d).drop("ingest_ord"), lines)
    raw = readers.stream_json_lines(spark, "cart_events", lines)
    ingest.run_batches(raw, ingest.exact_writer(out), checkpoint)
    return readers.read_table(spark, out).select(*STREAM_COLUMNS)


@query
def stream_run_counters(spark, d):
    out, aside, counters, checkpoint = [scratch_path(spark, n) for n in ("stream", "aside", "counters", "checkpoint")]
    writer = ingest.exact_writer(out, aside, counters)
    _delivered(spark, d, lambda raw: ingest.run_batches(raw, writer, checkpoint))
    return ingest.run_counters(spark, counters)


@query
def stream_progress(spark, d):
    """What the micro-batches of the late carts report: rows that came in, and rows dropped as late."""
    folder = scratch_path(spark, "progress")
    log = progress.ProgressLog(spark, folder)
    spark.streams.addListener(log)
    try:
        _carts_left(spark, d, "1 hour")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    return progress.totals(progress.read_progress(spark, folder)).select("input_rows", "late_rows")


def _garbled(raw: DataFrame) -> DataFrame:
    return raw.withColumn("timestamp", F.when(F.col("ingest_ord") % 53 == 0, F.concat(F.lit("on "), "timestamp")).otherwise(F.col("timestamp")))


@query
def stream_set_aside(spark, d):
    """Of a stream with some unreadable times: the cleaned events and, marked, the rows set aside."""
    out, aside, first, second = [scratch_path(spark, n) for n in ("stream", "aside", "checkpoint", "checkpoint")]

    def receive(raw):
        ingest.append_by_date(ingest.dedup_stream(ingest.clean_stream(_garbled(raw))), out, first)
        ingest.set_aside(_garbled(raw), aside, second)

    _delivered(spark, d, receive)
    kept = readers.read_table(spark, out).select("event_id", F.lit(None).cast("bigint").alias("ingest_ord"))
    return kept.unionByName(readers.read_table(spark, aside).select("event_id", "ingest_ord"))


@query
def stream_late_events(spark, d):
    """Events more than a day behind the newest of the deliveries before theirs."""
    out, seen, checkpoint = scratch_path(spark, "late"), scratch_path(spark, "seen"), scratch_path(spark, "checkpoint")
    writer = ingest.late_writer(out, seen, "1 day")
    _delivered(spark, d, lambda raw: ingest.run_batches(_zoned(cleaning.typed_events(raw)), writer, checkpoint))
    return readers.read_table(spark, out).select("event_id", "ingest_ord", "session_id", "timestamp")


@query
def stream_session_totals(spark, d):
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")

    def receive(raw):
        totals = ingest.session_totals(ingest.dedup_stream(ingest.clean_stream(raw)))
        ingest.run_batches(totals, ingest.latest_writer(out), checkpoint, "update")

    _delivered(spark, d, receive)
    return ingest.latest_rows(spark, out, "session_id")


@query
def stream_as_of_batch(spark, d):
    """All events as one batch: the columns as of that batch are those of whole sessions."""
    out, state, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "state"), scratch_path(spark, "checkpoint")
    raw = tt.as_cart_events(readers.stream_parquet(spark, d, "events.parquet"))
    writer = ingest.as_of_batch_writer(out, state)
    ingest.run_batches(ingest.dedup_stream(ingest.clean_stream(raw)), writer, checkpoint)
    return readers.read_table(spark, out).select(*ENRICHED)


@query
def stream_as_of_deliveries(spark, d):
    """Session columns as known at each of four deliveries."""
    out, state, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "state"), scratch_path(spark, "checkpoint")
    writer = ingest.as_of_batch_writer(out, state)
    _delivered(spark, d, lambda raw: ingest.run_batches(ingest.dedup_stream(ingest.clean_stream(raw)), writer, checkpoint))
    return readers.read_table(spark, out).select(*ENRICHED)


def _zoned(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.col("event_time").cast("timestamp"))


def _activity(raw: DataFrame) -> DataFrame:
    return activity.activity_windows(_zoned(cleaning.typed_events(raw)), "24 hours", "1 hour")


@query
def stream_activity_windows(spark, d):
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    writer = ingest.latest_writer(out)
    _delivered(spark, d, lambda raw: ingest.run_batches(_activity(raw), writer, checkpoint), "date", "user")
    return readers.read_table(spark, out).drop("batch_id")


def _carts_left(spark, d, delay) -> DataFrame:
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    events = _zoned(cleaning.typed_events(_arriving(spark, d, "user")))
    ingest.run_batches(activity.carts_left(events, "24 hours", delay), ingest.latest_writer(out), checkpoint)
    return activity.carts_left_now(spark, out)


@query
def stream_carts_left(spark, d):
    """Carts of sessions that go inactive, from the stream's own state; the delay covers the disorder."""
    return _carts_left(spark, d, "9 days")


@query
def stream_carts_left_late(spark, d):
    """With a short delay: of the events that come in time; ``stream_carts_late_rows`` has the others."""
    return _carts_left(spark, d, "1 hour")


@query
def stream_carts_late_rows(spark, d):
    """The events that the stream of ``stream_carts_left_late`` doesn't take."""
    out, seen, checkpoint = scratch_path(spark, "late"), scratch_path(spark, "seen"), scratch_path(spark, "checkpoint")
    events = _zoned(cleaning.typed_events(_arriving(spark, d, "user")))
    ingest.run_batches(events, ingest.late_writer(out, seen, "1 hour", behind=2), checkpoint)
    return readers.read_table(spark, out).select("event_id", "ingest_ord", "session_id", "timestamp")
