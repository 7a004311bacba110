"""Typed entity tables derived from the star-schema test tables.

Each function reads whole tables and only projects (or joins) them, so the data
an operator sees grows with the table it was derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KIND = {
    "signup": "add_to_cart",
    "click": "update_quantity",
    "error": "remove_from_cart",
    "view": "view_item",
    "purchase": "purchase",
}


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def cart_events(spark: SparkSession, sf_dir: str, session_by: str = "day") -> DataFrame:
    """Raw cart events; every 50th is delivered twice, some carry bad values or no key."""
    return as_cart_events(table(spark, sf_dir, "events"), session_by)


def as_cart_events(events: DataFrame, session_by: str = "day") -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in _KIND.items() for x in pair])
    session = (
        "concat('s', user_id, '-', date_format(ts, 'yyyyMMdd'))" if session_by == "day" else "concat('u', user_id)"
    )
    base = (
        events.withColumn("copy", F.explode(F.expr("if(event_id % 50 = 0, array(0, 1), array(0))")))
        .withColumn("kind", kind[F.col("event_type")])
        .withColumn(
            "product",
            F.expr("if(kind = 'purchase', null, cast(get_json_object(props, '$.k') as bigint) % 5 + 1)"),
        )
        .withColumn("price", F.expr("if(event_id % 97 = 0, -1, product * 1000)"))
        .withColumn("qty", F.expr("cast(floor(value) % 6 + copy as bigint)"))
    )
    return base.selectExpr(
        "concat('evt_', event_id) as event_id",
        "event_id + copy * 1000000000000 as ingest_ord",
        "kind as event_type",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") as timestamp",
        f"{session} as session_id",
        "if(user_id % 10 = 0, null, user_id) as customer_id",
        "user_id % 10 = 0 as is_guest",
        "if(user_id % 17 = 0, null, element_at(array('website','mobile_app','mobile_web'), cast(user_id % 3 + 1 as int))) as source",
        "if(user_id % 17 = 0, null, element_at(array('desktop','mobile','tablet'), cast((user_id + 1) % 3 + 1 as int))) as device",
        "if(event_id % 5 = 0, null, 'https://example.com') as referrer",
        "if(event_id % 4 = 0, null, 'newsletter') as utm_source",
        "if(event_id % 4 = 0, null, 'email') as utm_medium",
        "if(event_id % 4 = 0, null, 'spring') as utm_campaign",
        "product as product_id",
        "concat('Product ', product) as product_name",
        "cast(price as string) as product_price_vnd",
        "cast(price / 24000 as string) as product_price_usd",
        "if(event_id % 211 = 0, 'x', cast(qty as string)) as quantity",
        "cast(price * qty + if(event_id % 193 = 0, 7, 0) as string) as line_total_vnd",
        "cast(price * qty / 24000 as string) as line_total_usd",
    )


def online_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers with recorded tax, shipping and total (some recorded wrongly)."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "*",
        "cast(floor(o_totalprice) as bigint) as subtotal",
        "(o_custkey % 4) * 10000 as shipping_fee",
    ).selectExpr(
        "*",
        "cast(floor(subtotal * 0.1) as bigint) + if(o_orderkey % 101 = 0, 1, 0) as tax_amount",
    )
    return o.selectExpr(
        "concat('ORD', o_orderkey) as order_id",
        "o_orderkey as ingest_ord",
        "concat('TXN', o_orderkey) as transaction_id",
        "o_custkey as customer_id",
        "case o_orderpriority when '1-URGENT' then 'shopify' when '2-HIGH' then 'website' "
        "when '3-MEDIUM' then 'mobile_app' when '4-NOT SPECIFIED' then 'lazada' else 'shopee' end as channel",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as created_at",
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'processing' else 'cancelled' end as status",
        "case o_orderstatus when 'F' then 'paid' when 'O' then 'pending' "
        "else if(o_orderkey % 7 = 0, 'paid', 'cancelled') end as payment_status",
        "element_at(array('cod', 'bank_transfer', 'momo', 'zalopay'), cast(o_custkey % 4 + 1 as int)) as payment_method",
        "subtotal",
        "tax_amount",
        "shipping_fee",
        "subtotal + tax_amount + shipping_fee + if(o_orderkey % 103 = 0, 5, 0) as total",
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, flat; discounts are recorded wrongly on some lines."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('ORD', l_orderkey) as order_id",
        "l_partkey as product_id",
        "cast(l_linenumber as bigint) as line_number",
        "l_orderkey * 100 + l_linenumber as ingest_ord",
        "cast(floor(l_quantity) as bigint) as quantity",
        "cast(floor(l_extendedprice / l_quantity) as bigint) as unit_price",
        "cast(round(l_discount * 100) as bigint) as discount_percent",
    ).selectExpr(
        "*",
        "cast(floor(unit_price * quantity * discount_percent / 100) as bigint) "
        "+ if(product_id % 13 = 0 and line_number = 7, 1, 0) as discount_amount",
    ).selectExpr("*", "unit_price * quantity - discount_amount as line_total")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id",
        "p_name as name",
        "p_type as category",
        "p_brand as brand",
        "cast(floor(p_retailprice * 100) as bigint) as price_vnd",
        "p_retailprice as price_usd",
        "cast(p_size as bigint) as stock_quantity",
    )


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as id",
        "concat('NV', lpad(cast(s_suppkey as string), 4, '0')) as code",
        "s_name as full_name",
        "element_at(array('Store Manager', 'Sales Associate', 'Cashier', 'Stock Manager'), cast(s_nationkey % 4 + 1 as int)) as position",
        "if(s_acctbal < 0, 'inactive', 'active') as status",
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation as country (25 nations)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").selectExpr(
        "c_custkey as id", "c_name as full_name", "c_mktsegment as city", "country", "c_acctbal as balance"
    )


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").selectExpr(
        "cast(n_nationkey as bigint) as id",
        "n_name as name",
        "r_name as country",
        "n_name as city",
        "case r_name when 'EUROPE' then 'EUR' when 'AMERICA' then 'USD' else 'VND' end as currency_code",
    )


def paypal_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "*", "cast(o_totalprice as decimal(18,2)) as amount"
    ).selectExpr(
        "if(o_orderstatus = 'P', concat('GTW', o_orderkey), concat('TXN', o_orderkey)) as transaction_id",
        "o_orderkey as ingest_ord",
        "cast(1000000000 + o_orderkey as string) as paypal_transaction_id",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as transaction_initiation_date",
        "named_struct('currency_code', 'USD', 'value', cast(amount as string)) as transaction_amount",
        "named_struct('currency_code', 'USD', 'value', cast(cast(0.034 * amount + 0.30 as decimal(18,2)) "
        "+ if(o_orderkey % 89 = 0, 0.05, 0.00) as string)) as fee_amount",
        "case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'PENDING' else 'FAILED' end as transaction_status",
        "o_custkey as customer_id",
    )


def mercury_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank movements: one per order, deposits net of the gateway fee."""
    return table(spark, sf_dir, "orders").selectExpr(
        "*",
        "cast(o_totalprice as decimal(18,2)) as gross",
        "element_at(array('incomingAch', 'outgoingAch', 'incomingDomesticWire', 'outgoingDomesticWire', 'fee', "
        "'debitCardPurchase', 'internalTransfer'), cast(o_custkey % 7 + 1 as int)) as kind",
    ).selectExpr(
        "*", "cast(gross - cast(0.034 * gross + 0.30 as decimal(18,2)) as decimal(18,2)) as net"
    ).selectExpr(
        "if(o_orderpriority = '5-LOW', concat('BNK', o_orderkey), concat('TXN', o_orderkey)) as transaction_id",
        "o_orderkey as ingest_ord",
        "concat('ACC', o_custkey % 3) as account_id",
        "kind",
        "cast(if(o_custkey % 11 = 0, net + 1, net) as decimal(18,2)) as amount_usd",
        "cast(if(kind in ('incomingAch', 'incomingDomesticWire') or o_orderkey % 97 = 0, "
        "net, -net) as decimal(18,2)) as amount",
        "concat(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') as created_at",
        "case o_orderstatus when 'F' then 'posted' when 'O' then 'pending' else 'failed' end as status",
    )


def bank_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('ACC', s_suppkey) as id",
        "s_name as name",
        "if(s_nationkey % 2 = 0, 'checking', 'savings') as type",
        "s_acctbal as currentBalance",
        "s_acctbal - 10 as availableBalance",
        "'USD' as currency",
    )


def momo_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallet payments; failures are 10 (processing orders) or 99, some are refunded."""
    return table(spark, sf_dir, "orders").selectExpr(
        "*", "cast(floor(o_totalprice) as bigint) as amount", "2000000000000 + o_orderkey as trans"
    ).selectExpr(
        "concat('TXN', o_orderkey * 3) as transaction_id",
        "o_orderkey as ingest_ord",
        "o_custkey as customer_id",
        "'MERCHANT01' as partnerCode",
        "concat('ORD', o_orderkey) as orderId",
        "concat('MOMO', o_orderkey) as requestId",
        "amount",
        "trans as transId",
        "cast(case o_orderstatus when 'F' then 0 when 'O' then 10 else 99 end as bigint) as resultCode",
        "case o_orderstatus when 'F' then 'Thanh cong' when 'O' then 'He thong dang bao tri' "
        "else 'Loi khong xac dinh' end as message",
        "element_at(array('qr', 'webApp', 'credit', 'napas'), cast(o_custkey % 4 + 1 as int)) as payType",
        "unix_seconds(cast(o_orderdate as timestamp)) * 1000 as responseTime",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as responseTimeISO",
        "named_struct('store_id', concat('TS', o_custkey % 50)) as extraData",
        "sha2(concat(trans, 'ORD', o_orderkey, if(o_orderkey % 83 = 0, amount + 1, amount)), 256) as signature",
        "if(o_orderkey % 10 = 0, array(named_struct('orderId', concat('RFORD', o_orderkey), "
        "'amount', if(o_orderkey % 20 = 0, amount div 2, amount))), "
        "cast(null as array<struct<orderId: string, amount: bigint>>)) as refundTrans",
        "cast(array() as array<struct<promoCode: string, promoAmount: bigint, promoDescription: string>>) as promotionInfo",
    )


def zalopay_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallet payments with channel, bank, discount and JSON text columns."""
    return table(spark, sf_dir, "orders").selectExpr(
        "*",
        "cast(floor(o_totalprice) as bigint) as amount",
        "200000000000000 + o_orderkey as zp",
        "concat(date_format(o_orderdate, 'yyMMdd'), if(o_orderkey % 113 = 0, '-', '_'), "
        "lpad(cast(o_orderkey as string), greatest(6, length(cast(o_orderkey as string))), '0')) as app_trans",
    ).selectExpr(
        "concat('TXN', o_orderkey * 5) as transaction_id",
        "o_orderkey as ingest_ord",
        "o_custkey as customer_id",
        "cast(case o_orderstatus when 'F' then 1 when 'O' then 3 else 2 end as bigint) as return_code",
        "case o_orderstatus when 'F' then 'Thanh cong' when 'O' then 'Dang xu ly' else 'That bai' end as return_message",
        "cast(if(o_orderstatus = 'F', 1, 0) as bigint) as sub_return_code",
        "if(o_orderstatus = 'F', 'Merchant balance updated', '') as sub_return_message",
        "o_orderstatus = 'O' as is_processing",
        "amount",
        "if(o_orderkey % 5 = 0, amount div 20, 0) as discount_amount",
        "zp as zp_trans_id",
        "app_trans as app_trans_id",
        "unix_seconds(cast(o_orderdate as timestamp)) * 1000 as server_time",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as server_time_iso",
        "o_custkey % 8 + 35 as channel",
        "element_at(array('VCB', 'ACB', '', 'MB', null), cast(o_custkey % 5 + 1 as int)) as bank_code",
        "to_json(array(named_struct('itemid', concat('PROD', o_custkey), 'itemprice', amount, 'itemquantity', 1))) as item",
        "sha2(concat(zp, '|', app_trans, '|', if(o_orderkey % 79 = 0, amount + 1, amount)), 256) as mac",
        "if(o_orderkey % 10 = 1, array(named_struct('refund_id', o_orderkey, 'amount', amount div 2)), "
        "cast(array() as array<struct<refund_id: bigint, amount: bigint>>)) as refund_history",
    )


def shopify_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-shop orders; two orders share a transaction id."""
    return table(spark, sf_dir, "orders").selectExpr(
        "*", "cast(floor(o_totalprice) as bigint) as subtotal_vnd", "(o_custkey % 3) * 30000 as shipping_vnd"
    ).selectExpr("*", "subtotal_vnd div 10 as tax_vnd").selectExpr(
        "o_orderkey as id",
        "o_orderkey as ingest_ord",
        "concat('TXN', o_orderkey div 2) as transaction_id",
        "concat('ORD-', date_format(o_orderdate, 'yyyyMMdd'), '-', lpad(cast(o_orderkey as string), greatest(6, length(cast(o_orderkey as string))), '0')) as order_number",
        "o_custkey as customer_id",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as order_date",
        "case o_orderstatus when 'F' then 'paid' when 'O' then 'pending' else 'refunded' end as payment_status",
        "subtotal_vnd",
        "tax_vnd",
        "shipping_vnd",
        "subtotal_vnd + tax_vnd + shipping_vnd + if(o_orderkey % 107 = 0, 1, 0) as total_vnd",
        "bround(subtotal_vnd / 24000, 2) + if(o_orderkey % 127 = 0, 1, 0) as subtotal_usd",
        "'online' as channel",
    )


def sapo_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-of-sale orders with VAT rounded to 1,000; transaction ids repeat per customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "*", "cast(floor(o_totalprice) as bigint) as total_before_vat", "(o_custkey % 6) * 500 as total_discount"
    ).selectExpr(
        "*", "cast(bround((total_before_vat div 10) / 1000) * 1000 as bigint) + if(o_orderkey % 109 = 0, 1000, 0) as vat_amount"
    ).selectExpr(
        "o_orderkey as id",
        "o_orderkey as ingest_ord",
        "concat('TXN', o_custkey) as transaction_id",
        "concat('HD', date_format(o_orderdate, 'yyMMdd'), lpad(cast(o_orderkey as string), greatest(6, length(cast(o_orderkey as string))), '0')) as code",
        "o_custkey % 20 as location_id",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") as created_on",
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'cancelled' else 'refunded' end as status",
        "o_custkey as customer_id",
        "total_before_vat + total_discount as total_before_discount",
        "total_discount",
        "total_before_vat",
        "vat_amount",
        "total_before_vat + vat_amount as total_vnd",
        "'retail_offline' as channel",
    )


def odoo_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('TXN', o_orderkey * 7) as transaction_id", "o_orderkey as ingest_ord", "o_totalprice as amount_total"
    )
