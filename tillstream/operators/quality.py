"""Business rules recomputed over whole tables; each check returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions import VND_PER_USD, half_even, nearest, sha256_of, truncated, usd_from_vnd

# The rates, signs and id formats of the rules.
VAT_RATE = 0.1
GATEWAY_RATE, GATEWAY_FIXED = "0.034", "0.30"
CREDIT_KINDS = ["incomingDomesticWire", "incomingAch"]
PAID_STATUSES = ["completed", "delivered", "shipping"]
ID_FORMATS = {
    "transaction_id": r"^TXN\d{16}$",
    "staff_code": r"^NV\d{4,}$",
    "location_code": r"^CN\d{3,}$",
    "order_number": r"^ORD-\d{8}-\d{6,}$",
    "pos_code": r"^HD\d{6}\d{6,}$",
    "pos_order_code": r"^POS-\d{8,}$",
    "app_trans_id": r"^\d{6}_\d{6}$",
}

#: Where an id has its date, and the date's form.
ID_DATES = {
    "transaction_id": (r"^TXN(\d{8})", "yyyyMMdd"),
    "order_number": (r"^ORD-(\d{8})", "yyyyMMdd"),
    "pos_code": (r"^HD(\d{6})", "yyMMdd"),
    "app_trans_id": (r"^(\d{6})_", "yyMMdd"),
}


def _share(amount: Column, percent: Column) -> Column:
    """Whole-unit part of a percentage, exact on whole numbers."""
    return F.floor(amount * percent / 100)


def line_discount(price: Column, quantity: Column, percent: Column) -> Column:
    return _share(price * quantity, percent)


def line_pricing_check(lines: DataFrame) -> DataFrame:
    """Flat lines whose discount or line total differs from price, quantity and percent."""
    price, quantity = F.col("unit_price"), F.col("quantity")
    expected = line_discount(price, quantity, F.col("discount_percent"))
    return (
        lines.withColumn("expected_discount", expected)
        .withColumn("expected_line_total", price * quantity - F.col("expected_discount"))
        .filter(
            (F.col("discount_amount") != F.col("expected_discount"))
            | (F.col("line_total") != F.col("expected_line_total"))
        )
    )


def order_pricing_check(orders: DataFrame) -> DataFrame:
    """Orders whose tax or total differs from subtotal, the VAT rate and shipping."""
    return (
        orders.withColumn("expected_tax", truncated(F.col("subtotal") * F.lit(VAT_RATE)))
        .withColumn("expected_total", F.col("subtotal") + F.col("expected_tax") + F.col("shipping_fee"))
        .filter((F.col("tax_amount") != F.col("expected_tax")) | (F.col("total") != F.col("expected_total")))
    )


def nested_subtotal_check(orders: DataFrame) -> DataFrame:
    """Nested orders whose subtotal is not the sum of their lines, found without a shuffle."""
    lines = F.aggregate(
        "line_items",
        F.lit(0).cast("bigint"),
        lambda a, x: a
        + x["unit_price"] * x["quantity"]
        - line_discount(x["unit_price"], x["quantity"], x["discount_percent"]),
    )
    return orders.withColumn("expected_subtotal", lines).filter(F.col("subtotal") != F.col("expected_subtotal"))


def order_line_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Recorded subtotal against the sum of flat lines, per order.

    Lines are added up per order first (on the map side too), so an order with very
    many lines arrives as one row.
    """
    sums = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("line_total").alias("lines_total")
    )
    return (
        orders.select("order_id", "subtotal")
        .join(sums, "order_id", "left")
        .withColumn("line_count", F.coalesce("line_count", F.lit(0)))
        .withColumn("lines_total", F.coalesce("lines_total", F.lit(0)))
        .withColumn("delta", F.col("subtotal") - F.col("lines_total"))
    )


def pos_pricing_check(orders: DataFrame) -> DataFrame:
    """Store orders: VAT rounded half-even to 1,000; total before discount adds the discount back."""
    vat = nearest(truncated(F.col("total_before_vat") * F.lit(VAT_RATE)), 1000)
    return orders.withColumn("expected_vat", vat).filter(
        (F.col("vat_amount") != F.col("expected_vat"))
        | (F.col("total_vnd") != F.col("total_before_vat") + F.col("vat_amount"))
        | (F.col("total_before_discount") != F.col("total_before_vat") + F.col("total_discount"))
    )


def pos_line_discount(price: Column, quantity: Column, percent: Column) -> Column:
    return nearest(line_discount(price, quantity, percent), 1000)


def shop_pricing_check(orders: DataFrame) -> DataFrame:
    """Web-shop orders: tax a truncated tenth, total the sum of its parts."""
    return orders.withColumn("expected_tax", truncated(F.col("subtotal_vnd") * F.lit(VAT_RATE))).filter(
        (F.col("tax_vnd") != F.col("expected_tax"))
        | (F.col("total_vnd") != F.col("subtotal_vnd") + F.col("tax_vnd") + F.col("shipping_vnd"))
    )


def shop_usd_check(orders: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Web-shop orders whose USD tax, shipping or total isn't the rule's, rounded to cents."""
    tax = half_even(F.col("subtotal_usd") * F.lit(VAT_RATE), 2)
    total = half_even(F.col("subtotal_usd") + F.col("tax_usd") + F.col("shipping_usd"), 2)
    expected = {"expected_tax_usd": tax, "expected_shipping_usd": usd_from_vnd(F.col("shipping_vnd")), "expected_total_usd": total}
    off = lambda name: F.abs(F.col(name) - F.col(f"expected_{name}")) > tolerance
    return orders.withColumns(expected).filter(off("tax_usd") | off("shipping_usd") | off("total_usd"))


def fx_check(df: DataFrame, vnd: str, usd: str, tolerance: float = 0.011, rate: int = VND_PER_USD) -> DataFrame:
    """Rows whose USD amount is not the VND amount at the fixed rate."""
    return df.withColumn("expected_usd", F.col(vnd) / F.lit(rate)).filter(
        F.abs(F.col(usd) - F.col("expected_usd")) > tolerance
    )


def gateway_fees(tx: DataFrame) -> DataFrame:
    """Amount, fee and net of text money columns, with the fee the rate implies."""
    money = lambda c: F.col(f"{c}.value").try_cast("decimal(18,2)")
    expected = F.expr(f"cast({GATEWAY_RATE} * amount + {GATEWAY_FIXED} as decimal(18,2))")
    return (
        tx.select("transaction_id", "ingest_ord", money("transaction_amount").alias("amount"), money("fee_amount").alias("fee"))
        .withColumn("expected_fee", expected)
        .withColumn("net", F.col("amount") - F.col("fee"))
    )


def gateway_fee_check(tx: DataFrame) -> DataFrame:
    return gateway_fees(tx).filter(F.abs(F.col("fee") - F.col("expected_fee")) > F.expr("0.01"))


def payment_status_check(orders: DataFrame) -> DataFrame:
    """Orders whose payment status does not follow from their status."""
    expected = (
        F.when(F.col("status").isin(PAID_STATUSES), "paid")
        .when(F.col("status") == "cancelled", "cancelled")
        .otherwise("pending")
    )
    return orders.withColumn("expected_payment_status", expected).filter(
        F.col("payment_status") != F.col("expected_payment_status")
    )


def signed_amount_check(tx: DataFrame) -> DataFrame:
    """Bank movements with the wrong sign for their kind."""
    credit = F.col("kind").isin(CREDIT_KINDS)
    return tx.filter((credit & (F.col("amount") < 0)) | (~credit & (F.col("amount") > 0)))


def momo_signature_check(tx: DataFrame) -> DataFrame:
    expected = sha256_of(F.col("transId"), F.col("orderId"), F.col("amount"))
    return tx.filter(F.col("signature") != expected)


def zalopay_mac_check(tx: DataFrame) -> DataFrame:
    expected = sha256_of(F.col("zp_trans_id"), F.col("app_trans_id"), F.col("amount"), separator="|")
    return tx.filter(F.col("mac") != expected)


def id_format_check(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows whose id is not of its format."""
    return df.filter(~F.coalesce(F.col(column).rlike(ID_FORMATS[kind]), F.lit(False)))


def id_date_check(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows whose id has its format, but no valid date where the format has one."""
    pattern, form = ID_DATES[kind]
    day = F.try_to_timestamp(F.regexp_extract(column, pattern, 1), F.lit(form))
    return df.filter(F.col(column).rlike(ID_FORMATS[kind]) & day.isNull())


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids used more than once, with the number of uses."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def line_total_check(events: DataFrame) -> DataFrame:
    """Cart events whose line total is not price x quantity."""
    return events.filter(F.col("line_total_vnd") != F.col("product_price_vnd") * F.col("quantity"))
