"""Wallet, gateway and bank statistics and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions import half_even, ratio, truncated

# Wallet channel names.
CHANNEL_NAMES = [
    (36, "Vietcombank"),
    (37, "ACB"),
    (38, "ZaloPay Wallet"),
    (39, "Visa/Master"),
    (40, "ATM"),
    (41, "Domestic Card"),
]
# The answers for a wallet query that finds nothing.
MOMO_NOT_FOUND = (99, "Khong tim thay giao dich")
ZALOPAY_NOT_FOUND = (-54, "Giao dich khong ton tai")


def _sum_if(cond: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0))


def _success_columns(df: DataFrame, count: str, total: str) -> DataFrame:
    return (
        df.withColumn("average_amount_vnd", truncated(ratio(F.col(total), F.col(count))))
        .withColumn("success_exact", ratio(F.col(count) * F.lit(100.0), F.col("total_transactions")))
        .withColumn("success_rate", half_even(F.col("success_exact"), 2))
    )


def momo_statistics(tx: DataFrame) -> DataFrame:
    ok = F.col("resultCode") == 0
    stats = tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(ok).alias("successful_transactions"),
        _sum_if(ok, "amount").alias("total_amount_vnd"),
    ).withColumn("failed_transactions", F.col("total_transactions") - F.col("successful_transactions"))
    return _success_columns(stats, "successful_transactions", "total_amount_vnd")


def momo_by_pay_type(tx: DataFrame) -> DataFrame:
    return (
        tx.filter("resultCode = 0")
        .groupBy(F.coalesce("payType", F.lit("unknown")).alias("pay_type"))
        .agg(F.count(F.lit(1)).alias("transactions"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total_vnd"))
    )


def zalopay_statistics(tx: DataFrame) -> DataFrame:
    code = F.col("return_code")
    stats = tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(code == 1).alias("successful"),
        F.count_if(code == 2).alias("failed"),
        F.count_if(code == 3).alias("processing"),
        _sum_if(code == 1, "amount").alias("total_amount_vnd"),
        _sum_if(code == 1, "discount_amount").alias("total_discount_vnd"),
    ).withColumn("net_amount_vnd", F.col("total_amount_vnd") - F.col("total_discount_vnd"))
    return _success_columns(stats, "successful", "total_amount_vnd")


def channel_names(spark) -> DataFrame:
    return spark.createDataFrame(CHANNEL_NAMES, "channel bigint, channel_name string")


def zalopay_by_channel(tx: DataFrame) -> DataFrame:
    """Successful payments per named channel. Amounts are added up per code first,
    so the six-row name table meets one row per code."""
    code = F.coalesce("channel", F.lit(0))
    per_code = tx.filter("return_code = 1").groupBy(code.alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v")
    )
    named = per_code.join(F.broadcast(channel_names(tx.sparkSession)), "channel", "left")
    return named.groupBy(
        F.coalesce("channel_name", F.concat(F.lit("Channel "), "channel")).alias("channel_name")
    ).agg(F.sum("n").alias("transactions"), F.coalesce(F.sum("v"), F.lit(0)).alias("total_vnd"))


def zalopay_by_bank(tx: DataFrame) -> DataFrame:
    bank = F.when(F.col("bank_code") == "", "ZaloPay").otherwise(F.coalesce("bank_code", F.lit("Unknown")))
    return (
        tx.filter("return_code = 1")
        .groupBy(bank.alias("bank"))
        .agg(F.count(F.lit(1)).alias("transactions"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total_vnd"))
    )


def zalopay_items(tx: DataFrame) -> DataFrame:
    """Items of the JSON text column, one row per item."""
    shape = "array<struct<itemid: string, itemname: string, itemprice: bigint, itemquantity: bigint>>"
    return tx.select("zp_trans_id", F.explode(F.from_json("item", shape)).alias("i")).select("zp_trans_id", "i.*")


def embedded_store(tx: DataFrame) -> DataFrame:
    """Store and customer named in the JSON text of ``embed_data``."""
    part = lambda p: F.get_json_object("embed_data", f"$.columninfo.{p}").alias(p)
    return tx.select("zp_trans_id", part("store_id"), part("customer_name"))


def payment_view(tx: DataFrame) -> DataFrame:
    """Gateway transactions as simplified payment records."""
    return tx.select(
        F.concat(F.lit("PAY-"), "paypal_transaction_id").alias("id"),
        "transaction_id",
        F.lit("sale").alias("intent"),
        F.when(F.col("transaction_status") == "COMPLETED", "completed").otherwise("pending").alias("state"),
        F.col("transaction_initiation_date").alias("create_time"),
        F.col("transaction_amount.value").alias("total_amount"),
        F.col("transaction_amount.currency_code").alias("currency"),
        F.lit("paypal").alias("payment_method"),
    )


def _array_or_empty(tx: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(tx.schema[name].dataType)).alias(name)


def momo_query_view(tx: DataFrame) -> DataFrame:
    return tx.select(
        "partnerCode",
        "orderId",
        "requestId",
        "extraData",
        "amount",
        "transId",
        "payType",
        "resultCode",
        _array_or_empty(tx, "refundTrans"),
        "message",
        "responseTime",
        _array_or_empty(tx, "promotionInfo"),
    )


def zalopay_query_view(tx: DataFrame) -> DataFrame:
    return tx.select(
        "return_code",
        "return_message",
        F.coalesce("sub_return_code", F.lit(0)).alias("sub_return_code"),
        F.coalesce("sub_return_message", F.lit("")).alias("sub_return_message"),
        F.coalesce("is_processing", F.lit(False)).alias("is_processing"),
        "amount",
        F.coalesce("discount_amount", F.lit(0)).alias("discount_amount"),
        "zp_trans_id",
    )


def balance_view(accounts: DataFrame, as_of=None) -> DataFrame:
    """Balances with the time of asking (a parameter, now by default)."""
    moment = F.current_timestamp() if as_of is None else F.lit(as_of)
    return accounts.select(
        F.col("id").alias("accountId"),
        "currentBalance",
        "availableBalance",
        "currency",
        moment.cast("timestamp_ntz").alias("asOf"),
    )


def account_activity(tx: DataFrame) -> DataFrame:
    """Per account: movements and the sum of signed amounts."""
    return tx.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("amount").alias("net_amount"),
        F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("credits"),
    )


def refund_summary(tx: DataFrame, refunds: str, id_column: str) -> DataFrame:
    """Refunded transactions with the refunded sum and what is left."""
    refunded = F.aggregate(
        F.col(refunds), F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["amount"], F.lit(0))
    )
    return (
        tx.filter(F.size(F.coalesce(refunds, F.array().cast(tx.schema[refunds].dataType))) > 0)
        .select(F.col(id_column), "amount", refunded.alias("refunded"))
        .withColumn("net_amount", F.col("amount") - F.col("refunded"))
        .withColumn("refund_kind", F.when(F.col("net_amount") <= 0, "full").otherwise("partial"))
    )
