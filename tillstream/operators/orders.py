"""Order statistics. Orders may carry nested ``line_items``; lines may also come flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions import half_even, ratio, truncated
from tillstream.operators.ranking import top_k

def _completed() -> Column:
    return F.col("status") == "completed"


def _revenue() -> Column:
    return F.coalesce(F.sum(F.when(_completed(), F.col("total"))), F.lit(0))


def _average(total: str, count: str) -> Column:
    return F.when(F.col(count) > 0, truncated(ratio(F.col(total), F.col(count)))).otherwise(0).cast("bigint")


def exploded_lines(orders: DataFrame, keep: list[str] = ("order_id", "status", "ingest_ord")) -> DataFrame:
    """One row per line of nested orders."""
    return orders.select(*keep, F.posexplode("line_items").alias("line_pos", "line")).select(
        *keep, "line_pos", "line.*"
    )


def line_measures(items: Column = None) -> dict[str, Column]:
    """Sums over a nested order's lines without exploding it."""
    items = F.col("line_items") if items is None else items
    add = lambda field: F.aggregate(
        items, F.lit(0).cast("double"), lambda a, x: a + F.coalesce(x[field], F.lit(0)).cast("double")
    )
    return {
        "item_count": F.size(items),
        "total_quantity": add("quantity").cast("bigint"),
        "discount_total": add("discount_amount").cast("bigint"),
        "total_weight_kg": half_even(add("weight_kg"), 2),
    }


def customer_order_stats(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.count_if(_completed()).alias("completed_orders"),
            _revenue().alias("total_spent_vnd"),
        )
        .withColumn("average_order_value", _average("total_spent_vnd", "completed_orders"))
    )


def channel_stats(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.coalesce("channel", F.lit("unknown")).alias("channel")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(_completed()).alias("completed"),
        _revenue().alias("total_revenue"),
    )


def order_counts(orders: DataFrame, column: str) -> DataFrame:
    return orders.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("orders"))


def order_totals(orders: DataFrame) -> DataFrame:
    return (
        orders.agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.count_if(_completed()).alias("completed_orders"),
            _revenue().alias("total_revenue_vnd"),
        )
        .withColumn("average_order_value_vnd", _average("total_revenue_vnd", "completed_orders"))
        .withColumn("conversion_exact", ratio(F.col("completed_orders") * F.lit(100.0), F.col("total_orders")))
        .withColumn("conversion_rate", half_even(F.col("conversion_exact"), 2))
    )


def top_products_sold(lines: DataFrame, k: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Best products by revenue over flat lines of completed orders.

    Lines need ``status``, ``product_id``, ``quantity``, ``line_total`` and ``ingest_ord``. Names
    come from ``names`` (product_id, product_name), joined to the ``k`` winners only, or else from
    the lines' ``product_name``.
    """
    sold = lines.filter(_completed() & (F.col("product_id") != 0))
    own = ["product_name"] if names is None else []
    by_name = sold.groupBy("product_id", *own).agg(
        F.sum("quantity").alias("q"),
        F.sum("line_total").alias("r"),
        F.min("ingest_ord").alias("first_ord"),
    )
    products = by_name.groupBy("product_id").agg(
        *[F.min_by(c, "first_ord").alias("name") for c in own],
        F.coalesce(F.sum("q"), F.lit(0)).alias("quantity_sold"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("revenue_vnd"),
        F.min("first_ord").alias("first_ord"),
    )
    best = top_k(products, "revenue_vnd", k, ["first_ord", "product_id"])
    if names is not None:
        best = best.join(names.withColumnRenamed("product_name", "name"), "product_id", "left")
        best = best.orderBy(F.desc("revenue_vnd"), "first_ord", "product_id")
    return best.select("product_id", "name", "quantity_sold", "revenue_vnd")


def all_channel_orders(online: DataFrame, store: DataFrame) -> DataFrame:
    """Web and store orders in one shape, for a customer's history over all channels."""
    web = online.select(
        "customer_id", F.col("transaction_id"), F.col("order_date").alias("ordered_at"), "channel", "total_vnd"
    )
    pos = store.select(
        "customer_id", F.col("transaction_id"), F.col("created_on").alias("ordered_at"), "channel", "total_vnd"
    )
    return web.unionByName(pos)


def customer_channel_summary(orders: DataFrame) -> DataFrame:
    """Per customer: orders and spend by channel, and whether both channels were used."""
    online = F.col("channel") == "online"
    return (
        orders.groupBy("customer_id")
        .agg(
            F.count_if(online).alias("online_orders"),
            F.count_if(~online).alias("store_orders"),
            F.sum("total_vnd").alias("total_vnd"),
            F.min("ordered_at").alias("first_order_at"),
            F.max("ordered_at").alias("last_order_at"),
        )
        .withColumn("cross_channel", (F.col("online_orders") > 0) & (F.col("store_orders") > 0))
    )
