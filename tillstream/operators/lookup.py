"""Cross-source transaction lookup, reconciliation and detail joins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tillstream.operators.ranking import first_per_key

# The sources in search order.
SOURCES = ["paypal", "mercury", "momo", "zalopay", "shopify", "sapo", "odoo"]
# Wallets are also found by their own transaction number.
ALTERNATE_KEYS = {"momo": ["transId"], "zalopay": ["app_trans_id"]}


def _key_columns(name: str, df: DataFrame) -> list[str]:
    return ["transaction_id", *[c for c in ALTERNATE_KEYS.get(name, []) if c in df.columns]]


def _as_match(df: DataFrame, name: str, key: Column) -> DataFrame:
    return df.select(
        key.alias("transaction_id"),
        F.lit(SOURCES.index(name)).alias("source_no"),
        F.lit(name).alias("source"),
        F.to_json("row").alias("data"),
    )


def _equals_text(df: DataFrame, column: str, wanted: str) -> Column:
    """``column`` as text is ``wanted``, stated in the column's own type so that the scan can use it."""
    if isinstance(df.schema[column].dataType, IntegralType):
        whole = int(wanted) if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", wanted) else None
        if whole is None or not -(2**63) <= whole < 2**63:
            return F.lit(False)
        return F.col(column) == F.lit(whole).cast("long")
    return F.col(column).cast("string") == wanted


def find_transaction(transaction_id: str, sources: dict[str, DataFrame]) -> DataFrame:
    """One id in every source: a pushed-down filter per source, first match each."""

    def match(name: str, df: DataFrame) -> DataFrame:
        hit = reduce(Column.__or__, [_equals_text(df, c, transaction_id) for c in _key_columns(name, df)])
        first = df.filter(hit).orderBy("ingest_ord").limit(1)
        return _as_match(first.select(F.struct(*df.columns).alias("row")), name, F.lit(transaction_id))

    return reduce(DataFrame.unionByName, [match(name, df) for name, df in sources.items()])


def _keyed(name: str, df: DataFrame, *carried: Column) -> DataFrame:
    """A row per id that a source's row is known by, from one scan."""
    ids = F.array_compact(F.array_distinct(F.array(*[F.col(c).cast("string") for c in _key_columns(name, df)])))
    return df.select(F.explode(ids).alias("wanted_id"), *carried)


def transaction_matches(keys: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Many ids at once: ``transaction_id, source, data`` for the first match per source.

    A source is cut to the wanted ids before anything is sorted or exchanged, as the
    optimizer broadcasts a short list; then each task keeps one row per id at most,
    so a wanted id repeated all over a source stays cheap. Only matching rows are
    turned to JSON.
    """
    wanted = keys.select(F.col("transaction_id").alias("wanted_id")).distinct()

    def matches(name: str, df: DataFrame) -> DataFrame:
        keyed = _keyed(name, df, *[F.col(c) for c in df.columns]).join(wanted, "wanted_id", "left_semi")
        hits = first_per_key(keyed, ["wanted_id"], ["ingest_ord"])
        return _as_match(hits.select("wanted_id", F.struct(*df.columns).alias("row")), name, F.col("wanted_id"))

    return reduce(DataFrame.unionByName, [matches(name, df) for name, df in sources.items()])


def transaction_lookup(keys: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Per wanted id: the sources it was found in (search order) and their number.

    Only the key columns are read. Each source is one bit and the wanted ids are one more, so all of them meet
    in one exchange, and a repeated id is folded into one small number; nothing is sorted or joined.
    """
    asked = 1 << len(SOURCES)
    marks = [
        _keyed(name, df, F.lit(1 << SOURCES.index(name)).alias("mark")).withColumnRenamed("wanted_id", "transaction_id")
        for name, df in sources.items()
    ]
    wanted = keys.select("transaction_id", F.lit(asked).alias("mark"))
    found = (
        reduce(DataFrame.unionByName, [wanted, *marks])
        .groupBy("transaction_id")
        .agg(F.bit_or("mark").alias("mark"))
        .where(F.col("mark") >= asked)
        .select("transaction_id", (F.col("mark") - asked).alias("mark"))
    )
    names = F.filter(
        F.array(*[F.lit(s) for s in SOURCES]),
        lambda s, i: F.col("mark").bitwiseAND(F.element_at(F.array(*[F.lit(1 << n) for n in range(7)]), i + 1)) != 0,
    )
    return found.select("transaction_id", names.alias("found_in_sources"), F.bit_count("mark").alias("matches"))


def payment_reconciliation(orders: DataFrame, gateway: DataFrame, bank: DataFrame, how: str = "left") -> DataFrame:
    """Order -> gateway -> bank by transaction id, with the net the bank should show.

    ``orders``: transaction_id, order_amount; ``gateway``: transaction_id, amount, fee,
    ingest_ord; ``bank``: transaction_id, deposit, ingest_ord. Gateway and bank are cut
    to the first row per id, so the joins add no rows. ``how="full"`` also keeps
    gateway and bank rows no order knows.
    """
    paid = first_per_key(gateway, ["transaction_id"], ["ingest_ord"]).select(
        "transaction_id", F.col("amount").alias("gateway_amount"), F.col("fee").alias("gateway_fee")
    )
    banked = first_per_key(bank, ["transaction_id"], ["ingest_ord"]).select(
        "transaction_id", F.col("deposit").alias("bank_amount")
    )
    joined = (
        orders.select("transaction_id", "order_amount")
        .join(paid, "transaction_id", how)
        .join(banked, "transaction_id", how)
        .withColumn("net_amount", F.col("gateway_amount") - F.col("gateway_fee"))
        .withColumn("bank_delta", F.col("bank_amount") - F.col("net_amount"))
    )
    status = F.when(F.col("order_amount").isNull(), "unknown_order") if how.startswith("full") else F
    return joined.withColumn(
        "status",
        status.when(F.col("gateway_amount").isNull(), "missing_gateway")
        .when(F.col("bank_amount").isNull(), "missing_bank")
        .when(F.col("gateway_amount") != F.col("order_amount"), "amount_mismatch")
        .when(F.col("bank_delta") != 0, "net_mismatch")
        .otherwise("matched"),
    )


def with_details(df: DataFrame, dimension: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """Left join of descriptive columns by id; the optimizer broadcasts a small dimension."""
    side = dimension.select(F.col("id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return df.join(side, key, "left")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Keys without a parent row and how many rows use each.

    Rows are counted per key before the anti join, so a key used by a third of the
    rows is one row there.
    """
    used = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")


def referential_check(checks: dict[str, tuple[DataFrame, str, DataFrame]]) -> DataFrame:
    """Orphan keys and rows per named reference."""
    parts = [
        orphans(child, column, parent).agg(
            F.lit(name).alias("reference"),
            F.count(F.lit(1)).alias("orphan_keys"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
        )
        for name, (child, column, parent) in checks.items()
    ]
    return reduce(DataFrame.unionByName, parts)
