"""Filtered, sorted, paged reads of the entity tables.

A filter that is ``None``, ``""`` or ``0`` means "no filter"; the wallets' status
code is the exception, there 0 is a code to ask for. Time bounds compare the ISO
text itself, both ends inclusive, so an end *date* ends at that day's midnight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions import has_text, same_text
from tillstream.operators.ranking import first_per_key, page


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def _equals(name: str, wanted) -> Column | None:
    return F.col(name) == wanted if wanted else None


def _at_least(name: str, bound) -> Column | None:
    return F.col(name) >= bound if bound else None


def _at_most(name: str, bound) -> Column | None:
    return F.col(name) <= bound if bound else None


def _text(test, name: str, wanted) -> Column | None:
    return test(F.col(name), wanted) if wanted else None


# --- cart events -----------------------------------------------------------------


def events_where(events, event_type=None, source=None, device=None, start_date=None, end_date=None) -> DataFrame:
    return _where(
        events,
        _equals("event_type", event_type),
        _equals("source", source),
        _equals("device", device),
        _at_least("timestamp", start_date),
        _at_most("timestamp", end_date),
    )


def find_events(events: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    return page(events_where(events, **filters), [F.desc("timestamp"), "ingest_ord"], limit, offset)


def events_for_customer(events: DataFrame, customer_id: int, limit: int = 100) -> DataFrame:
    return page(events.filter(F.col("customer_id") == customer_id), [F.desc("timestamp"), "ingest_ord"], limit)


def events_for_product(events: DataFrame, product_id: int, limit: int = 100) -> DataFrame:
    return page(events.filter(F.col("product_id") == product_id), [F.desc("timestamp"), "ingest_ord"], limit)


def events_for_session(events: DataFrame, session_id: str, limit: int = 100) -> DataFrame:
    return page(events.filter(F.col("session_id") == session_id), ["timestamp", "ingest_ord"], limit)


def rows_for_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Bulk form of the by-key reads: the rows whose key is listed."""
    return df.join(keys.select(column), column, "left_semi")


# --- orders ----------------------------------------------------------------------


def orders_where(
    orders,
    channel=None,
    status=None,
    payment_status=None,
    start_date=None,
    end_date=None,
    min_total=None,
    max_total=None,
) -> DataFrame:
    return _where(
        orders,
        _equals("channel", channel),
        _equals("status", status),
        _equals("payment_status", payment_status),
        _at_least("created_at", start_date),
        _at_most("created_at", end_date),
        _at_least("total", min_total),
        _at_most("total", max_total),
    )


def find_orders(orders: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Newest first, the order the table is kept in."""
    return page(orders_where(orders, **filters), [F.desc("created_at"), "ingest_ord"], limit, offset)


def order_by_id(orders: DataFrame, order_id: str) -> DataFrame:
    return page(orders.filter(F.col("order_id") == order_id), ["ingest_ord"], 1)


def orders_for_customer(orders: DataFrame, customer_id: int, limit: int = 50) -> DataFrame:
    return page(orders.filter(F.col("customer_id") == customer_id), [F.desc("created_at"), "ingest_ord"], limit)


def orders_for_channel(orders: DataFrame, channel: str, status: str | None = None, limit: int = 50) -> DataFrame:
    return find_orders(orders, limit, channel=channel, status=status)


def numbered_page(df: DataFrame, page_no: int = 1, limit: int = 50, **equal) -> DataFrame:
    """Page ``page_no`` (from 1) in id order of the rows matching all equality filters."""
    matching = _where(df, *[_equals(k, v) for k, v in equal.items()])
    return page(matching, ["id"], limit, (page_no - 1) * limit)


# --- payments and bank -----------------------------------------------------------


def find_payments(tx, transaction_status=None, start_date=None, end_date=None, limit: int = 50) -> DataFrame:
    time = "transaction_initiation_date"
    matching = _where(
        tx, _equals("transaction_status", transaction_status), _at_least(time, start_date), _at_most(time, end_date)
    )
    return page(matching, ["ingest_ord"], limit)


def _wallet(tx, code, time, status, start_date, end_date, min_amount, max_amount) -> DataFrame:
    return _where(
        tx,
        F.col(code) == status if status is not None else None,
        _at_least(time, start_date),
        _at_most(time, end_date),
        _at_least("amount", min_amount),
        _at_most("amount", max_amount),
    )


def find_momo(
    tx, status=None, start_date=None, end_date=None, min_amount=None, max_amount=None, limit: int = 50
) -> DataFrame:
    matching = _wallet(tx, "resultCode", "responseTimeISO", status, start_date, end_date, min_amount, max_amount)
    return page(matching, [F.desc("responseTime"), "ingest_ord"], limit)


def find_zalopay(
    tx, status=None, start_date=None, end_date=None, min_amount=None, max_amount=None, channel=None, limit: int = 50
) -> DataFrame:
    matching = _wallet(tx, "return_code", "server_time_iso", status, start_date, end_date, min_amount, max_amount)
    return page(_where(matching, _equals("channel", channel)), [F.desc("server_time"), "ingest_ord"], limit)


def account_transactions(tx, account_id: str, status=None, start=None, end=None, limit: int = 50) -> DataFrame:
    matching = _where(
        tx.filter(F.col("account_id") == account_id),
        _equals("status", status),
        _at_least("created_at", start),
        _at_most("created_at", end),
    )
    return page(matching, [F.desc("created_at"), "ingest_ord"], limit)


def bank_transactions(tx, kind=None, limit: int = 50) -> DataFrame:
    return page(_where(tx, _equals("kind", kind)), [F.desc("created_at"), "ingest_ord"], limit)


def wallet_lookup(
    tx: DataFrame, asked: DataFrame, either: dict[str, str], answer: list[str], missing: dict[str, object]
) -> DataFrame:
    """First transaction matching any of an enquiry's keys, for a table of enquiries.

    ``asked`` has a ``query_id`` (repeated ones are one enquiry) and one column per entry of
    ``either`` (enquiry column -> transaction column); ``missing`` fills the answer for no match. All
    keys go through one equi-join on (which key, its value), so no OR condition forces a nested loop.
    Only positions take part until each enquiry has its own; the answers join at the end, by position.
    """

    def pairs(keys: list) -> Column:
        every = [F.struct(F.lit(i).alias("key_no"), k.cast("string").alias("key")) for i, k in enumerate(keys)]
        return F.filter(F.array(*every), lambda p: p["key"].isNotNull())

    typed = [F.col(a).cast(tx.schema[t].dataType) for a, t in either.items()]
    wanted = asked.select("query_id", F.inline_outer(pairs(typed)))
    known = tx.select("ingest_ord", F.inline(pairs([F.col(t) for t in either.values()])))
    firsts = known.groupBy("key_no", "key").agg(F.min("ingest_ord").alias("first"))
    best = wanted.join(firsts, ["key_no", "key"], "left").groupBy("query_id").agg(F.min("first").alias("first"))
    answers = tx.select(F.col("ingest_ord").alias("first"), *answer, F.lit(True).alias("_hit"))
    filled = [F.coalesce(F.col(c), F.lit(missing[c])).alias(c) if c in missing else F.col(c) for c in answer]
    return best.join(answers, "first", "left").select("query_id", F.coalesce("_hit", F.lit(False)).alias("found"), *filled)


def wallet_query(tx: DataFrame, either: dict[str, object], answer: list[str], missing: dict[str, object]) -> DataFrame:
    """First transaction matching any given key, or the one "not found" row."""
    asked = [F.col(c) == v for c, v in either.items() if v]
    hit = tx.filter(reduce(Column.__or__, asked)) if asked else tx.limit(0)
    found = hit.orderBy("ingest_ord").limit(1).select(F.lit(0).alias("rank"), *answer)
    fallback = {**{c: F.lit(v) for c, v in either.items() if v and c in answer}, **{c: F.lit(v) for c, v in missing.items()}}
    default = tx.sparkSession.range(1).select(
        F.lit(1).alias("rank"), *[fallback.get(c, F.lit(None)).cast(tx.schema[c].dataType).alias(c) for c in answer]
    )
    return found.unionByName(default).orderBy("rank").limit(1).drop("rank")


# --- master data -----------------------------------------------------------------


def find_products(
    products, category=None, brand=None, min_price=None, max_price=None, limit: int = 50, offset: int = 0
) -> DataFrame:
    matching = _where(
        products,
        _text(same_text, "category", category),
        _text(same_text, "brand", brand),
        _at_least("price_vnd", min_price),
        _at_most("price_vnd", max_price),
    )
    return page(matching, ["id"], limit, offset)


def find_staff(staff, position=None, status=None, limit: int = 50, offset: int = 0) -> DataFrame:
    matching = _where(staff, _text(has_text, "position", position), _text(same_text, "status", status))
    return page(matching, ["id"], limit, offset)


def find_customers(customers, city=None, country=None, limit: int = 50, offset: int = 0) -> DataFrame:
    matching = _where(customers, _text(has_text, "city", city), _text(has_text, "country", country))
    return page(matching, ["id"], limit, offset)


def find_locations(locations, city=None, limit: int = 50) -> DataFrame:
    return page(_where(locations, _text(has_text, "city", city)), ["id"], limit)


def find_shops(shops, country=None, currency=None, limit: int = 50) -> DataFrame:
    matching = _where(
        shops,
        _text(has_text, "country", country),
        F.upper("currency_code") == currency.upper() if currency else None,
    )
    return page(matching, ["id"], limit)


def by_id(df: DataFrame, wanted) -> DataFrame:
    return df.filter(F.col("id") == wanted)
