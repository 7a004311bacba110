"""Event-time activity: session windows, inactivity and carts left behind."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.operators.ranking import first_per_key


def activity_windows(events: DataFrame, gap: str, delay: str, keys: list[str] = ("session_id",)) -> DataFrame:
    """Bursts of activity per key; in append mode one row once ``gap`` has passed without an event.

    ``events`` need ``event_time`` of the zoned timestamp type.
    """
    return (
        events.withWatermark("event_time", delay)
        .groupBy(F.session_window("event_time", gap).alias("window"), *keys)
        .agg(
            F.min("event_time").alias("first_activity"),
            F.max("event_time").alias("last_activity"),
            F.count(F.lit(1)).alias("events"),
        )
        .drop("window")
    )


class SessionCart:
    """One session's cart, folded up to the watermark; later events wait, so that they fold in order.

    ``lines`` has quantity, price and name of every product in the cart, ``seen`` the last activity of
    the open burst in microseconds (None between bursts), ``waiting`` the events not folded yet.
    """

    def __init__(self, seen: int | None = None, lines: str = "[]", waiting: str = "[]"):
        self.seen = seen
        self.lines = {product: rest for product, *rest in json.loads(lines)}
        self.waiting = [tuple(e) for e in json.loads(waiting)]

    def state(self) -> tuple[int | None, str, str]:
        return self.seen, json.dumps([[p, *rest] for p, rest in self.lines.items()]), json.dumps(self.waiting)

    def _fold(self, kind: str | None, product: int, quantity: int, price: int, name: str | None) -> None:
        line = self.lines.get(product)
        if kind == "add_to_cart":
            if line is None:
                self.lines[product] = [quantity, price, name]
            else:
                line[0] += quantity
        elif kind is not None and line is not None:
            line[0] = quantity if kind == "update_quantity" else line[0] - quantity
            if line[0] <= 0:
                del self.lines[product]

    def _close(self) -> tuple[int, int, int]:
        left = self.seen, sum(q * price for q, price, _ in self.lines.values()), len(self.lines)
        self.seen = None
        return left

    def advance(self, watermark: int, gap: int) -> tuple[int, int, int] | None:
        """Fold what the watermark has passed; (last activity, value, items) of the last burst that ended."""
        self.waiting.sort(key=lambda e: e[:2])
        left, folded = None, 0
        for at, _, *move in self.waiting:
            if at > watermark:
                break
            if self.seen is not None and at >= self.seen + gap:
                left = self._close()
            self._fold(*move)
            self.seen, folded = at, folded + 1
        del self.waiting[:folded]
        if self.seen is not None and self.seen + gap <= watermark:
            left = self._close()
        return left

    def wake(self, gap: int) -> int | None:
        """When the watermark next changes something."""
        times = [*([self.waiting[0][0]] if self.waiting else []), *([self.seen + gap] if self.seen is not None else [])]
        return min(times, default=None)


def _advance_bucket(carts: dict, rows: dict, watermark: int, gap: int) -> tuple[list[tuple], int | None]:
    """Bring a bucket's stored carts up to the watermark: what its sessions left, and when it next changes.

    ``carts`` has (wake, seen, lines, waiting) of every session, ``rows`` its new events. Only sessions with
    new events, or whose time has come, are opened.
    """
    left = []
    due = [s for s, (wake, *_) in carts.items() if wake is not None and wake <= watermark and s not in rows]
    for session in [*rows, *due]:
        cart = SessionCart(*carts[session][1:]) if session in carts else SessionCart()
        cart.waiting += rows.get(session, [])
        closed = cart.advance(watermark, gap)
        wake = cart.wake(gap)
        if wake is None and not cart.lines:
            carts.pop(session, None)
        else:
            carts[session] = (wake, *cart.state())
        if closed is not None:
            left.append((session, *closed))
    return left, min((wake for wake, *_ in carts.values() if wake is not None), default=None)


def carts_left(events: DataFrame, gap: str, delay: str, buckets: int = 1024) -> DataFrame:
    """A stream of session_id, last_activity, cart_value_vnd, item_count: what the cart held when its
    session had been inactive for ``gap``; an empty cart has a row too.

    ``events`` are typed events whose ``event_time`` is zoned and whose ``ingest_ord`` is a number. The
    state of a session is its cart and the events not yet behind the watermark; nothing stored is read
    again. Sessions are stored in ``buckets`` by hash, as handing a group to Python costs far more than its
    few events; all of a bucket's sessions should fit into a small part of a task's memory. An event-time timer
    closes sessions without further events. A session without anything in its cart leaves the state when it closes. Rows more than ``delay`` late are dropped by Spark:
    ``late_writer`` on the same events with the same delay stores them.
    """
    spark = events.sparkSession
    gap_us = int(spark.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {gap})").first()[0])

    def run(key, frames, state):
        carts = json.loads(state.get[0]) if state.exists else {}
        rows = {}
        for frame in frames:
            columns = ("session_id", "at", "ingest_ord", "kind", "product_id", "qty", "price", "name")
            for session, *event in zip(*(frame[c].tolist() for c in columns)):
                rows.setdefault(session, []).append(tuple(event))
        watermark = state.getCurrentWatermarkMs()
        left, wake = _advance_bucket(carts, rows, watermark * 1000, gap_us)
        if not carts:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(carts),))
            if wake is not None:
                # Timers before the watermark fire; a millisecond less makes it "not after".
                state.setTimeoutTimestamp(max(-(-wake // 1000) - 1, watermark))
        if left:
            yield pd.DataFrame(left, columns=["session_id", "last_us", "cart_value_vnd", "item_count"])

    kind = F.col("event_type")
    moves = kind.isin("add_to_cart", "remove_from_cart", "update_quantity") & F.coalesce(F.col("product_id") != 0, F.lit(False))
    slim = (
        events.filter("session_id is not null and event_time is not null")
        .withWatermark("event_time", delay)
        .select(
            F.expr(f"pmod(xxhash64(session_id), {buckets})").alias("bucket"),
            "session_id",
            "event_time",
            F.unix_micros("event_time").alias("at"),
            "ingest_ord",
            F.when(moves & (F.col("session_id") != ""), kind).alias("kind"),
            F.coalesce("product_id", F.lit(0)).alias("product_id"),
            F.coalesce("quantity", F.when(kind == "update_quantity", 0).otherwise(1)).cast("bigint").alias("qty"),
            F.coalesce("product_price_vnd", F.lit(0)).cast("bigint").alias("price"),
            F.col("product_name").alias("name"),
        )
    )
    found = slim.groupBy("bucket").applyInPandasWithState(
        run,
        "session_id string, last_us bigint, cart_value_vnd bigint, item_count bigint",
        "carts string",
        "append",
        "EventTimeTimeout",
    )
    return found.select("session_id", F.timestamp_micros("last_us").alias("last_activity"), "cart_value_vnd", "item_count")


def carts_left_now(spark, out_dir: str) -> DataFrame:
    """One row for each session whose cart holds something since it last went inactive."""
    found = first_per_key(spark.read.parquet(out_dir), ["session_id"], [F.desc("last_activity")])
    return found.filter("item_count > 0").drop("batch_id")
