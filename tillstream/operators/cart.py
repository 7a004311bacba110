"""Cart statistics, cart replay and abandoned carts over typed (uncleaned) events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions import epoch_seconds, half_even, seconds_between, truncated
from tillstream.operators.ranges import numbered_in_order
from tillstream.operators.ranking import top_k

SEGMENT_SECONDS = 3600
PIECE_EVENTS = 100_000


def cart_distribution(events: DataFrame) -> DataFrame:
    """Event counts by type, source and device in one scan, as (dimension, value, events)."""
    dims = ["event_type", "source", "device"]
    known = events.select(*[F.coalesce(F.col(d), F.lit("unknown")).alias(d) for d in dims])
    sets = known.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("events"), F.grouping_id().alias("gid")
    )
    # grouping_id has one bit per column, set where the column is rolled up
    label = F.when(F.col("gid") == 3, "event_type").when(F.col("gid") == 5, "source").otherwise("device")
    return sets.select(label.alias("dimension"), F.coalesce(*dims).alias("value"), "events")


def cart_statistics(events: DataFrame) -> DataFrame:
    """Totals, distinct customers and sessions, adds, removes and their ratio."""
    kind = F.col("event_type")
    return (
        events.agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_distinct(F.when(F.col("customer_id") != 0, F.col("customer_id"))).alias("unique_customers"),
            F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("unique_sessions"),
            F.count_if(kind == "add_to_cart").alias("add_events"),
            F.count_if(kind == "remove_from_cart").alias("remove_events"),
        )
        .withColumn(
            "add_remove_exact",
            F.coalesce(F.try_divide("add_events", "remove_events"), F.col("add_events").cast("double")),
        )
        .withColumn("add_remove_ratio", half_even(F.col("add_remove_exact"), 2))
    )


def top_products_added(events: DataFrame, k: int = 10) -> DataFrame:
    """Most often added products with their first seen name and total value."""
    adds = events.filter((F.col("event_type") == "add_to_cart") & (F.col("product_id") != 0))
    # the name is a grouping key first, so the heavy step only counts and adds
    by_name = adds.groupBy("product_id", "product_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("line_total_vnd", F.lit(0))).alias("v"),
        F.min("ingest_ord").alias("first_ord"),
    )
    products = by_name.groupBy("product_id").agg(
        F.coalesce(F.min_by("product_name", "first_ord"), F.lit("")).alias("name"),
        F.sum("n").alias("add_count"),
        F.sum("v").alias("total_value_vnd"),
        F.min("first_ord").alias("first_ord"),
    )
    return top_k(products, "add_count", k, ["first_ord", "product_id"]).drop("first_ord")


# --- cart replay -----------------------------------------------------------------
#
# The cart of a product is an order-dependent fold: add inserts or increases, remove
# decreases and deletes at zero or below, update overwrites and deletes at zero or
# below but never inserts. To replay a history in parallel, each bounded piece of it
# is summarised as a function from the item's state before the piece to the state
# after it. A summary is a short list of branches ordered by incoming quantity: the
# first branch answers for "not in the cart", a branch with bound `upto` for every
# incoming quantity above the previous bound up to and including its own. `relative`
# means the outgoing quantity is the incoming one plus `qty`; `carried` means price,
# name and insertion order are those of the incoming item.

_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


def _branch(ord_type: str, upto, present, qty, relative, carried, price=None, name=None, added=None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(upto).cast("bigint").alias("upto"),
        F.lit(present).alias("present"),
        F.lit(qty).cast("bigint").alias("qty"),
        F.lit(relative).alias("relative"),
        F.lit(carried).alias("carried"),
        (null if price is None else price).cast("bigint").alias("price"),
        (null if name is None else name).cast("string").alias("name"),
        (null if added is None else added).cast(ord_type).alias("added"),
    )


def _summary(steps: Column, ord_type: str) -> Column:
    """Branches for a sorted array of (event_time, ingest_ord, kind, qty, price, name)."""

    def gone(upto) -> Column:
        return _branch(ord_type, upto, False, 0, False, False)

    def moved(b: Column, qty: Column, relative: Column) -> Column:
        return _branch(ord_type, b["upto"], True, qty, relative, b["carried"], b["price"], b["name"], b["added"])

    def step(branches: Column, e: Column) -> Column:
        def after(b: Column, i: Column) -> Column:
            fresh = _branch(
                ord_type, b["upto"], True, e["qty"], False, False, e["price"], e["name"], e["ingest_ord"]
            )
            less = b["qty"] - e["qty"]
            reduced = moved(b, less, b["relative"])
            # incoming quantities up to this one are used up by the removal
            used_up = -less
            already_above = branches[F.when(i > 0, i - 1).otherwise(0)]["upto"] >= used_up
            return (
                F.when(
                    e["kind"] == "add_to_cart",
                    F.array(F.when(b["present"], moved(b, b["qty"] + e["qty"], b["relative"])).otherwise(fresh)),
                )
                .when(~b["present"], F.array(b))
                .when(
                    e["kind"] == "update_quantity",
                    F.array(F.when(e["qty"] > 0, moved(b, e["qty"], F.lit(False))).otherwise(gone(b["upto"]))),
                )
                .when(~b["relative"], F.array(F.when(less > 0, reduced).otherwise(gone(b["upto"]))))
                .when(already_above, F.array(reduced))
                .otherwise(F.array(gone(used_up), reduced))
            )

        state = lambda b: F.struct(b["present"], b["qty"], b["relative"], b["carried"], b["added"])
        # neighbours with equal outcome become one branch, under the upper bound
        merged = lambda bs: F.filter(
            bs, lambda b, i: (i == F.size(bs) - 1) | ~state(b).eqNullSafe(state(F.get(bs, i + 1)))
        )
        stepped = F.flatten(F.transform(branches, after))
        return F.element_at(F.transform(F.array(stepped), merged), 1)

    start = F.array(gone(_LOWEST), _branch(ord_type, _HIGHEST, True, 0, True, True))
    return F.aggregate(steps, start, step)


def _state_after(pieces: Column, ord_type: str) -> Column:
    """Run an empty cart line through the ordered summaries of its history."""

    def apply(state: Column, piece: Column) -> Column:
        matching = F.filter(piece["branches"], lambda b: state["qty"] <= b["upto"])
        chosen = F.when(state["present"], F.get(matching, F.lit(0))).otherwise(F.get(piece["branches"], F.lit(0)))
        pick = lambda b, f: F.when(b["carried"], state[f]).otherwise(b[f])
        out = lambda b: _branch(
            ord_type,
            _LOWEST,
            b["present"],
            F.when(b["relative"], state["qty"] + b["qty"]).otherwise(b["qty"]),
            False,
            False,
            pick(b, "price"),
            pick(b, "name"),
            pick(b, "added"),
        )
        return F.element_at(F.transform(F.array(chosen), out), 1)

    empty = _branch(ord_type, _LOWEST, False, 0, False, False)
    return F.aggregate(pieces, empty, apply)


def cart_items(
    events: DataFrame, piece_events: int = PIECE_EVENTS, segment_seconds: int = SEGMENT_SECONDS
) -> DataFrame:
    """What each session's cart holds after all its events: one row per product left.

    The moves of one product in one segment are cut into pieces in their order, over many
    tasks where they are many; the pieces' summaries are then applied in that order.
    """
    ord_type = events.schema["ingest_ord"].dataType.simpleString()
    kind = F.col("event_type")
    moves = events.filter(
        kind.isin("add_to_cart", "remove_from_cart", "update_quantity")
        & (F.col("product_id") != 0)
        & (F.col("session_id") != "")
    ).select(
        "session_id",
        "product_id",
        F.floor(epoch_seconds(F.col("event_time")) / segment_seconds).alias("segment"),
        "event_time",
        "ingest_ord",
        kind.alias("kind"),
        F.coalesce("quantity", F.when(kind == "update_quantity", 0).otherwise(1)).cast("bigint").alias("qty"),
        F.coalesce("product_price_vnd", F.lit(0)).alias("price"),
        F.col("product_name").alias("name"),
    )
    split = ["session_id", "product_id", "segment"]
    step = F.struct("event_time", "ingest_ord", "kind", "qty", "price", "name")
    pieces = (
        numbered_in_order(moves, split, ["event_time", "ingest_ord"], "_local")
        .withColumn("piece", F.floor((F.col("_local") - 1) / piece_events))
        .groupBy(*split, "piece")
        .agg(F.sort_array(F.collect_list(step)).alias("steps"))
        .select("session_id", "product_id", "segment", "piece", _summary(F.col("steps"), ord_type).alias("branches"))
    )
    lines = pieces.groupBy("session_id", "product_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "piece", "branches"))).alias("pieces")
    )
    return (
        lines.withColumn("line", _state_after(F.col("pieces"), ord_type))
        .filter("line.present")
        .select(
            "session_id",
            "product_id",
            F.col("line.name").alias("product_name"),
            F.col("line.qty").alias("quantity"),
            F.col("line.price").alias("price_vnd"),
            F.col("line.added").alias("added_ord"),
        )
    )


def abandoned_carts(
    events: DataFrame, as_of, hours: int = 24, limit: int | None = 50, piece_events: int = PIECE_EVENTS
) -> DataFrame:
    """Sessions with a non-empty cart and no event of any kind in the last ``hours``.

    ``as_of`` is a timestamp (or its text). Purchases do not empty a cart, guests
    count. ``limit=None`` returns all of them, unordered.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    activity = (
        events.filter("session_id != ''")
        .groupBy("session_id")
        .agg(
            F.max("event_time").alias("last_activity"),
            F.min_by("customer_id", "ingest_ord").alias("customer_id"),
            F.min("ingest_ord").alias("first_ord"),
        )
        .filter(F.col("last_activity") < now - F.expr(f"INTERVAL {int(hours)} HOURS"))
    )
    # one entry per product left in the cart: bounded by the catalogue
    item = F.struct("added_ord", "product_id", "product_name", "quantity", "price_vnd")
    carts = cart_items(events, piece_events).groupBy("session_id").agg(
        F.sum(F.col("price_vnd") * F.col("quantity")).alias("cart_value_vnd"),
        F.count(F.lit(1)).alias("item_count"),
        F.sort_array(F.collect_list(item)).alias("cart_items"),
    )
    found = activity.join(carts, "session_id").withColumn(
        "hours_since_activity", truncated(seconds_between(F.col("last_activity"), now) / 3600)
    )
    if limit is not None:
        found = top_k(found, "cart_value_vnd", limit, ["first_ord"])
    return found.drop("first_ord")
