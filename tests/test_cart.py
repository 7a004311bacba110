from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillstream.operators import cart
from tillstream.operators.cleaning import typed_events

ADD, REMOVE, UPDATE = "add_to_cart", "remove_from_cart", "update_quantity"


def _moves(make_events, *moves, product=1, price=10):
    rows = [{"event_type": k, "quantity": None if q is None else str(q), "product_id": product, "product_price_vnd": str(price + i)} for i, (k, q) in enumerate(moves)]
    return typed_events(make_events(*rows))


def _cart(events, **kw):
    return {r.product_id: (r.quantity, r.price_vnd) for r in cart.cart_items(events, **kw).collect()}


@pytest.mark.parametrize(
    "moves, left",
    [
        ([(ADD, 2), (REMOVE, 5), (REMOVE, 1), (ADD, 4)], {1: (4, 13)}),
        ([(UPDATE, 3)], {}),
        ([(ADD, 1), (UPDATE, 0)], {}),
        ([(ADD, 0)], {1: (0, 10)}),
        ([(ADD, 2), (REMOVE, 0)], {1: (2, 10)}),
        ([(ADD, 2), ("purchase", 1)], {1: (2, 10)}),
        ([(ADD, None), (ADD, None), (REMOVE, None)], {1: (1, 10)}),
        ([(ADD, 2), (UPDATE, None)], {}),
        ([(ADD, 2), (UPDATE, 7), (REMOVE, 3)], {1: (4, 10)}),
    ],
)
@pytest.mark.parametrize("piece", [1, 2, 100])
def test_replay_rules(make_events, moves, left, piece):
    assert _cart(_moves(make_events, *moves), piece_events=piece) == left


def _replay(history):
    """The same rules, one move at a time."""
    state = None
    for i, (kind, q) in enumerate(history):
        if kind == ADD:
            state = (q, i) if state is None else (state[0] + q, state[1])
        elif state is not None:
            qty = state[0] - q if kind == REMOVE else q
            state = (qty, state[1]) if qty > 0 else None
    return state


histories = st.lists(
    st.lists(st.tuples(st.sampled_from([ADD, REMOVE, UPDATE]), st.integers(-2, 6)), max_size=14), min_size=20, max_size=60
)


@pytest.mark.parametrize("piece", [1, 3, 1000])
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(histories=histories)
def test_pieces_equal_one_by_one_replay(spark, piece, histories):
    base = datetime(2025, 1, 1)
    rows = [
        (f"s{s}", 1, kind, base + timedelta(minutes=23 * i), s * 1000 + i, q, i, f"n{i}")
        for s, history in enumerate(histories)
        for i, (kind, q) in enumerate(history)
    ]
    events = spark.createDataFrame(
        rows,
        "session_id string, product_id bigint, event_type string, event_time timestamp_ntz, ingest_ord bigint, "
        "quantity bigint, product_price_vnd bigint, product_name string",
    )
    got = {r.session_id: (r.quantity, r.price_vnd, r.product_name, r.added_ord) for r in cart.cart_items(events, piece).collect()}
    want = {}
    for s, history in enumerate(histories):
        state = _replay(history)
        if state is not None:
            want[f"s{s}"] = (state[0], state[1], f"n{state[1]}", s * 1000 + state[1])
    assert got == want


def test_abandonment_is_strictly_before_the_threshold(make_events):
    events = typed_events(
        make_events(
            {"session_id": "edge", "event_type": ADD, "timestamp": "2025-01-01T00:00:00"},
            {"session_id": "old", "event_type": ADD, "timestamp": "2024-12-31T23:59:59"},
        )
    )
    found = cart.abandoned_carts(events, "2025-01-02 00:00:00", 24).collect()
    assert [(r.session_id, r.hours_since_activity) for r in found] == [("old", 24)]


def test_any_event_counts_as_activity(make_events):
    events = typed_events(
        make_events(
            {"event_type": ADD, "timestamp": "2025-01-01T00:00:00", "customer_id": None},
            {"event_type": "scroll", "timestamp": "2025-01-01T09:00:00.5", "product_id": None},
        )
    )
    assert cart.abandoned_carts(events, "2025-01-02 08:00:00", 24).count() == 0
    (row,) = cart.abandoned_carts(events, "2025-01-02 10:00:00", 24).collect()
    assert (row.last_activity, row.customer_id) == (datetime(2025, 1, 1, 9, 0, 0, 500000), None)


def test_items_in_insertion_order_and_value(make_events):
    events = typed_events(
        make_events(
            {"event_type": ADD, "product_id": 9, "product_name": "Z", "quantity": "2", "product_price_vnd": "100"},
            {"event_type": ADD, "product_id": 3, "product_name": "A", "quantity": "1", "product_price_vnd": "80"},
        )
    )
    (row,) = cart.abandoned_carts(events, "2025-02-01 00:00:00").collect()
    assert [i.product_name for i in row.cart_items] == ["Z", "A"]
    assert (row.cart_value_vnd, row.item_count) == (280, 2)


def test_statistics_without_removals(make_events):
    events = typed_events(make_events(*[{"event_type": ADD}] * 3, {"customer_id": None, "event_type": "scroll"}))
    (row,) = cart.cart_statistics(events).collect()
    assert (row.total_events, row.add_remove_ratio, row.unique_customers) == (4, 3.0, 1)


def test_top_products_ties_by_first_seen(make_events):
    events = typed_events(
        make_events(
            *[{"event_type": ADD, "product_id": p, "product_name": f"P{p}", "line_total_vnd": "5"} for p in (7, 2, 7, 2, 4)]
        )
    )
    rows = cart.top_products_added(events, 2).collect()
    assert [(r.product_id, r.name, r.add_count, r.total_value_vnd) for r in rows] == [(7, "P7", 2, 10), (2, "P2", 2, 10)]


def test_distribution_names_missing_values(make_events):
    rows = cart.cart_distribution(make_events({"source": None}, {})).collect()
    assert {(r.dimension, r.value): r.events for r in rows} == {
        ("event_type", "view_item"): 2,
        ("source", "unknown"): 1,
        ("source", "website"): 1,
        ("device", "desktop"): 2,
    }
