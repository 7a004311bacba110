"""Carts of sessions that go inactive, from the stream's own state."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillstream.operators import cleaning
from tillstream.sources import readers
from tillstream.streaming import activity, ingest

KINDS = ["add_to_cart", "remove_from_cart", "update_quantity", None]
moves = st.lists(st.tuples(st.integers(0, 60), st.sampled_from(KINDS), st.integers(1, 3), st.integers(0, 3)), max_size=30)


def _replayed(events, gap, end):
    """Plain replay in order of time: (last activity, value, items) of each closed burst."""
    lines, seen, closed = {}, None, []
    for at, _, kind, product, quantity, price, _ in [*sorted(events, key=lambda e: e[:2]), (end, 0, None, 0, 0, 0, None)]:
        if seen is not None and at >= seen + gap:
            closed.append((seen, sum(q * p for q, p in lines.values()), len(lines)))
        seen = at
        if kind == "add_to_cart":
            q, p = lines.get(product, (0, price))
            lines[product] = (q + quantity, p)
        elif kind and product in lines:
            q = quantity if kind == "update_quantity" else lines[product][0] - quantity
            lines[product] = (q, lines[product][1])
            if q <= 0:
                del lines[product]
    return closed


@settings(max_examples=200, deadline=None)
@given(moves, st.integers(0, 8), st.integers(1, 12), st.integers(1, 5), st.integers(0, 10**6))
def test_out_of_order_arrival_equals_replay(steps, delay, gap, batches, seed):
    rng = random.Random(seed)
    events = [(at, i, kind, product, quantity, 10 + i, "n") for i, (at, kind, product, quantity) in enumerate(steps)]
    # each event comes by its time or up to the delay later
    arrival = sorted(events, key=lambda e: e[0] + rng.randint(0, delay))
    size, known, found, state = -(-len(arrival) // batches) or 1, 0, [], (None, "[]", "[]")
    for lo in [*range(0, len(arrival), size), len(arrival)]:
        cart = activity.SessionCart(*state)  # the state as it is stored
        batch = arrival[lo : lo + size]
        cart.waiting += batch
        left = cart.advance(known - delay - 1, gap)
        if left:
            found.append(left)
        state = cart.state()
        known = max([known, *(e[0] + delay for e in batch)])
    cart = activity.SessionCart(*state)
    left = cart.advance(1000, gap)
    found += [left] if left else []
    want = _replayed(events, gap, 1000)
    # of several bursts that end in one step only the last is told
    assert all(f in want for f in found) and found == sorted(found)
    assert found[-1:] == want[-1:]
    assert not cart.waiting


@pytest.fixture
def arriving(spark, make_events, tmp_path):
    folder = str(tmp_path / "in")

    def arrive(*rows):
        make_events(*rows).coalesce(1).write.mode("append").parquet(folder)

    def run():
        typed = cleaning.typed_events(readers.stream_parquet(spark, folder, files_per_batch=1))
        events = typed.withColumn("event_time", F.col("event_time").cast("timestamp"))
        out = str(tmp_path / "out")
        ingest.run_batches(activity.carts_left(events, "24 hours", "2 hours"), ingest.latest_writer(out), str(tmp_path / "cp"))
        return {r.session_id: (r.last_activity, r.cart_value_vnd, r.item_count) for r in activity.carts_left_now(spark, out).collect()}

    return arrive, run


def _add(session, at, product=1, kind="add_to_cart", quantity="1", **more):
    time = (datetime(2025, 1, 1) + timedelta(hours=at)).isoformat()
    return {"session_id": session, "event_type": kind, "timestamp": time, "product_id": product, "quantity": quantity, "event_id": f"{session}{at}{kind}", "ingest_ord": int(at * 100), **more}


def test_carts_left_over_deliveries_and_restarts(arriving):
    arrive, run = arriving
    arrive(_add("gone", 0, quantity="2"), _add("emptied", 0), _add("back", 0), _add(None, 0), _add("", 0))
    # out of order: the removal comes before an earlier addition
    arrive(_add("emptied", 1, kind="remove_from_cart"), _add("late", 3, kind="scroll"))
    arrive(_add("gone", 1.5, product=2), _add("gone", 1.5, product=0), _add("gone", 1.6, product=None))
    assert run() == {}
    arrive(_add("clock", 30, kind="scroll"))
    got = run()
    assert got["gone"] == (datetime(2025, 1, 1, 1, 36), 30, 2) and got["back"][1:] == (10, 1)
    assert set(got) == {"gone", "back"}
    # activity after the close goes on with the same cart
    arrive(_add("back", 31, quantity="4"))
    arrive(_add("clock", 80, kind="scroll"))
    got = run()
    assert got["back"] == (datetime(2025, 1, 2, 7), 50, 1) and got["gone"][1] == 30
    # two days behind: dropped, and nothing changes
    arrive(_add("gone", 20, product=9))
    arrive(_add("clock", 200, kind="scroll"))
    assert run() == got


def test_a_bucket_opens_only_sessions_with_rows_or_due():
    add = lambda at, n: (at, n, "add_to_cart", 1, n, 10, "P")
    carts = {}
    assert activity._advance_bucket(carts, {"a": [add(1, 1)], "b": [add(5, 2)], "c": [(2, 0, None, 0, 1, 0, None)]}, 0, 10) == ([], 1)
    later = carts["b"]
    # a and c are closed by time alone, and c, emptied, leaves; b isn't opened: its state is of no use here
    kept, carts["b"] = carts["b"], (50, "never", "read", "here")
    left, wake = activity._advance_bucket(carts, {"d": [add(30, 4)]}, 13, 10)
    assert sorted(left) == [("a", 1, 10, 1), ("c", 2, 0, 0)] and wake == 30
    assert set(carts) == {"a", "b", "d"}
    carts["b"] = kept
    left, wake = activity._advance_bucket(carts, {}, 100, 10)
    assert sorted(left) == [("b", 5, 20, 1), ("d", 30, 40, 1)] and wake is None


def test_groups_handed_to_python_are_bounded(spark, make_events, tmp_path):
    """However many sessions there are, a micro-batch has at most as many groups as buckets."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    make_events(*[_add(f"s{i}", i % 3) for i in range(40)], _add("clock", 90)).write.parquet(folder)
    make_events(_add("clock", 120)).write.mode("append").parquet(folder)
    typed = cleaning.typed_events(readers.stream_parquet(spark, folder))
    events = typed.withColumn("event_time", F.col("event_time").cast("timestamp"))
    writer = activity.carts_left(events, "24 hours", "2 hours", buckets=3).writeStream.foreachBatch(ingest.latest_writer(out))
    run = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < run.lastProgress.stateOperators[0].numRowsTotal <= 3
    assert activity.carts_left_now(spark, out).count() == 41


def test_micro_batches_of_several_files_keep_to_their_delivery(spark, tmp_path):
    """Deliveries of fewer rows than files, and empty ones, are one micro-batch each too."""
    from tillstream.catalog import queries

    rows = [(i, datetime(2024, 1, day, 3), i, "view", 1.0, '{"k": 1}') for i, day in enumerate((1, 1, 9, 30), 1)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    batches = []
    stream = queries._arriving(spark, str(tmp_path), "user")
    ingest.run_batches(stream, lambda b, n: batches.append(sorted(r.event_id for r in b.collect())), str(tmp_path / "cp"))
    assert batches == [["evt_1", "evt_2"], [], ["evt_3"], [], [], [], [], ["evt_4"], [], []]
