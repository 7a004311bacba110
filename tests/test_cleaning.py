import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillstream.operators import cleaning


def _ids(df):
    return sorted(r.event_id for r in df.collect())


def test_invalid_first_copy_does_not_hide_a_valid_one(make_events):
    raw = make_events({"event_id": "a", "product_price_vnd": "-1"}, {"event_id": "a", "product_price_vnd": "5"})
    (row,) = cleaning.prepared_events(raw).collect()
    assert row.product_price_vnd == 5.0


def test_first_copy_wins(make_events):
    raw = make_events({"event_id": "a", "quantity": "2"}, {"event_id": "a", "quantity": "7"})
    (row,) = cleaning.prepared_events(raw).collect()
    assert (row.quantity, row.ingest_ord) == (2.0, 0)


def test_dedup_is_idempotent(make_events):
    once = cleaning.prepared_events(make_events(*[{"event_id": f"e{i % 3}"} for i in range(9)]))
    assert sorted(once.collect()) == sorted(cleaning.dedup_events(once).collect())


def test_rows_without_keys_and_guests_are_dropped(make_events):
    raw = make_events({"event_id": "ok"}, {"customer_id": None}, {"session_id": None}, {"event_type": None})
    assert _ids(cleaning.clean_events(raw)) == ["ok"]


def test_unreadable_numbers_become_zero_and_gaps_are_filled(make_events):
    (row,) = cleaning.clean_events(make_events({"quantity": "x", "product_price_vnd": None})).collect()
    assert (row.quantity, row.product_price_vnd, row.line_total_vnd) == (0.0, 0.0, 0.0)
    assert (row.utm_source, row.utm_medium, row.utm_campaign, row.referrer) == ("unknown",) * 3 + ("direct",)


def test_timestamps_with_and_without_fraction_or_suffix(make_events):
    raw = make_events(
        {"timestamp": "2025-01-01T10:00:00"},
        {"timestamp": "2025-01-01T10:00:00.5"},
        {"timestamp": "2025-01-01T10:00:00Z"},
        {"timestamp": "2025-01-01T10:00:00+00:00"},
    )
    rows = cleaning.clean_events(raw).orderBy("ingest_ord").collect()
    assert [r.timestamp.microsecond for r in rows] == [0, 500000, 0, 0]
    assert {(str(r.date), r.hour) for r in rows} == {("2025-01-01", 10)}


def test_malformed_time_raises_or_is_set_aside(make_events):
    raw = make_events({"event_id": "good"}, {"event_id": "bad", "timestamp": "yesterday"})
    with pytest.raises(PySparkException):
        cleaning.clean_events(raw).collect()
    assert _ids(cleaning.clean_events(raw, strict=False)) == ["good"]
    assert _ids(cleaning.malformed_events(raw)) == ["bad"]


def test_run_statistics(make_events):
    raw = make_events(
        {"event_id": "a"}, {"event_id": "a"}, {"event_id": "b", "quantity": "-1"}, {"event_id": "c", "session_id": "t"}
    )
    (row,) = cleaning.run_statistics(raw).collect()
    assert row.asDict() | {"first_date": None, "last_date": None} == {
        "processed_events": 4,
        "invalid_events": 1,
        "duplicate_events": 1,
        "cleaned_events": 2,
        "unique_sessions": 2,
        "unique_customers": 1,
        "first_date": None,
        "last_date": None,
    }


def test_new_events(make_events):
    events = make_events({"event_id": "a"}, {"event_id": "b"})
    assert _ids(cleaning.new_events(events, events.filter("event_id = 'a'"))) == ["b"]


def test_dedup_limits_groups_before_the_exchange(make_events):
    plan = cleaning.prepared_events(make_events({}))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "PythonUDF" not in plan


def test_known_ids_are_exchanged_not_broadcast(spark):
    events = spark.range(10).select(F.concat(F.lit("e"), "id").alias("event_id"))
    fresh = cleaning.new_events(events, events.where("event_id < 'e5'"))
    assert [r.event_id for r in fresh.orderBy("event_id").collect()] == [f"e{i}" for i in range(5, 10)]
    plan = fresh._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
