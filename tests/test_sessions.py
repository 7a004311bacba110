import random

import pytest

from tillstream.operators import metrics, sessions
from tillstream.operators.cleaning import prepared_events
from tillstream.operators.ranking import exact_median, numbered_in_segments


def test_ties_follow_ingest_order(make_events):
    at = "2025-01-01T10:00:00"
    kinds = ["search", "add_to_cart", "scroll"]
    events = prepared_events(make_events(*[{"event_type": k, "timestamp": at} for k in kinds]))
    (row,) = sessions.session_metrics(events).collect()
    assert row.event_journey == "search,add_to_cart,scroll"
    rows = sessions.enrich_events(events).orderBy("event_sequence_num").collect()
    assert [(r.event_sequence_num, r.event_type) for r in rows] == [(1, "search"), (2, "add_to_cart"), (3, "scroll")]


def test_single_event_session(make_events):
    events = prepared_events(make_events({"event_type": "add_to_cart"}))
    found = sessions.session_metrics(events)
    (row,) = found.collect()
    assert (row.session_duration_seconds, row.total_events, row.has_purchase) == (0.0, 1, False)
    (stats,) = metrics.session_duration_stats(found).collect()
    assert stats.std_duration_seconds is None and stats.median_duration_seconds == 0.0
    (intent,) = metrics.purchase_intent(events).collect()
    assert intent.sessions_with_purchase_intent == 0


def test_first_known_values(make_events):
    events = prepared_events(make_events({"source": None, "device": None}, {"source": "mobile_app"}, {"device": "tablet"}))
    (row,) = sessions.session_metrics(events).collect()
    assert (row.source, row.device) == ("mobile_app", "desktop")


def test_purchase_intent_needs_a_final_add(make_events):
    events = prepared_events(
        make_events(
            {"session_id": "a", "event_type": "view_item"},
            {"session_id": "a", "event_type": "add_to_cart"},
            {"session_id": "b", "event_type": "add_to_cart"},
            {"session_id": "b", "event_type": "view_item"},
            {"session_id": "c", "event_type": "add_to_cart"},
        )
    )
    found = {r.session_id: r.has_purchase_intent for r in metrics.purchase_intent_sessions(events).collect()}
    assert found == {"a": True, "b": False, "c": False}


@pytest.fixture
def long_sessions(make_events):
    """Two equal journeys cut differently in time, one different, one short."""
    rng = random.Random(7)
    kinds = [rng.choice(["view_item", "scroll", "search"]) for _ in range(40)]
    rows = []
    for session, minutes in (("fast", 1), ("slow", 17)):
        for i, kind in enumerate(kinds):
            day, minute = divmod(i * minutes, 24 * 60)
            time = f"2025-01-{day + 1:02d}T{minute // 60:02d}:{minute % 60:02d}:00"
            rows.append({"session_id": session, "event_type": kind, "timestamp": time})
    for i, kind in enumerate(reversed(kinds)):
        rows.append({"session_id": "other", "event_type": kind, "timestamp": f"2025-01-01T10:{i:02d}:00"})
    rows += [{"session_id": "short", "event_type": "scroll"}]
    rng.shuffle(rows)
    return kinds, prepared_events(make_events(*rows))


def test_small_pieces_give_the_same_sessions(long_sessions):
    _, events = long_sessions
    small = sessions.session_metrics(None, pieces=sessions.session_pieces(events, 3))
    assert sorted(small.collect()) == sorted(sessions.session_metrics(events).collect())
    enriched = sessions.enrich_events(events, pieces=sessions.session_pieces(events, 3))
    assert sorted(map(str, enriched.collect())) == sorted(map(str, sessions.enrich_events(events).collect()))


def test_journey_parts_hold_long_journeys_whole(long_sessions):
    kinds, events = long_sessions
    row = {r.session_id: r for r in sessions.session_metrics(events, pieces=sessions.session_pieces(events, 3)).collect()}
    assert row["fast"].event_journey == ",".join(kinds) and row["fast"].total_events == 40
    assert row["short"].event_journey == "scroll"
    parts = sorted(sessions.journey_parts(events, piece_events=3).filter("session_id = 'slow'").collect(), key=lambda r: r.part_no)
    assert ",".join(p.journey_part for p in parts) == ",".join(kinds)
    assert max(p.events for p in parts) <= 3
    assert [p.first_sequence_num for p in parts] == [1 + sum(q.events for q in parts[:i]) for i in range(len(parts))]


def test_equal_journeys_are_one_pattern(long_sessions):
    _, events = long_sessions
    found = sessions.journey_patterns(events).collect()
    assert sorted(r.sessions for r in found) == [1, 1, 2]
    assert "scroll" in {r.journey_pattern for r in found}


def test_very_long_session_keeps_its_journey(spark):
    """Beyond 100,000 events: whole on the session, on each event row, in the patterns and in the parts."""
    n = 100_001
    events = spark.range(n).selectExpr(
        "concat('e', id) as event_id", "id as ingest_ord", "'bot' as session_id", "1L as customer_id", "'web' as source",
        "'desktop' as device", "timestamp_ntz '2025-01-01' + make_dt_interval(0, 0, 0, id) as timestamp",
        "if(id % 2 = 0, 'scroll', 'search') as event_type",
    )
    want = ",".join("scroll" if i % 2 == 0 else "search" for i in range(n))
    row = sessions.session_metrics(events).collect()[0]
    assert row.event_journey == want and row.total_events == n
    assert sessions.journey_patterns(events).collect()[0].journey_pattern == want.replace(",", " -> ")
    assert sessions.enrich_events(events).where(f"length(event_journey) != {len(want)}").count() == 0
    parts = sorted(sessions.journey_parts(events).collect(), key=lambda r: r.part_no)
    assert ",".join(p.journey_part for p in parts) == want


def test_sequence_numbers_equal_a_plain_window(long_sessions):
    _, events = long_sessions
    events.createOrReplaceTempView("prepared")
    plain = events.sparkSession.sql(
        "select event_id, session_id, row_number() over (partition by session_id order by timestamp, ingest_ord) n from prepared"
    )
    assert sorted(map(tuple, sessions.event_sequence(events).collect())) == sorted(map(tuple, plain.collect()))


def test_counts_per_date_add_up(long_sessions):
    _, events = long_sessions
    assert sum(r.events for r in metrics.events_by_date(events).collect()) == events.count()
    daily = metrics.daily_summary(events).collect()
    assert all(sum(r.event_type_distribution.values()) == r.total_events for r in daily)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = [float(rng.choice([0, 0, 1, 500, rng.random() * 1000])) for _ in range(n)]
    ordered = sorted(values)
    want = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_median(df, "x", 60.0).collect()[0].x == pytest.approx(want)


def test_numbering_without_keys(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as ord", "1 as one")
    from pyspark.sql import functions as F

    rows = numbered_in_segments(df, ["one"], F.floor(F.col("ord") / 30), ["ord"], "n").collect()
    assert all(r.n == r.ord + 1 for r in rows)


def test_enrichment_exchanges_wide_rows_by_segment(long_sessions):
    _, events = long_sessions
    plan = sessions.enrich_events(events)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id" in plan and "segment" in plan and "PythonUDF" not in plan
