"""The aggregation: one pass over the events, files that read back as the metrics."""

from __future__ import annotations

import pytest

from tillstream.operators import cleaning, sessions
from tillstream.plans import pipeline, registry, report
from tillstream.plans.shared import Shared
from tillstream.session import materialise


@pytest.fixture
def raw(make_events):
    kinds = ["search", "add_to_cart", None, "scroll"]
    rows = [
        {"session_id": f"s{i % 5}", "event_type": kinds[i % 4] or "search", "timestamp": f"2025-01-0{i % 3 + 1}T0{i % 4}:00:{i:02d}", "source": [None, "web"][i % 2], "customer_id": i % 3, "product_id": None if i % 7 == 0 else i % 4}
        for i in range(40)
    ]
    return make_events(*rows)


def test_shared_metrics_equal_single_ones(spark, raw):
    events = materialise(cleaning.prepared_events(raw), "events")
    per_session = materialise(sessions.session_metrics(events), "sessions")
    shared = Shared(events)
    single, together = (sorted(map(str, report.metric_values(events, per_session, shared=s).collect())) for s in (None, shared))
    assert single == together
    assert set(registry.SHARED) | {"session_duration_stats"} == set(registry.METRICS)


def test_events_are_read_once(spark, raw):
    """With the pieces of a run, no metric reads the events: their one aggregate does."""
    events = materialise(cleaning.prepared_events(raw), "events")
    pieces = materialise(sessions.session_pieces(events), "pieces")
    per_session = materialise(sessions.session_metrics(None, pieces=pieces), "sessions")
    shared, source = Shared(events, pieces), set(events.inputFiles())
    for name, frame in registry.run_metrics(events, per_session, shared=shared).items():
        assert not source & set(frame.inputFiles()), name
    assert not source & set(shared.sessions.inputFiles())


def test_written_metrics_read_back(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    collected = pipeline.run_pipeline(raw, out)
    assert list(collected) == list(registry.METRICS)
    events, per_session = spark.read.parquet(f"{out}/{pipeline.EVENTS}"), spark.read.parquet(f"{out}/{pipeline.SESSIONS}")
    want = report.metric_values(events, per_session).where("value is not null")
    got = report.read_metrics(spark, out).where("value is not null")
    rows = lambda df: sorted((r.metric, r.item or "", r.measure, round(r.value, 6)) for r in df.collect())
    assert rows(got) == rows(want)
    text = [r.value for r in spark.read.text(f"{out}/{report.REPORT_TEXT}").collect()]
    assert "total events: 40" in text and "# session duration stats" in text
