"""Published outputs change together, or not at all."""

from __future__ import annotations

import pytest

from tillstream.operators.cleaning import prepared_events
from tillstream.operators.sessions import enrich_events, session_metrics
from tillstream.plans import pipeline, versions


@pytest.fixture
def raw(make_events):
    rows = [{"session_id": f"s{i % 3}", "timestamp": None} for i in range(36, 39)]
    rows = [{"session_id": f"s{i % 3}", "timestamp": f"2025-01-{1 + i % 6:02d}T{i % 5:02d}:00:{i:02d}"} for i in range(36)] + rows
    return make_events(*rows)


def _state(spark, out):
    events = versions.published_events(spark, out)
    tables = [versions.published_table(spark, out, n) for n in (pipeline.SESSIONS, pipeline.PIECES, pipeline.SUMMARY)]
    return [sorted(map(str, t.select(*sorted(t.columns)).collect())) for t in (events, *tables)]


def test_appends_equal_one_run(spark, raw, tmp_path):
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    versions.publish_run(raw, whole)
    versions.publish_run(raw.where("ingest_ord < 10"), parts)
    versions.publish_append(spark, raw.where("ingest_ord between 8 and 20"), parts)  # some ids are there already
    versions.publish_append(spark, raw.where("ingest_ord > 20"), parts)
    versions.publish_append(spark, raw.where("false"), parts)
    assert _state(spark, parts) == _state(spark, whole)
    prepared = prepared_events(raw)
    want = enrich_events(prepared)
    got = versions.published_events(spark, whole)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert versions.published_table(spark, whole, pipeline.SESSIONS).count() == session_metrics(prepared).count()


@pytest.mark.parametrize("fails", ["write_partitioned", "write_table", "write_csv", "_publish"])
def test_a_write_that_fails_changes_nothing(spark, raw, tmp_path, monkeypatch, fails):
    out = str(tmp_path / "out")
    versions.publish_run(raw.where("ingest_ord < 20"), out)
    before = _state(spark, out)

    def stopped(*args, **kwargs):
        raise OSError("stopped here")

    with monkeypatch.context() as patched:
        patched.setattr(versions, fails, stopped)
        with pytest.raises(OSError):
            versions.publish_append(spark, raw.where("ingest_ord >= 20"), out)
    assert _state(spark, out) == before
    versions.publish_append(spark, raw.where("ingest_ord >= 20"), out)
    whole = str(tmp_path / "whole")
    versions.publish_run(raw, whole)
    assert _state(spark, out) == _state(spark, whole)


def test_nothing_published(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.pointer(spark, str(tmp_path))
