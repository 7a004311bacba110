"""Running sessions, counters observed in the work, stored progress."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillstream.operators import cleaning, sessions
from tillstream.plans import pipeline
from tillstream.sources import readers
from tillstream.streaming import ingest, progress


@pytest.fixture
def raw(make_events):
    rng = random.Random(4)
    rows = []
    for i in [*range(50), *range(10)]:
        rows.append(
            {
                "event_id": f"e{i}",
                "session_id": f"s{i % 4}",
                "event_type": ["search", "scroll", "purchase"][i % 3],
                "timestamp": f"2025-01-0{i % 5 + 1}T{i % 24:02d}:00:00",
                "customer_id": None if i == 7 else i % 3,
                "source": [None, None, "web"][i % 3],
                "device": None,
            }
        )
    rng.shuffle(rows)
    return make_events(*rows)


@pytest.fixture
def folder(raw, tmp_path):
    path = str(tmp_path / "in")
    for n in range(4):
        raw.where(F.col("ingest_ord") % 4 == n).coalesce(1).write.mode("append").parquet(path)
    return path


def _running(spark, folder, tmp_path, mode="update", **options):
    events = ingest.dedup_stream(ingest.clean_stream(readers.stream_parquet(spark, folder, files_per_batch=1)))
    out = str(tmp_path / "running")
    ingest.run_batches(ingest.session_totals(events, **options), ingest.latest_writer(out), str(tmp_path / "cp"), mode)
    return spark.read.parquet(out)


def test_running_sessions_have_all_columns(spark, folder, tmp_path):
    stored = _running(spark, folder, tmp_path)
    assert stored.select("batch_id").distinct().count() == 4
    got = ingest.latest_rows(spark, str(tmp_path / "running"), "session_id")
    want = sessions.session_metrics(cleaning.prepared_events(readers.read_table(spark, folder)))
    assert got.columns == want.columns
    plain = [c for c in want.columns if c != "source"]  # which of two copies of an event stays is open in a stream
    assert sorted(map(str, got.select(plain).collect())) == sorted(map(str, want.select(plain).collect()))


def test_running_sessions_without_journey_and_with_gap(spark, folder, tmp_path):
    stored = _running(spark, folder, tmp_path, "append", journey=False, gap="5 hours", delay="4 days")
    assert "event_journey" not in stored.columns
    rows = stored.collect()
    assert rows and all(r.session_duration_seconds < 5 * 3600 * r.total_events for r in rows)
    assert len({(r.session_id, r.session_start) for r in rows}) == len(rows)  # one row for each closed session


def test_run_statistics_are_observed(spark, raw, tmp_path):
    paths = pipeline.run_transformation(raw, str(tmp_path / "out"))
    assert spark.read.parquet(paths[pipeline.STATISTICS]).collect() == cleaning.run_statistics(raw).collect()
    none = pipeline.run_transformation(raw.where("false"), str(tmp_path / "none"))
    assert spark.read.parquet(none[pipeline.STATISTICS]).collect() == cleaning.run_statistics(raw.where("false")).na.fill(0).collect()
    bad = raw.withColumn("customer_id", F.lit(None).cast("bigint"))  # all rows are invalid
    row = spark.read.parquet(pipeline.run_transformation(bad, str(tmp_path / "bad"))[pipeline.STATISTICS]).first()
    assert (row.processed_events, row.invalid_events, row.cleaned_events) == (60, 60, 0)


def test_progress_is_stored(spark, folder, tmp_path):
    log = progress.ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(log)
    try:
        writer = ingest.exact_writer(str(tmp_path / "out"), counters_dir=str(tmp_path / "counters"))
        ingest.run_batches(readers.stream_parquet(spark, folder, files_per_batch=1), writer, str(tmp_path / "cp"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    (row,) = progress.totals(progress.read_progress(spark, str(tmp_path / "progress"))).collect()
    assert (row.batches, row.input_rows, row.late_rows) == (4, 60, 0)
    counts = ingest.run_counters(spark, str(tmp_path / "counters")).first()
    assert counts.processed_events == 60 and counts.invalid_events == 2
    assert counts.stored_events + counts.duplicate_events == 58
