"""What a run and an appended batch read and count."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tillstream.operators import ranges
from tillstream.operators.cleaning import prepared_events
from tillstream.operators.sessions import enrich_events, session_metrics, session_pieces
from tillstream.plans import pipeline
from tillstream.session import materialise


def _plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_an_append_reads_wide_rows_of_its_dates_only(spark, make_events, tmp_path, monkeypatch):
    rows = [{"session_id": f"s{i}", "timestamp": f"2025-01-{1 + i:02d}T00:00:00"} for i in range(8)]
    rows += [{"session_id": "s2", "timestamp": "2025-01-05T00:00:00"}, {"session_id": "s9", "timestamp": None}]
    raw, out = make_events(*rows), str(tmp_path / "out")
    new = F.col("ingest_ord") >= 8
    pipeline.run_transformation(raw.where(~new), out)
    plans = {}

    def noted(df, label):
        plans[label] = _plan(df)
        return materialise(df, label)

    monkeypatch.setattr(pipeline, "materialise", noted)
    pipeline.append_events(spark, raw.where(new), out)
    for label in ("touched-events", "touched-dates"):  # the stored events are what is read by date
        assert re.search(r"PartitionFilters: \[[^\]]", plans[label])
    got = spark.read.parquet(f"{out}/{pipeline.EVENTS}")
    want = enrich_events(prepared_events(raw))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_events_take_a_written_session_table(spark, make_events):
    raw = make_events(*[{"session_id": f"s{i % 4}", "timestamp": f"2025-01-01T{i % 5:02d}:00:{i:02d}"} for i in range(30)])
    events = materialise(prepared_events(raw), "events")
    pieces = materialise(session_pieces(events), "pieces")
    table = materialise(session_metrics(None, pieces=pieces), "table")
    got, want = enrich_events(events, pieces=pieces, table=table), enrich_events(events)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "collect_list" not in _plan(got)


def test_keys_are_counted_by_buckets(spark, monkeypatch):
    """Two keys in one bucket are large together, not each; the results stay."""
    monkeypatch.setattr(ranges, "BUCKETS", 1)
    rows = spark.range(90).selectExpr("if(id % 3 = 0, null, id % 3) as key", "id as ord")
    for hot in (10, 50, 1000):
        got = ranges.numbered_in_order(rows, ["key"], ["ord"], "n", hot)
        assert {(r.ord, r.n) for r in got.collect()} == {(i, i // 3 + 1) for i in range(90)}
