import gzip
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tillstream import schemas
from tillstream.operators import cleaning, keys, sessions
from tillstream.plans import pipeline, registry, report
from tillstream.sources import readers, sinks
from tillstream.streaming import ingest

EVENT = {
    "event_id": "evt_1",
    "event_type": "add_to_cart",
    "timestamp": "2031-02-03T04:05:06.000789",
    "session_id": "sess_1",
    "customer_id": 42,
    "source": "website",
    "device": "mobile",
    "product_id": 3,
    "product_price_vnd": 1000,
    "quantity": "two",
}


def _gz(path, rows):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        json.dump(rows, f)


def test_schemas_parse(spark):
    assert all(schemas.schema(e).fields for e in schemas.ENTITIES)


def test_json_array_keeps_file_order_and_odd_values(spark, tmp_path):
    rows = [{**EVENT, "event_id": f"evt_{i}"} for i in (5, 3, 9)]
    _gz(tmp_path / "cart_events.json.gz", rows)
    df = readers.read_json_arrays(spark, "cart_events", str(tmp_path / "missing.json.gz"), str(tmp_path / "cart_events.json.gz"))
    assert [r.event_id for r in df.orderBy("ingest_ord").collect()] == ["evt_5", "evt_3", "evt_9"]
    (row,) = cleaning.prepared_events(df).limit(1).collect()
    assert (row.quantity, row.product_price_vnd, row.utm_source) == (0.0, 1000.0, "unknown")
    assert sessions.session_metrics(cleaning.prepared_events(df)).first().total_events == 3


def test_missing_file_is_no_data_but_missing_table_is_an_error(spark, tmp_path):
    assert readers.read_json_arrays(spark, "products", str(tmp_path / "none.json.gz")).count() == 0
    with pytest.raises(AnalysisException):
        readers.read_table(spark, str(tmp_path / "none"))


def test_batched_files(spark, tmp_path):
    for batch in range(2):
        _gz(tmp_path / f"customers_batch_{batch}.json.gz", [{"id": batch * 10_000 + i, "city": "Hue"} for i in (1, 2)])
    df = readers.read_batched(spark, "customers", str(tmp_path))
    assert sorted((r.batch, r.id) for r in df.collect()) == [(0, 1), (0, 2), (1, 10001), (1, 10002)]
    assert readers.customer_by_id(spark, str(tmp_path), 10002).count() == 1
    assert readers.customer_by_id(spark, str(tmp_path), 99999).count() == 0
    assert (readers.batch_of_customer(10_000), readers.batch_of_page(1001, 50)) == (0, 1)


def test_guarded_write(spark, tmp_path):
    out, df = str(tmp_path / "t"), spark.range(3)
    sinks.write_guarded(df, out)
    with pytest.raises(AnalysisException):
        sinks.write_guarded(df, out)
    sinks.write_guarded(df, out, method="new")
    assert spark.read.parquet(out).count() == 6


@pytest.fixture
def raw(make_events):
    days = [f"2025-01-0{1 + i % 3}T10:{i:02d}:00" for i in range(30)]
    return make_events(
        *[{"event_id": f"e{i % 25}", "timestamp": t, "session_id": f"s{i % 4}", "product_id": i % 3} for i, t in enumerate(days)]
    )


def test_pipeline_reruns_to_the_same_tables(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    first = report.run_aggregation(spark, out) if pipeline.run_transformation(raw, out) else None
    rows = sorted(map(str, readers.read_table(spark, f"{out}/{pipeline.EVENTS}").collect()))
    again = pipeline.run_pipeline(raw, out)
    assert sorted(map(str, readers.read_table(spark, f"{out}/{pipeline.EVENTS}").collect())) == rows
    assert len(rows) == 25 and first["event_stats"] == again["event_stats"]
    assert dict(readers.read_table(spark, f"{out}/{pipeline.EVENTS}").dtypes)["date"] == "date"
    stored = json.loads(spark.read.text(f"{out}/{report.METRICS_JSON}").first().value)
    assert stored["event_stats"][0]["total_events"] == 25
    text = [r.value for r in spark.read.text(f"{out}/{report.REPORT_TEXT}").collect()]
    assert "total events: 25" in text and "# device distribution" in text
    parts = sessions.journey_parts(None, pieces=readers.read_table(spark, f"{out}/{pipeline.PIECES}"))
    assert parts.agg(F.sum("events")).first()[0] == 25
    pipeline.append_events(spark, raw, out)
    assert sorted(map(str, readers.read_table(spark, f"{out}/{pipeline.EVENTS}").collect())) == rows


def _tables(spark, out):
    names = (pipeline.EVENTS, pipeline.SESSIONS)
    tables = [readers.read_table(spark, f"{out}/{n}") for n in names]
    parts = sessions.journey_parts(None, pieces=readers.read_table(spark, f"{out}/{pipeline.PIECES}"))
    summary = spark.read.option("header", True).csv(f"{out}/{pipeline.SUMMARY}").drop("event_type_distribution")
    return [sorted(str(r.asDict()) for r in t.select(*sorted(t.columns)).collect()) for t in (*tables, parts, summary)]


def test_rerun_over_fewer_dates_and_append(spark, raw, tmp_path):
    raw = raw.where("ingest_ord < 25")  # each id once: which copy of an id is first depends on the batches
    early, late = raw.where("timestamp < '2025-01-02T12'"), raw.where("timestamp >= '2025-01-02T12'")
    for name, part in (("all", raw), ("early", early)):
        pipeline.run_transformation(part, str(tmp_path / name))
    whole, half = _tables(spark, tmp_path / "all"), _tables(spark, tmp_path / "early")
    pipeline.run_transformation(raw, str(tmp_path / "again"))
    pipeline.run_transformation(early, str(tmp_path / "again"))
    assert _tables(spark, tmp_path / "again") == half
    pipeline.append_events(spark, late, str(tmp_path / "again"))
    assert _tables(spark, tmp_path / "again") == whole


def test_metrics_can_be_added(raw):
    registry.metric("biggest_sessions")(lambda events, s: s.orderBy(F.desc("total_events")).limit(1).select("total_events"))
    events = cleaning.prepared_events(raw)
    found = registry.run_metrics(events, sessions.session_metrics(events), ["biggest_sessions"])
    del registry.METRICS["biggest_sessions"]
    assert found["biggest_sessions"].first().total_events >= 6


def _arrive(raw, folder, batches=3):
    """The rows in ingest order, one file per batch."""
    rows = raw.orderBy("ingest_ord").collect()
    size = -(-len(rows) // batches)
    for i in range(batches):
        chunk = raw.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], raw.schema)
        chunk.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def stream(spark, raw, tmp_path):
    folder = str(tmp_path / "arriving")
    _arrive(raw, folder)
    return lambda: readers.stream_parquet(spark, folder, files_per_batch=1)


def test_exact_stream_equals_batch(spark, raw, stream, tmp_path):
    out = str(tmp_path / "stored")
    ingest.run_batches(stream(), ingest.exact_writer(out), str(tmp_path / "cp"))
    stored = spark.read.parquet(out)
    assert stored.select("batch_id").distinct().count() == 3
    same = ["event_id", "ingest_ord", "session_id", "timestamp", "quantity"]
    assert sorted(stored.select(same).collect()) == sorted(cleaning.prepared_events(raw).select(same).collect())


def test_stream_totals_and_sink(spark, raw, stream, tmp_path):
    events = ingest.dedup_stream(ingest.clean_stream(stream()), None)
    out = str(tmp_path / "totals")
    ingest.run_batches(ingest.session_totals(events), ingest.latest_writer(out), str(tmp_path / "cp1"), "update")
    got = {r.session_id: r.total_events for r in ingest.latest_rows(spark, out, "session_id").collect()}
    want = sessions.session_metrics(cleaning.prepared_events(raw)).collect()
    assert got == {r.session_id: r.total_events for r in want}
    dated = str(tmp_path / "dated")
    for _ in range(2):  # a restart from the checkpoint adds nothing
        bounded = ingest.dedup_stream(ingest.clean_stream(stream()), "7 days")
        ingest.append_by_date(bounded, dated, str(tmp_path / "cp2"))
    assert spark.read.parquet(dated).count() == 25


def test_events_out_of_order_are_all_kept(spark, raw, tmp_path):
    """Newest days first, one file per micro-batch: nothing is dropped as late."""
    folder, out = str(tmp_path / "backwards"), str(tmp_path / "stored")
    _arrive(raw.withColumn("ingest_ord", -F.unix_timestamp(F.col("timestamp").cast("timestamp"))), folder, 4)
    events = ingest.dedup_stream(ingest.clean_stream(readers.stream_parquet(spark, folder, files_per_batch=1)))
    ingest.append_by_date(events, out, str(tmp_path / "cp"))
    want = {r.event_id for r in cleaning.prepared_events(raw).select("event_id").collect()}
    got = [r.event_id for r in spark.read.parquet(out).select("event_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_as_of_batch_columns_grow(spark, stream, tmp_path):
    out = str(tmp_path / "asof")
    events = ingest.dedup_stream(ingest.clean_stream(stream()), None)
    writer = ingest.as_of_batch_writer(out, str(tmp_path / "state"))
    ingest.run_batches(events, writer, str(tmp_path / "cp"))
    rows = spark.read.parquet(out).filter("session_id = 's0'").orderBy("batch_id", "event_sequence_num").collect()
    totals = {}
    for r in rows:
        totals.setdefault(r.batch_id, set()).add(r.total_events)
        assert len(r.event_journey.split(",")) == r.total_events
    assert [len(t) for t in totals.values()] == [1] * len(totals)
    assert sorted(totals.items()) == sorted(totals.items(), key=lambda kv: min(kv[1]))
    assert all(r.event_sequence_num <= len(rows) for r in rows)
    assert min(r.event_sequence_num for r in rows if r.batch_id == max(totals)) == 1


def test_unreadable_and_late_rows_are_kept_and_counted(spark, make_events, tmp_path):
    folder, at = str(tmp_path / "in"), lambda name: str(tmp_path / name)
    raw = make_events(
        {"timestamp": "2025-01-05T00:00:00"},
        {"timestamp": "yesterday"},
        {"timestamp": None},
        {"timestamp": "2025-01-05T01:00:00", "customer_id": None},
    )
    writer = ingest.exact_writer(at("stored"), at("aside"), at("counters"))
    late = ingest.late_writer(at("late"), at("seen"), "1 day")
    more = make_events({"event_id": "e0"}, {"event_id": "old", "timestamp": "2025-01-03T23:59:59"}, {"event_id": "edge", "timestamp": "2025-01-04T00:00:00"}, {"event_id": "new", "timestamp": "2025-01-04T00:00:01"})
    for batch in (raw, more):
        batch.coalesce(1).write.mode("append").parquet(folder)
        ingest.run_batches(readers.stream_parquet(spark, folder), writer, at("cp1"))
        cleaned = ingest.clean_stream(readers.stream_parquet(spark, folder))
        ingest.run_batches(cleaned, late, at("cp2"))
    assert sorted(r.event_id for r in spark.read.parquet(at("aside")).collect()) == ["e1", "e2"]
    assert sorted(r.event_id for r in spark.read.parquet(at("stored")).collect()) == ["e0", "edge", "new", "old"]
    assert sorted(r.event_id for r in spark.read.parquet(at("late")).collect()) == ["e0", "edge", "old"]
    counts = ingest.run_counters(spark, at("counters")).first().asDict()
    assert counts == {
        "processed_events": 8, "invalid_events": 1, "unreadable_events": 2, "stored_events": 4, "duplicate_events": 1,
    }


def test_absent_sources_and_ids_for_rows_read_from_files(spark, raw, tmp_path):
    folder = str(tmp_path / "lines")
    columns = [c for c in raw.columns if c != "ingest_ord"]
    for part in ("a", "b"):
        raw.select(*columns).coalesce(1).write.json(f"{folder}/{part}")
    read = [readers.read_json_lines(spark, "cart_events", f"{folder}/{part}") for part in ("a", "b")]
    absent = readers.read_json_lines(spark, "cart_events", f"{folder}/none")
    rows = read[0].unionByName(read[1]).unionByName(absent)
    existing = spark.createDataFrame([(7,)], "id bigint")
    found = keys.append_surrogate_ids(existing, rows).orderBy("ingest_ord").select("id").collect()
    assert [r.id for r in found] == list(range(8, 8 + 2 * raw.count()))


def test_json_lines_stream_keeps_the_first_copy(spark, make_events, tmp_path):
    folder, out = str(tmp_path / "lines"), str(tmp_path / "stored")
    raw = make_events({"event_id": "a", "quantity": "1"}, {"event_id": "a", "quantity": "2"}, {"event_id": "b"})
    for _ in range(2):  # the second file repeats the first
        raw.drop("ingest_ord").coalesce(1).write.mode("append").json(folder)
    stream = readers.stream_json_lines(spark, "cart_events", folder, files_per_batch=1)
    ingest.run_batches(stream, ingest.exact_writer(out), str(tmp_path / "cp"))
    rows = spark.read.parquet(out).select("event_id", "quantity").collect()
    assert sorted((r.event_id, r.quantity) for r in rows) == [("a", 1.0), ("b", 1.0)]


def test_array_files_are_written_by_one_job(spark, tmp_path):
    """Customers without a number too, in a file of their own; the number of jobs doesn't grow with the files."""
    from tillstream.catalog import queries

    given = tmp_path / "given"
    spark.createDataFrame([(0, "N0")], "n_nationkey int, n_name string").write.parquet(str(given / "nation.parquet"))
    rows = [(i, 0, f"C{i}", "M", 1.0) for i in (*range(1, 2000, 50), None)]
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_name string, c_mktsegment string, c_acctbal double").write.parquet(str(given / "customer.parquet"))
    context, folder = spark.sparkContext, str(tmp_path / "files")
    try:
        context.setJobGroup("arrays", "arrays")
        queries._array_files(spark, str(given), folder)
        jobs = context.statusTracker().getJobIdsForGroup("arrays")
    finally:
        context._jsc.clearJobGroup()
    assert len(jobs) < 8
    back = readers.read_batched(spark, "customers", folder)
    assert {(r.id, r.batch) for r in back.collect()} == {(i, (i - 1) // 200) for i in range(1, 2000, 50)} | {(None, None)}
    assert {r.id for r in readers.read_batched(spark, "customers", folder, 3).collect()} == {601, 651, 701, 751}
