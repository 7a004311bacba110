"""Incremental ingest: cleaning, de-duplication, session totals and sinks.

Two ways to drop repeated events:

* :func:`dedup_stream` keeps every id in the state store, so no event is lost however
  late it comes; which copy survives inside one micro-batch is open. A delay bounds the
  state, and then Spark drops events that come later than that.
* :func:`exact_writer` cleans and de-duplicates each micro-batch like the batch
  pipeline and leaves out the ids stored so far, so the first copy always wins. It asks
  an :class:`IdStore`, which reads only what its filters name.

Micro-batch writers write below ``batch_id=<n>`` and replace that folder when a batch
is replayed, which makes them idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillstream.functions import iso_timestamp_or_null
from tillstream.operators.cleaning import clean_events, dedup_events, is_valid, new_events
from tillstream.operators.ranking import first_per_key, numbered_in_segments
from tillstream.operators.sessions import (
    _ORDER,
    _collected_types,
    _duration,
    _journey,
    _order_only,
    _segment,
    session_pieces,
)
from tillstream.session import materialise, observed
from tillstream.sources.readers import path_exists, with_rows
from tillstream.streaming.idstore import IdStore

BatchWriter = Callable[[DataFrame, int], None]


def clean_stream(raw: DataFrame) -> DataFrame:
    """Cleaned events plus ``event_time``, the zoned type watermarks need. Rows with an unreadable time
    are left out: :func:`set_aside` over the same input stores them."""
    return clean_events(raw, strict=False).withColumn("event_time", F.col("timestamp").cast("timestamp"))


def dedup_stream(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Drop repeated ids. With a ``delay``, ids are forgotten after it and events later than it are dropped."""
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def session_totals(events: DataFrame, journey: bool = True, gap: str | None = None, delay: str | None = None) -> DataFrame:
    """Running sessions with all columns of the batch form (for update or complete mode).

    The state of a session is a few values: its span, size and first known customer, source and
    device by (time, position). With ``journey`` it is also the steps so far, in a list that grows
    with the session, as the result's journey does. Steps may come in any order; the journey is
    always in order of time. With a ``gap`` (append mode) a session has one row, when it has been inactive
    for it and the watermark, ``delay`` behind the newest event, has passed; it then leaves the state, and
    what comes later is a session anew.
    """
    key = [F.col("session_id")]
    if gap is not None:
        events = events.withWatermark("event_time", delay)
        key.append(F.session_window("event_time", gap).alias("window"))
    firsts = ("customer_id", "source", "device")
    earliest = {c: F.min(F.when(F.col(c).isNotNull(), F.struct(*_ORDER, c))).alias(f"first_{c}") for c in firsts}
    totals = events.groupBy(*key).agg(
        F.min("timestamp").alias("session_start"),
        F.max("timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("total_events"),
        *([F.collect_list(F.struct(*_ORDER, "event_type")).alias("steps")] if journey else []),
        F.bool_or(F.col("event_type") == "purchase").alias("has_purchase_event"),
        *earliest.values(),
    )
    path = F.array_join(F.transform(F.sort_array("steps"), lambda s: s["event_type"]), ",").alias("event_journey")
    return totals.select(
        "session_id",
        "session_start",
        "session_end",
        "total_events",
        *([path] if journey else []),
        *[F.col(f"first_{c}")[c].alias(c) for c in firsts],
        _duration(),
        F.lit(False).alias("has_purchase"),
        "has_purchase_event",
    )


def run_available(writer, checkpoint: str) -> None:
    """Run a stream writer over everything there is now, then stop; a ``ProgressLog`` added to the
    session's streams stores what each micro-batch reports."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_by_date(events: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Exactly-once append to a dated parquet table."""
    writer = events.writeStream.format("parquet").outputMode("append").partitionBy("date").option("path", out_dir)
    run_available(writer, checkpoint)


def run_batches(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append") -> None:
    run_available(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint)


def latest_writer(out_dir: str) -> BatchWriter:
    """Store each micro-batch's changed rows; :func:`latest_rows` reads the newest per key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return write


def latest_rows(spark, out_dir: str, key: str) -> DataFrame:
    return first_per_key(spark.read.parquet(out_dir), [key], [F.desc("batch_id")]).drop("batch_id")


def unreadable_events(raw: DataFrame) -> DataFrame:
    """Valid rows whose time is missing or cannot be read: a stream sets them aside."""
    return raw.filter(is_valid() & iso_timestamp_or_null(F.col("timestamp")).isNull())


def set_aside(raw: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Store a raw stream's valid rows with an unreadable time, which ``clean_stream`` leaves out, and as
    it got them. Run it beside the stream that uses the others, over the same files."""
    writer = unreadable_events(raw).writeStream.format("parquet").outputMode("append").option("path", out_dir)
    run_available(writer, checkpoint)


def exact_writer(out_dir: str, aside_dir: str | None = None, counters_dir: str | None = None) -> BatchWriter:
    """Clean, de-duplicate and store a raw micro-batch; ids stored by earlier batches are skipped.

    The ids lie in a folder of their own beside ``out_dir``. An unreadable time is an error, unless
    ``aside_dir`` takes such rows. ``counters_dir`` gets one row of counters per batch;
    :func:`run_counters` adds them up.
    """

    def write(raw: DataFrame, batch_id: int) -> None:
        spark = raw.sparkSession
        own = f"{out_dir}/batch_id={batch_id}"
        ids = IdStore(spark, out_dir.rstrip("/") + "-ids")
        unread = is_valid() & iso_timestamp_or_null(F.col("timestamp")).isNull()
        # The counters are taken by the writes themselves: no row is read for them again.
        seen, kept = Observation(), Observation()
        incoming = [
            F.count(F.lit(1)).alias("processed_events"),
            F.count_if(~F.coalesce(is_valid(), F.lit(False))).alias("invalid_events"),
            F.count_if(F.coalesce(unread, F.lit(False))).alias("unreadable_events"),
        ]
        left = F.count(F.lit(1)).alias("stored_events")
        counted = raw.observe(seen, *incoming)
        # the batch's ids are looked up before its rows are written
        events = materialise(dedup_events(clean_events(with_rows(counted), strict=aside_dir is None)), "micro-batch")
        schema = events.schema
        known = ids.seen(events.select(F.col("event_id").alias("id")), batch_id)
        events = new_events(events, known.select(F.col("id").alias("event_id")))
        events.observe(kept, left).write.mode("overwrite").partitionBy("date").parquet(own)
        stored = spark.read.schema(schema).parquet(own)
        ids.add(stored.select(F.col("event_id").alias("id")), batch_id)
        if aside_dir is not None:
            unreadable_events(raw).write.mode("overwrite").parquet(f"{aside_dir}/batch_id={batch_id}")
        if counters_dir is not None:
            counts = {**observed(seen, raw, *incoming), **observed(kept, stored, left)}
            counts["duplicate_events"] = 2 * counts["processed_events"] - sum(counts.values())
            row = spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()])
            row.write.mode("overwrite").parquet(f"{counters_dir}/batch_id={batch_id}")

    return write


def run_counters(spark, counters_dir: str) -> DataFrame:
    """The counters of all micro-batches together, in one row."""
    per_batch = spark.read.parquet(counters_dir).drop("batch_id")
    return per_batch.agg(*[F.sum(c).alias(c) for c in per_batch.columns])


def late_writer(out_dir: str, seen_dir: str, delay: str, behind: int = 1) -> BatchWriter:
    """Store the rows that come more than ``delay`` behind the newest event of earlier batches.

    A watermark of that delay drops such rows unseen; this table has and counts them. Each batch
    stores the newest time so far, so the next one reads a single row. With ``behind=2`` the batch
    just before doesn't count: that is how Spark's stateful operators tell late rows when each
    micro-batch follows the one before in the same run.
    """

    def write(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        newest = events.agg(F.max("event_time").alias("newest"))
        late = events.limit(0)
        last, before = (f"{seen_dir}/batch_id={batch_id - n}" for n in (1, behind))
        if path_exists(spark, last):
            newest = newest.unionByName(spark.read.parquet(last)).agg(F.max("newest").alias("newest"))
        if path_exists(spark, before):
            known = spark.read.parquet(before)
            mark = known.select(F.lit(1).alias("_one"), (F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
            # one row on the right
            late = events.withColumn("_one", F.lit(1)).join(F.broadcast(mark), "_one")
            late = late.filter("event_time <= _mark").drop("_one", "_mark")
        late.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        newest.write.mode("overwrite").parquet(f"{seen_dir}/batch_id={batch_id}")

    return write


def as_of_batch_writer(out_dir: str, state_dir: str) -> BatchWriter:
    """Events with their session's columns *as known when their batch arrived*.

    The state table holds one small row per piece of a session and batch. Numbers
    restart in every batch and journeys grow in arrival order.
    """

    def write(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        # several jobs follow; the micro-batch's stateful plan must run once only
        events = materialise(events, "micro-batch")
        own = session_pieces(_order_only(events))
        own.write.mode("overwrite").parquet(f"{state_dir}/batch_id={batch_id}")
        known = spark.read.parquet(state_dir).filter(F.col("batch_id") <= batch_id)
        touched = events.select("session_id").distinct()
        sessions = (
            known.join(touched, "session_id", "left_semi")
            .groupBy("session_id")
            .agg(
                F.sum("n").alias("total_events"),
                F.min("first_time").alias("session_start"),
                F.max("last_time").alias("session_end"),
                _collected_types("batch_id", "segment", "piece").alias("parts"),
            )
            .select(
                "session_id",
                "session_start",
                "session_end",
                _duration(),
                "total_events",
                _journey("parts").alias("event_journey"),
            )
        )
        numbered = numbered_in_segments(events, ["session_id"], _segment(), _ORDER, "event_sequence_num")
        numbered.join(sessions, "session_id").write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return write
