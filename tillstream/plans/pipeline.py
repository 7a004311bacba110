"""The event pipeline: raw events in; events, sessions and a daily summary out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillstream.operators.cleaning import is_valid, new_events, prepared_events
from tillstream.operators.metrics import daily_summary
from tillstream.operators.ranking import one_row
from tillstream.operators.sessions import enrich_events, session_metrics, session_pieces
from tillstream.session import materialise, observed
from tillstream.sources.sinks import write_csv, write_partitioned, write_table

EVENTS, SESSIONS, PIECES, SUMMARY, STATISTICS = (
    "cart_events_cleaned",
    "session_metrics.parquet",
    "session_pieces.parquet",
    "transformation_summary.csv",
    "run_statistics.parquet",
)


def transform_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enriched events and session rows as lazy frames."""
    events = prepared_events(raw)
    return enrich_events(events), session_metrics(events)


def run_transformation(raw: DataFrame, out_dir: str) -> dict[str, str]:
    """Write events (by date), sessions, their pieces and the daily summary.

    Two tables come first: the cleaned, de-duplicated events in the shared folder (the
    raw files are parsed once), and their session pieces (sessions are ordered once;
    ``journey_parts`` reads whole journeys from them). The other outputs read only the
    columns they need from these, and work lost with an executor is redone from there.
    They are submitted together to fill each other's idle slots; only the events wait for
    the session table, whose columns they take.
    The run's counters are observed while the first table is written; sessions and
    customers are counted on the pieces.
    """
    spark = raw.sparkSession
    paths = {name: f"{out_dir}/{name}" for name in (EVENTS, SESSIONS, PIECES, SUMMARY, STATISTICS)}
    seen, kept = Observation(), Observation()
    valid = F.coalesce(is_valid(), F.lit(False))
    incoming = [F.count(F.lit(1)).alias("processed_events"), F.count_if(valid).alias("valid_events")]
    left = [F.count(F.lit(1)).alias("cleaned_events"), F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    events = materialise(prepared_events(raw.observe(seen, *incoming)).observe(kept, *left), "prepared-events")
    counts = {**observed(seen, raw, *incoming), **observed(kept, events, *left)}
    write_table(session_pieces(events), paths[PIECES])
    pieces = spark.read.parquet(paths[PIECES])

    def sessions_and_events():
        write_table(session_metrics(None, pieces=pieces), paths[SESSIONS])
        write_partitioned(enrich_events(events, pieces=pieces, table=spark.read.parquet(paths[SESSIONS])), paths[EVENTS])

    outputs = [
        sessions_and_events,
        lambda: write_csv(daily_summary(events), paths[SUMMARY]),
        lambda: write_table(_statistics(counts, pieces), paths[STATISTICS]),
    ]
    with ThreadPoolExecutor(len(outputs)) as pool:
        for job in [pool.submit(write) for write in outputs]:
            job.result()
    return paths


def _statistics(counts: dict, pieces: DataFrame) -> DataFrame:
    """One row, as ``run_statistics`` counts it, from what the run observed and its pieces."""
    whole = lambda n, name: F.lit(n).cast("bigint").alias(name)
    day = lambda name: F.lit(counts[name]).cast("date").alias(name)
    customers = pieces.select(F.explode("customers").alias("customer_id"))
    return one_row(
        pieces.agg(F.count_distinct("session_id").alias("unique_sessions")),
        customers.agg(F.count_distinct("customer_id").alias("unique_customers")),
    ).select(
        whole(counts["processed_events"], "processed_events"),
        whole(counts["processed_events"] - counts["valid_events"], "invalid_events"),
        whole(counts["valid_events"] - counts["cleaned_events"], "duplicate_events"),
        whole(counts["cleaned_events"], "cleaned_events"),
        "unique_sessions",
        "unique_customers",
        day("first_date"),
        day("last_date"),
    )


def _dates(rows: DataFrame) -> Column:
    """Whether a row's date is one of those of ``rows``: as many values as days, so folders are left out by it."""
    known = [r["date"] for r in rows.select("date").distinct().collect()]
    found = F.col("date").isin([d for d in known if d is not None])
    return F.coalesce(found, F.lit(False)) if None not in known else F.col("date").isNull() | found


def touched_by(raw: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a batch of raw events changes in the stored events: the ids of the sessions that get new
    events, these sessions' pieces and table rows, and all rows of the dates on which they have events.

    All is written apart: a table being read must not change under a write. Of the stored events, ids
    and dates are read whole, the wide rows only where their date has such a session.
    """
    fresh = materialise(new_events(prepared_events(raw), stored.select("event_id")), "append-events")
    touched = materialise(fresh.select("session_id").distinct(), "touched-sessions")
    held = stored.where(_dates(stored.select("session_id", "date").join(touched, "session_id", "left_semi")))
    again = held.join(touched, "session_id", "left_semi").select(*fresh.columns).unionByName(fresh)
    again = materialise(again, "touched-events")
    pieces = materialise(session_pieces(again), "touched-pieces")
    table = materialise(session_metrics(None, pieces=pieces), "touched-table")
    others = stored.where(_dates(again)).join(touched, "session_id", "left_anti")
    rows = others.unionByName(enrich_events(again, pieces=pieces, table=table))
    return touched, pieces, table, materialise(rows, "touched-dates")


def append_events(spark: SparkSession, raw: DataFrame, out_dir: str) -> None:
    """Append a batch's new events (ids already there are skipped) and bring all tables up to date.

    Sessions that the batch touches are computed anew from their stored and new events. Only the
    dates on which such a session has events are rewritten; the other sessions keep their rows.
    """
    paths = {name: f"{out_dir}/{name}" for name in (EVENTS, SESSIONS, PIECES, SUMMARY)}
    touched, pieces, table, rows = touched_by(raw, spark.read.parquet(paths[EVENTS]))
    write_partitioned(rows, paths[EVENTS], only_present=True)
    for name, new in ((SESSIONS, table), (PIECES, pieces)):
        kept = spark.read.parquet(paths[name]).join(touched, "session_id", "left_anti")
        write_table(materialise(kept.unionByName(new), "append-sessions"), paths[name])
    write_csv(daily_summary(spark.read.parquet(paths[EVENTS])), paths[SUMMARY])


def run_pipeline(raw: DataFrame, out_dir: str) -> dict:
    """Transform, then aggregate what was written; returns the report's metrics."""
    from tillstream.plans.report import run_aggregation

    run_transformation(raw, out_dir)
    return run_aggregation(raw.sparkSession, out_dir)
