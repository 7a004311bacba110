"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data
and cores. Every query runs to its last row into a sink that drops the rows; the value is
the median of three runs after a warm-up. ``pipeline_*`` time the whole event transformation,
files written, on the event table copied up (or cut) to that many raw events; ``pipeline_gz_json_*``
the same from gzipped JSON lines, ``aggregation_*`` the report over the files of the last pipeline.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tillstream.catalog.queries import QUERIES  # noqa: E402
from tillstream.plans.pipeline import run_transformation  # noqa: E402
from tillstream.plans.report import run_aggregation  # noqa: E402
from tillstream.session import build_session, scratch_path  # noqa: E402
from tillstream.sources import testtables as tt  # noqa: E402
from tillstream.sources.readers import read_json_lines  # noqa: E402
from tillstream.sources.sinks import write_json_lines  # noqa: E402

HEADLINE = [
    "clean_events",
    "dedup_events",
    "session_metrics",
    "enriched_events",
    "daily_summary",
    "run_statistics",
    "session_duration_stats",
    "purchase_intent",
    "event_stats",
    "event_type_distribution",
    "journey_patterns",
    "events_by_hour",
    "sessions_by_date",
    "cart_statistics",
    "cart_distribution",
    "top_products_added",
    "cart_items",
    "abandoned_carts",
    "find_events",
    "find_orders",
    "customer_order_stats",
    "channel_stats",
    "order_totals",
    "top_products_sold",
    "momo_statistics",
    "zalopay_statistics",
    "zalopay_by_channel",
    "momo_lookup",
    "transaction_lookup",
    "payment_reconciliation",
    "order_line_totals",
    "line_pricing_check",
    "referential_check",
    "append_surrogate_ids",
]
#: Timed and reported too, outside the total, which stays comparable between rounds.
FURTHER = ["transaction_matches", "zalopay_lookup", "aggregation_report", "stream_exact_events"]
RUNS = 3
JSON_SIZE = 500_000
PIPELINE_SIZES = [int(n) for n in os.environ.get("BENCH_EVENTS", "10000,100000,500000,2000000").split(",") if n]


def median_time(run) -> float:
    run()
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 4)


def drop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def copied_events(spark, sf_dir: str, size: int):
    """Raw events, whole copies of the table under new ids and users, as a parquet file."""
    events = tt.table(spark, sf_dir, "events")
    rows = events.count()
    copies = max(1, round(size / rows))
    path = scratch_path(spark, f"events-{size}")
    grown = events.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    grown = grown.withColumns(
        {"event_id": F.expr(f"event_id + n * {rows}L"), "user_id": F.expr("user_id + n * 100000L")}
    ).drop("n")
    if size < rows:
        grown = grown.where(F.col("event_id") <= size)
    grown.repartition(16).write.parquet(path)
    back = spark.read.parquet(path)
    return back, back.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: median_time(lambda: drop(QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    rates = {}
    for size in PIPELINE_SIZES:
        events, rows = copied_events(spark, sf_dir, size)
        seconds = median_time(
            lambda: run_transformation(tt.as_cart_events(events), scratch_path(spark, "bench-pipeline"))
        )
        queries[f"pipeline_{size}"] = seconds
        rates[f"pipeline_{size}"] = round(rows / seconds)
        if size == JSON_SIZE:
            lines = scratch_path(spark, "json-lines")
            write_json_lines(tt.as_cart_events(events).drop("ingest_ord"), lines)
            read = lambda: read_json_lines(spark, "cart_events", lines)
            queries[f"pipeline_gz_json_{size}"] = median_time(lambda: run_transformation(read(), scratch_path(spark, "bench-json")))
    if PIPELINE_SIZES:
        out = scratch_path(spark, "bench-last")
        run_transformation(tt.as_cart_events(events), out)
        queries[f"aggregation_{size}"] = median_time(lambda: run_aggregation(spark, out))
        rates[f"aggregation_{size}"] = round(rows / queries[f"aggregation_{size}"])
    queries |= {name: median_time(lambda: drop(QUERIES[name](spark, sf_dir))) for name in FURTHER}
    headline = sum(queries[name] for name in HEADLINE)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(headline, 3),
                "unit": "sec",
                "queries": queries,
                "events_per_second": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
