"""Aggregation report: the registered metrics as nested JSON and as text."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.plans import pipeline
from tillstream.plans.registry import METRICS, run_metrics
from tillstream.plans.shared import Shared
from tillstream.sources.readers import read_table
from tillstream.sources.sinks import write_text

METRICS_JSON, REPORT_TEXT = "aggregation_metrics.json", "aggregation_report.txt"


#: Columns that say what a row of a metric is about; the others are measures.
ITEMS = ["event_type", "source", "device", "journey_pattern", "date", "hour", "day_of_week"]


def metric_rows(events: DataFrame, sessions: DataFrame, names: list[str] | None = None, shared: Shared | None = None) -> DataFrame:
    """All metrics in one long frame: metric name and one JSON object per result row."""
    parts = [
        frame.select(F.lit(name).alias("metric"), F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("value"))
        for name, frame in run_metrics(events, sessions, names, shared).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def metric_values(events: DataFrame, sessions: DataFrame, names: list[str] | None = None, shared: Shared | None = None) -> DataFrame:
    """All metrics as numbers: metric, item (null for a metric of one row), measure, value."""
    parts = []
    for name, frame in run_metrics(events, sessions, names, shared).items():
        item = next((F.col(c).cast("string") for c in frame.columns if c in ITEMS), F.lit(None).cast("string"))
        measures = [c for c in frame.columns if c not in ITEMS]
        typed = frame.select(item.alias("item"), *[F.col(c).cast("double") for c in measures])
        parts.append(typed.unpivot(["item"], measures, "measure", "value").select(F.lit(name).alias("metric"), "item", "measure", "value"))
    return reduce(DataFrame.unionByName, parts)


def collect_metrics(events: DataFrame, sessions: DataFrame, shared: Shared | None = None) -> dict[str, list[dict]]:
    """Metric name -> result rows. Every metric is small: one row, a top list, or one
    row per date, hour, weekday, event type, source or device."""
    rows = metric_rows(events, sessions, shared=shared or Shared(events))
    found: dict[str, list[dict]] = {name: [] for name in METRICS}
    for row in rows.toLocalIterator():
        found[row.metric].append(json.loads(row.value))
    return found


def _cell(value) -> str:
    if isinstance(value, float):
        return f"{value:,.2f}"
    return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def report_lines(collected: dict[str, list[dict]], rows: int = 10) -> list[str]:
    """Every metric as a small table: its name, its columns, its first ``rows`` rows by falling count."""
    lines = []
    for name, found in collected.items():
        lines += [f"# {name.replace('_', ' ')}", ""]
        if len(found) == 1:
            lines += [f"{column.replace('_', ' ')}: {_cell(value)}" for column, value in found[0].items()]
        elif found:
            counts = [c for c, v in found[0].items() if isinstance(v, int)]
            ordered = sorted(found, key=lambda r: tuple(-(r[c] or 0) for c in counts[:1]) + (str(r),))
            lines.append(" | ".join(found[0]))
            lines += [" | ".join(map(_cell, r.values())) for r in ordered[:rows]]
            if len(found) > rows:
                lines.append(f"({len(found) - rows} more rows in {METRICS_JSON})")
        lines.append("")
    return lines


def run_aggregation(spark: SparkSession, out_dir: str) -> dict[str, list[dict]]:
    """Metrics of a finished transformation, written as JSON and text beside it."""
    sessions = read_table(spark, f"{out_dir}/{pipeline.SESSIONS}")
    events = read_table(spark, f"{out_dir}/{pipeline.EVENTS}")
    pieces = read_table(spark, f"{out_dir}/{pipeline.PIECES}")
    collected = collect_metrics(events, sessions, Shared(events, pieces))
    as_lines = lambda lines: spark.createDataFrame([(line,) for line in lines], "value string")
    write_text(as_lines([json.dumps(collected, ensure_ascii=False)]), f"{out_dir}/{METRICS_JSON}")
    write_text(as_lines(report_lines(collected)), f"{out_dir}/{REPORT_TEXT}")
    return collected


def read_metrics(spark: SparkSession, out_dir: str) -> DataFrame:
    """The written JSON as numbers, in the form of :func:`metric_values`."""
    whole = spark.read.text(f"{out_dir}/{METRICS_JSON}").select(F.from_json("value", "map<string, array<map<string, string>>>").alias("m"))
    rows = whole.select(F.explode("m").alias("metric", "rows")).select("metric", F.explode("rows").alias("row"))
    item = F.coalesce(*[F.col("row")[c] for c in ITEMS])
    cells = rows.select("metric", item.alias("item"), F.explode("row").alias("measure", "value"))
    return cells.where(~F.col("measure").isin(ITEMS)).withColumn("value", F.col("value").cast("double"))
