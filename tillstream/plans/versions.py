"""Outputs of the pipeline that change together.

A run, and an appended batch, write below a new folder; then one small pointer file is added that
names where each table is read from. Readers follow the newest pointer, so they see all tables of one
state, before or after, and a write that fails in between changes nothing. An append writes the dates
it touches; the pointer says which dates of the older folders no longer count.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.operators.metrics import daily_summary
from tillstream.plans.pipeline import EVENTS, PIECES, SESSIONS, SUMMARY, run_transformation, touched_by
from tillstream.session import materialise
from tillstream.sources.sinks import flat, write_csv, write_partitioned, write_table


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(context._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, out_dir: str) -> list[str]:
    pattern, files = _files(spark, f"{out_dir}/pointers/*.json")
    return sorted(s.getPath().toString() for s in files.globStatus(pattern) or [])


def pointer(spark: SparkSession, out_dir: str) -> dict:
    """The newest state: ``events`` (folders, and the dates of each that don't count) and ``tables``."""
    known = _pointers(spark, out_dir)
    if not known:
        raise FileNotFoundError(f"nothing is published in {out_dir}")
    return json.loads(spark.read.text(known[-1]).first()["value"])


def _publish(spark: SparkSession, out_dir: str, state: dict) -> None:
    """Add the next pointer; its file appears whole, or not at all."""
    draft, files = _files(spark, f"{out_dir}/drafts/{uuid.uuid4().hex}.json")
    out = files.create(draft, False)
    out.write((json.dumps(state) + "\n").encode())
    out.close()
    last = _pointers(spark, out_dir)
    number = int(last[-1].rsplit("/", 1)[1].split(".")[0]) + 1 if last else 0
    target, _ = _files(spark, f"{out_dir}/pointers/{number:09d}.json")
    files.mkdirs(target.getParent())
    if not files.rename(draft, target):
        raise RuntimeError(f"another write has published {target}")


def _new_folder(out_dir: str) -> str:
    return f"{out_dir}/versions/{uuid.uuid4().hex}"


def published_events(spark: SparkSession, out_dir: str) -> DataFrame:
    def part(entry):
        rows = spark.read.parquet(f"{entry['folder']}/{EVENTS}")
        gone = [F.lit(d).cast("date") for d in entry["without"] if d is not None]
        rows = rows.where(F.col("date").isNull() | ~F.col("date").isin(gone)) if gone else rows
        return rows.where("date is not null") if None in entry["without"] else rows

    return reduce(DataFrame.unionByName, map(part, pointer(spark, out_dir)["events"]))


def published_table(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """Sessions, pieces, or the summary as text columns."""
    path = f"{pointer(spark, out_dir)['tables']}/{name}"
    return spark.read.option("header", True).csv(path) if name == SUMMARY else spark.read.parquet(path)


def publish_run(raw: DataFrame, out_dir: str) -> None:
    """A run over all events replaces what is published."""
    folder = _new_folder(out_dir)
    run_transformation(raw, folder)
    _publish(raw.sparkSession, out_dir, {"events": [{"folder": folder, "without": []}], "tables": folder})


def publish_append(spark: SparkSession, raw: DataFrame, out_dir: str) -> None:
    """Like ``append_events``, as one change; the summary is computed for the touched dates only."""
    state, folder = pointer(spark, out_dir), _new_folder(out_dir)
    touched, pieces, table, rows = touched_by(raw, published_events(spark, out_dir))
    dates = [r["date"] and str(r["date"]) for r in rows.select("date").distinct().collect()]  # as many as days
    if not dates:
        return  # nothing new
    write_partitioned(rows, f"{folder}/{EVENTS}")
    for name, new in ((SESSIONS, table), (PIECES, pieces)):
        kept = published_table(spark, out_dir, name).join(touched, "session_id", "left_anti")
        write_table(kept.unionByName(new), f"{folder}/{name}")
    summary = published_table(spark, out_dir, SUMMARY)
    fresh = flat(daily_summary(rows))
    kept = summary.where(F.coalesce(~F.col("date").isin([d for d in dates if d]), F.lit(None not in dates)))
    texts = fresh.select(*[F.col(c).cast("string").alias(c) for c in fresh.columns])
    write_csv(materialise(kept.select(*texts.columns).unionByName(texts), "summary"), f"{folder}/{SUMMARY}")
    events = [{"folder": e["folder"], "without": list({*e["without"], *dates})} for e in state["events"]]
    _publish(spark, out_dir, {"events": [*events, {"folder": folder, "without": []}], "tables": folder})
