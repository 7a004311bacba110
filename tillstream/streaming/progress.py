"""Progress of streams, stored as it is reported."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = """query string, run string, batch_id bigint, at string, input_rows bigint, rows_per_second double,
    millis bigint, state_rows bigint, late_rows bigint, watermark string"""


class ProgressLog(StreamingQueryListener):
    """Writes a small file for every micro-batch below ``folder``; :func:`read_progress` reads them all.

    ``late_rows`` are what stateful operators dropped as later than the watermark. Without a batch to
    report (an idle trigger) nothing is written; a replayed batch replaces its file of the same run.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {
            "query": p.name or str(p.id),
            "run": str(p.runId),
            "batch_id": p.batchId,
            "at": p.timestamp,
            "input_rows": p.numInputRows,
            "rows_per_second": p.processedRowsPerSecond,
            "millis": p.durationMs.get("triggerExecution", 0),
            "state_rows": sum(o.numRowsTotal for o in p.stateOperators),
            "late_rows": sum(o.numRowsDroppedByWatermark for o in p.stateOperators),
            "watermark": p.eventTime.get("watermark"),
        }
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p.runId}-{p.batchId}.json")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write((json.dumps(row) + "\n").encode())
        finally:
            out.close()


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(folder)


def totals(progress: DataFrame) -> DataFrame:
    """Batches, input rows and late rows of each query, and the state rows after its last batch."""
    return progress.groupBy("query").agg(
        F.count_distinct("batch_id").alias("batches"),
        F.sum("input_rows").alias("input_rows"),
        F.sum("late_rows").alias("late_rows"),
        F.max_by("state_rows", F.struct("batch_id", "at")).alias("state_rows"),
    )
