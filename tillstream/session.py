"""SparkSession construction and access to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings the operators rely on. Sizes (partition counts, memory) belong to the cluster.
ENGINE_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs another exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # folders are listed by so many tasks at most; Spark's own setting starts one for nearly every folder
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}

# Settings fixed when a session starts. A pipeline's jobs need more than the default 100
# generated classes; past that they are compiled again, and start cold, in every job.
START_SETTINGS = {
    "spark.sql.codegen.cache.maxEntries": "2000",
    # recording the Python line of every column call costs more than planning a query
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # streams keep every id they have seen: on disk, not on the executors' heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "tillstream", master: str | None = None, **settings) -> SparkSession:
    """Session with the engine's settings; ``settings`` win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START_SETTINGS, **ENGINE_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the engine's settings on a session somebody else built."""
    for key, value in ENGINE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local path would be lost with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), f"tillstream-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never used path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def observed(observation: Observation, df: DataFrame, *counts: Column) -> dict:
    """What ``observation`` saw of ``df`` while it was written.

    Where the optimizer learns that a result is empty it leaves out the plan below, and what was to be
    observed there with it; then ``counts`` are taken from ``df`` plainly.
    """
    try:
        return observation.get
    except Py4JJavaError:
        return df.agg(*counts).first().asDict()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps the result columnar, so the
    jobs that follow read only the columns they use, and a lost executor costs
    the re-run of one task.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
