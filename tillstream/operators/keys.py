"""Surrogate ids for appended rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.operators.ranking import numbered_in_segments


def max_ids(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Highest id and row count per named table."""
    parts = [
        df.agg(
            F.lit(name).alias("entity"),
            F.max(key).cast("bigint").alias("max_id"),
            F.count(F.lit(1)).alias("row_count"),
        )
        for name, (df, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def append_surrogate_ids(
    existing: DataFrame, new: DataFrame, key: str = "id", order: str = "ingest_ord", block: int = 1_000_000
) -> DataFrame:
    """``new`` with dense ids continuing after the highest existing one, in ``order``.

    ``order`` is a whole number, or the position (file, block, row) that the file readers
    give. Rows are numbered per block of it, so no task orders the whole batch.
    """
    position = F.col(order)
    placed = new.schema[order].dataType.typeName() == "struct"
    segment = F.struct(position["file"], position["block"]) if placed else F.floor(position / block)
    start = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("_start"))
    numbered = numbered_in_segments(
        new.drop(key).withColumn("_one", F.lit(1)), ["_one"], segment, [order], "_nth"
    )
    # one row on the right
    return (
        numbered.join(F.broadcast(start.withColumn("_one", F.lit(1))), "_one")
        .withColumn(key, F.col("_start") + F.col("_nth"))
        .drop("_one", "_start", "_nth")
    )
