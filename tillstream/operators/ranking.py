"""Ordering helpers that stay parallel when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.operators.ranges import numbered_in_order


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``.

    ``row_number() = 1`` is planned as a group limit on both sides of the
    exchange, so each map task sends at most one row per key: a key repeated in a
    third of the table reaches the reducer as one row per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def numbered_in_segments(
    df: DataFrame, keys: list[str], segment: Column, order: list, out: str
) -> DataFrame:
    """Dense 1-based number of each row within ``keys``, in ``segment`` then ``order``.

    A key's rows are ranked inside short segments; the segments' row counts, one
    small row each, give the offset to add. A segment with very many rows is dealt
    into ranges, so no task ever sorts a whole key.
    """
    split = [*keys, "_segment"]
    rows = df.withColumn("_segment", segment)
    local = numbered_in_order(rows, split, order, "_local")
    before = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(offsets, split)
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_segment", "_local", "_offset")
    )


def top_k(df: DataFrame, metric: str, k: int, ties: list) -> DataFrame:
    """The ``k`` rows with the largest ``metric``; ``ties`` completes the order."""
    return df.orderBy(F.desc(metric), *ties).limit(k)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order (a top-n per task, merged; no full sort)."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def total(df: DataFrame) -> DataFrame:
    """Size of the filtered table a page was cut from."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def exact_median(df: DataFrame, column: str, width: float) -> DataFrame:
    """Interpolated median as a one-row frame, without gathering the values.

    Counts per ``width``-wide bucket locate the bucket(s) with the middle rank(s);
    only the value counts of those are ordered.
    """
    values = df.select(F.col(column).alias("_v")).filter("_v is not null")
    bucketed = values.withColumn("_b", F.floor(F.col("_v") / F.lit(width)))
    running = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    buckets = (
        bucketed.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_b",
            (F.sum("_n").over(running) - F.col("_n")).alias("_below"),
            F.sum("_n").over(running).alias("_upto"),
            F.sum("_n").over(everything).alias("_all"),
        )
        .withColumn("_lo", F.expr("(_all - 1) div 2"))
        .withColumn("_hi", F.expr("_all div 2"))
        .filter("(_lo >= _below and _lo < _upto) or (_hi >= _below and _hi < _upto)")
    )
    # at most two buckets hold the middle ranks
    middle = bucketed.join(F.broadcast(buckets), "_b")
    within = W.partitionBy("_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        middle.groupBy("_b", "_v", "_below", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.col("_below") + F.sum("_n").over(within))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )
    at = lambda rank: F.max(F.when((F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_upto")), F.col("_v")))
    return ranked.agg(((at("_lo") + at("_hi")) / 2).alias(column))


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with distinct columns side by side."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])
