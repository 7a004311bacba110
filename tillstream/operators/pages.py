"""Pages of a table kept in order: a page far in costs what the first one costs.

The rows lie in ranges of their order, a folder each, beside a table of the ranges' sizes and first
rows. A page is found by adding up sizes; only the ranges it touches are read. A cursor (the order
columns of the last row seen) starts at its own range, however many rows lie before it, and stays
right when rows are added before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (column, ascending) pairs; together they tell all rows apart, and none is missing.
Order = Sequence[tuple[str, bool]]


def _sorting(order: Order) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def write_pages(df: DataFrame, order: Order, path: str, ranges: int | None = None) -> None:
    """Lay ``df`` out in ranges of ``order``."""
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *_sorting(order))
    dealt.withColumn("_range", F.spark_partition_id()).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows").select("_range", *[c for c, _ in order])
    # the limit within a range is applied before the exchange: a row of each task and range is sent
    first = stored.withColumn("_nth", F.row_number().over(W.partitionBy("_range").orderBy(*_sorting(order)))).where("_nth = 1").drop("_nth")
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    first.join(sizes, "_range").write.mode("overwrite").parquet(f"{path}/sizes")


def _after(order: Order, cursor: dict) -> Column:
    """Rows later than the cursor: in the first column that differs, past it."""
    condition, same = F.lit(False), F.lit(True)
    for column, up in order:
        c, value = F.col(column), F.lit(cursor[column])
        condition = condition | (same & ((c > value) if up else (c < value)))
        same = same & (c == value)
    return condition


def read_page(spark: SparkSession, path: str, order: Order, limit: int, offset: int = 0, after: dict | None = None, where: Column | None = None) -> DataFrame:
    """``limit`` rows in order: from ``offset`` on, or those that follow the cursor ``after``.

    ``where`` filters rows before they are paged; with an offset, which counts stored rows, it can't
    be used. After a cursor the ranges from its own on are read, until the limit is reached.
    """
    if where is not None and offset:
        raise ValueError("a filtered page follows a cursor; an offset counts all rows")
    sizes = spark.read.parquet(f"{path}/sizes")
    rows = spark.read.parquet(f"{path}/rows")
    if after is None and where is None:
        chosen, before, first = [], 0, None
        for r in sizes.select("_range", "_n").orderBy("_range").collect():  # a number for each range
            if before < offset + limit and before + r["_n"] > offset:
                first = before if first is None else first
                chosen.append(r["_range"])
            before += r["_n"]
        page = rows.where(F.col("_range").isin(chosen)).orderBy(*_sorting(order))
        return page.offset(offset - (first or 0)).limit(limit).drop("_range")
    if after is not None:
        own = sizes.where(~_after(order, after)).agg(F.max("_range").alias("r")).first()["r"]
        rows = rows.where(_after(order, after))
        rows = rows if own is None else rows.where(F.col("_range") >= own)
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(*_sorting(order)).limit(limit).drop("_range")
