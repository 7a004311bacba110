"""Contiguous shards of near equal size, in SQL functions only.

Documents stand in one global order: by text checksum, text hash and id, so that equal texts are
neighbours. Ranges of that order add up their own bytes; the totals of the ranges give every
document its byte position in the whole, and the whole is cut at equal byte targets. A document
belongs to the shard its middle byte falls in, so a shard misses its target by at most its two end
documents.

Null texts count as empty. Rows that repeat id and text take neighbouring places. A missing id
stands last among equal texts. An empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.llm.frames import id_back, id_column, prefix_sums
from tillstream.session import materialise

KEY = ("id", "size", "text_crc32", "text_hash")


def _key(id_col: str, text_col: str, row_bytes: int) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        id_column(id_col),
        (F.octet_length(text).cast("bigint") + row_bytes).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    ]


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16) -> DataFrame:
    """Rows that share id and text as one row: the key, rows, and bytes and rows before it, with the total."""
    units = docs.select(*_key(id_col, text_col, row_bytes)).groupBy(*KEY).agg(F.count("*").alias("rows"))
    placed = prefix_sums(
        units,
        [],
        ["text_crc32", "text_hash", "id", "size"],
        {"bytes": F.col("size") * F.col("rows"), "rank": F.col("rows")},
    )
    return materialise(placed, "placements")


def _shard(shards: int) -> Column:
    """Shard of the nth row (from 0) of a unit: middle byte times shards over all bytes, in whole numbers."""
    return F.expr(f"(2 * (bytes_before + nth * size) + size) * {int(shards)} div (2 * bytes_all)")


def _with_slots(rows: DataFrame, placed: DataFrame, shards: int) -> DataFrame:
    """Adds shard and slot to rows with the columns of ``placed`` and ``nth``."""
    each = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    starts = (
        each.select(_shard(shards).alias("_of"), (F.col("rank_before") + F.col("nth")).alias("_rank"))
        .groupBy("_of")
        .agg(F.min("_rank").alias("_start"))
    )
    found = rows.withColumn("shard", _shard(shards).cast("int"))
    joined = found.join(F.broadcast(starts), found["shard"] == starts["_of"])  # a row for each shard
    return joined.withColumn("slot", F.col("rank_before") + F.col("nth") - F.col("_start")).drop("_of", "_start")


def shard_report(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = placements(docs, **options)
    each = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    return _with_slots(each, placed, shards).select(
        id_back("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16) -> DataFrame:
    """The rows of ``docs`` with their shard (from 0) and slot (place within it, from 0)."""
    placed = placements(docs, id_col, text_col, row_bytes)
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_key(id_col, text_col, row_bytes))
    # Rows that repeat id and text are numbered; any order will do, since they have the same key.
    numbered = numbered.withColumn("nth", (F.row_number().over(W.partitionBy(*KEY).orderBy(F.lit(0))) - 1).cast("bigint"))
    plan = placed.select(*[F.col(k).alias(f"_{k}") for k in KEY], "bytes_before", "bytes_all", "rank_before")
    condition = F.lit(True)
    for k in KEY:
        condition = condition & (numbered[k] == plan[f"_{k}"])
    rows = numbered.join(plan, condition)
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return _with_slots(rows, placed, shards).select(*kept, "shard", "slot")
