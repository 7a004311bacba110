"""Ids that earlier micro-batches stored, in buckets by hash, each bucket behind a Bloom filter.

A batch asks which of its ids may be stored. The filters answer without reading ids, and only the
buckets that they name are read. Filters have a fixed number of bits, kept as words of 64; once half
of the bits are set, the next batch builds them anew with four times as many. So a batch whose ids
are new reads the filters and little else, however many batches came before.

Below the store's folder, ``ids/bucket=<b>/batch_id=<n>`` has a batch's ids and ``filters/batch_id=<n>``
the filters after it. A replayed batch asks and writes as of the batch before it.

Filters and stored ids are joined by exchange, never broadcast: as parquet they are many times smaller than
as rows, so Spark's estimate from the files would send millions of rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.session import materialise
from tillstream.sources.readers import batch_numbers

BUCKETS = 64
BITS = 1 << 24
HASHES = 4
_IDS = "id string, bucket int, batch_id bigint"


class IdStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, bits: int = BITS):
        self.spark, self.folder, self.buckets, self.bits = spark, folder, buckets, bits

    def bucket(self, name: str) -> Column:
        return F.expr(f"cast(pmod(xxhash64(`{name}`), {self.buckets}) as int)")

    def _marks(self, ids: DataFrame, bits: int) -> DataFrame:
        """id, word, bit of every id's bits; an id's words all belong to its bucket."""
        words = max(1, bits // 64 // self.buckets)
        places = [f"pmod(xxhash64({seed}, id), {words * 64}L)" for seed in range(1, HASHES + 1)]
        marked = ids.select("id", "bucket", F.explode(F.expr(f"array({', '.join(places)})")).alias("place"))
        word = F.expr(f"bucket * {words}L + place div 64")
        return marked.select("id", word.alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))

    def _filters(self, batch_id: int) -> tuple[DataFrame, int] | None:
        """The filters after the last batch before ``batch_id``, and their number of bits."""
        earlier = [n for n in batch_numbers(self.spark, f"{self.folder}/filters") if n < batch_id]
        if not earlier:
            return None
        path = f"{self.folder}/filters/batch_id={earlier[-1]}"
        table = self.spark.read.schema("word bigint, bits bigint, size bigint").parquet(path)
        one = table.first()
        return (table.select("word", "bits"), one["size"]) if one else None

    def stored(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """Ids of the batches before ``batch_id``, all or of some buckets: a filter on folders."""
        table = self.spark.read.schema(_IDS).parquet(f"{self.folder}/ids").where(F.col("batch_id") < batch_id)
        return table if buckets is None else table.where(F.col("bucket").isin(buckets))

    def likely(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """id, bucket of the ids that the filters may have seen: all that are stored, and few others."""
        found = self._filters(batch_id)
        rows = ids.select("id", self.bucket("id").alias("bucket"))
        if found is None:
            return rows.limit(0)
        filters, bits = found
        marks = self._marks(rows, bits)
        hits = marks.join(filters.hint("merge"), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        hits = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES)
        return hits.select("id", self.bucket("id").alias("bucket"))

    def seen(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """Those of ``ids`` (distinct, a column ``id``) that batches before ``batch_id`` stored."""
        likely = materialise(self.likely(ids, batch_id), "likely-ids")
        named = [r["bucket"] for r in likely.select("bucket").distinct().collect()]  # as many as buckets
        if not named:
            return likely.select("id")
        stored = self.stored(batch_id, named).select("id", "bucket").hint("merge")
        return likely.join(stored, ["id", "bucket"], "left_semi").select("id")

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """Store the batch's ids, then the filters that know them."""
        path = f"{self.folder}/ids"
        rows = ids.select("id", self.bucket("id").alias("bucket"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        rows = rows.repartition("bucket")  # a file for each bucket
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(path)
        before = self._filters(batch_id)
        fresh = self.stored(batch_id + 1).where(F.col("batch_id") == batch_id)
        bits = before[1] if before else self.bits
        words = self._marks(fresh, bits).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        if before:
            words = words.unionByName(before[0]).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        words = materialise(words, "filters")
        if (words.agg(F.sum(F.bit_count("bits"))).first()[0] or 0) * 2 > bits:
            bits *= 4
            words = self._marks(self.stored(batch_id + 1), bits).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        words.withColumn("size", F.lit(bits).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/filters/batch_id={batch_id}")
