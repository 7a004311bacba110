"""Row numbers inside keys of any size.

A key's rows are numbered by a window, one task to a key, as long as the key is of ordinary size. The
rows of larger keys are dealt into ranges of (key, order), which cut through a key wherever they must,
so every task holds about as many rows. The ranges are written once: which rows make a range is
decided by a sample, and must not change between the pass that counts and the pass that numbers. A
row's number is its place in its range, plus what the totals of the earlier ranges add.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.session import materialise

#: A key with more rows is dealt into ranges.
HOT_ROWS = 100_000
#: So many hot keys, or ranges, are broadcast; beyond that they are joined by exchange.
LISTED = 100_000
#: Keys are counted by so many buckets first: where no bucket is large, no key is.
BUCKETS = 1 << 16


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"_of_{n}"]) for n in names])


def _keyed(df: DataFrame, names: Sequence[str], *others: str) -> DataFrame:
    return df.select(*[F.col(n).alias(f"_of_{n}") for n in names], *others)


def in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` in ranges of ``order``, written: ``_range`` counts them, ``_place`` the rows inside each."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # the number of a partition and of a row within it, in one value
    numbered = dealt.withColumn("_at", F.monotonically_increasing_id())
    places = {"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}
    return materialise(numbered.withColumns(places).drop("_at"), "ranges")


def _numbered_by_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, small: bool) -> DataFrame:
    placed = in_ranges(rows, [*keys, *order])
    held = placed.groupBy("_range", *keys).agg(F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    add = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start") + 1).alias("_add")
    offsets = _keyed(held.select("_range", *keys, add), ["_range", *keys], "_add")
    joined = placed.join(F.broadcast(offsets) if small else offsets, _same(placed, offsets, ["_range", *keys]))
    return joined.withColumn(out, F.col("_place") + F.col("_add")).select(*rows.columns, out)


def numbered_in_order(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, hot_rows: int | None = None, listed: int | None = None
) -> DataFrame:
    """``rows`` with the dense 1-based number of each within ``keys``, in ``order``.

    ``order`` tells all rows of a key apart. The keys' sizes are counted at once, so ``rows`` should be a
    table, or cheap; keys that are missing are a key like others. They are counted by buckets of keys, and
    by key in the buckets with more than ``hot_rows`` rows only.
    """
    hot_rows, listed = HOT_ROWS if hot_rows is None else hot_rows, LISTED if listed is None else listed
    by_window = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    full = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    large = [r["_bucket"] for r in full.select("_bucket").collect()]  # BUCKETS numbers at most
    if not large:
        return rows.withColumn(out, by_window)
    within = rows if len(large) > BUCKETS // 2 else rows.where(bucket.isin(large))
    sizes = within.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    if sizes.isEmpty():
        return rows.withColumn(out, by_window)
    hot = materialise(_keyed(sizes, keys).withColumn("_hot", F.lit(True)), "hot-keys")
    if hot.count() > listed:
        return _numbered_by_ranges(rows, keys, order, out, small=False)
    marked = rows.join(F.broadcast(hot), _same(rows, hot, keys), "left")
    cold = marked.where("_hot is null").select(*rows.columns).withColumn(out, by_window)
    # as many offsets as hot keys and ranges
    return cold.unionByName(_numbered_by_ranges(marked.where("_hot").select(*rows.columns), keys, order, out, small=True))
