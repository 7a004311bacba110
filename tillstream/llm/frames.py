"""Small helpers shared by the operators: ids, counts of running rows, prefix sums in ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.session import materialise

#: Stands for a missing id inside the operators: such a row is later than every other.
NO_ID = 2**63 - 1
#: A word is a run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"


def id_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID)).alias("id")


def id_back(name: str) -> Column:
    return F.nullif(F.col("id"), F.lit(NO_ID)).alias(name)


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Join condition: all named columns equal, missing equal to missing."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def prefix_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """For every row the sums over all rows before it, in ``order`` within ``by``.

    Rows are dealt into ranges of (by, order), so a hot group is spread over many tasks. Each
    range adds up its own rows; the totals of the ranges, a few rows each, give the offsets.
    ``order`` must tell all rows of a group apart. Adds ``<name>_before`` and, where ``by`` is
    empty, ``<name>_all``.
    """
    keys = [*by, *order]
    ranged = rows.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*[F.col(k) for k in keys])
    # The ranges are used twice, so they must be the same both times: written once.
    placed = materialise(ranged.withColumn("_range", F.spark_partition_id()), "ranges")

    totals = placed.groupBy("_range", *by).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range").alias("_at"),
        *[F.col(b).alias(f"_by_{b}") for b in by],
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"{n}_offset") for n in sums],
        *([] if by else [F.sum(f"_{n}").over(W.partitionBy()).alias(f"{n}_all") for n in sums]),
    )
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    counted = placed.withColumns({f"{n}_inside": F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums})
    condition = counted["_range"] == offsets["_at"]
    for b in by:
        condition = condition & counted[b].eqNullSafe(offsets[f"_by_{b}"])
    return (
        counted.join(offsets, condition)
        .withColumns({f"{n}_before": F.col(f"{n}_inside") + F.col(f"{n}_offset") for n in sums})
        .drop("_range", "_at", *[f"_by_{b}" for b in by], *[f"{x}{n}{y}" for n in sums for x, y in (("_", ""), ("", "_inside"), ("", "_offset"))])
    )
