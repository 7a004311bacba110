"""Choice of rows to learn from, and the one task that fits a model."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.session import materialise


def held_out(id_col: str) -> Column:
    """Rows kept back from learning: a quarter, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


_KEY = ("id", "mark1", "mark2", "label")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with two hashes of their text: with the id they tell rows apart."""
    return rows.withColumns({"mark1": F.xxhash64(F.lit(1), "text"), "mark2": F.xxhash64(F.lit(2), "text")})


def sample_rows(keys: DataFrame, rows: DataFrame, per_label: int) -> DataFrame:
    """label, order, text of at most ``per_label`` different rows of each label, those with the smallest hashes.

    ``keys`` has id, mark1, mark2 and label of all rows to choose from, ``rows`` id, text and the
    marks. The limit within a label is applied before the exchange too, so a label that nearly all
    rows have costs ``per_label`` rows of each task. Texts are fetched for the chosen rows alone; rows
    that repeat id and text are one row, so a repeated id brings no others along.
    """
    nth = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("id", "mark1"), *_KEY[:3]))
    chosen = keys.select(*_KEY).distinct().withColumn("nth", nth).where(F.col("nth") <= per_label)
    chosen = materialise(chosen.select(*[F.col(k).alias(f"_{k}") for k in _KEY]), "sample")
    same = [F.col(k) == F.col(f"_{k}") if k == "id" else F.col(k).eqNullSafe(F.col(f"_{k}")) for k in _KEY[:3]]
    picked = rows.join(F.broadcast(chosen), same).dropDuplicates([f"_{k}" for k in _KEY])  # per_label rows of a label
    return picked.select(F.col("_label").alias("label"), F.xxhash64("_id", "_mark1", "_label").alias("order"), "text")


def fit_in_one_task(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes | None:
    """Fit a model on a bounded sample in one task; only the model comes to the driver."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([fit(table)], pa.binary())})

    found = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "model binary").first()
    return found["model"] if found else None
