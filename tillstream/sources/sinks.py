"""Writers. Reruns replace what they write; appends are separate and explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: str = "date", mode: str = "overwrite", only_present: bool = False) -> None:
    """Snappy parquet with one folder per ``by`` value.

    An overwrite replaces the whole table; with ``only_present`` it replaces the values of
    ``by`` that ``df`` has, and leaves the others.

    The rebalance hint gathers a value's rows into few files, and adaptive execution
    splits the values too large for one task, such as a date with a third of all rows.
    """
    (
        df.hint("rebalance", by)
        .write.mode(mode)
        .partitionBy(by)
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "dynamic" if only_present else "static")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_guarded(df: DataFrame, path: str, method: str | None = None) -> None:
    """Refuse to touch an existing table unless ``method='new'`` asks to append."""
    df.write.mode("append" if method == "new" else "errorifexists").parquet(path)


def append_sorted(df: DataFrame, path: str, order: list) -> None:
    """Append a batch laid out by ``order``: readers get tight min/max statistics per
    file, and ask for a total order with ``orderBy`` when they need one."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Maps, structs and arrays as JSON text."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; map columns become JSON text."""
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def write_text(df: DataFrame, path: str) -> None:
    """A one-column frame of lines, in order, as one file (reports only)."""
    df.coalesce(1).write.mode("overwrite").text(path)
