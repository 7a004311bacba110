"""Exact duplicates by 128-bit content hash, with a comparison of the bytes.

Texts are grouped by fingerprint on narrow rows (id and hash). Only members of groups of two or
more are compared: each with the text of its group's chosen row. A text that differs there, a
collision, is grouped by the text itself, so the result is exact with any fingerprint.

Null texts count as empty. A missing id counts as later than all others. Rows that repeat id and
text are the same document: they share one decision, and ``deduplicate`` keeps one of them. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm.frames import id_back, id_column
from tillstream.session import materialise


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    fingerprint: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, text_sha256. ``keep``: smallest or largest id of a group."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialise(docs.select(id_column(id_col), fingerprint(text).alias("fp"), F.sha2(text, 256).alias("text_sha256")), "fingerprints")
    groups = materialise(slim.groupBy("fp").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    # Both sides of the joins are plain tables: adaptive execution can split a hot fingerprint.
    alone = slim.join(groups.where("group_size = 1"), "fp").select("id", "keep_id", "group_size", "text_sha256")

    shared = groups.where("group_size > 1").select(F.col("fp").alias("_fp"), "keep_id")
    texts = docs.select(id_column(id_col), fingerprint(text).alias("fp"), F.sha2(text, 256).alias("text_sha256"), text.alias("text"))
    members = materialise(texts.join(shared, F.col("fp") == F.col("_fp")).drop("_fp"), "members")
    chosen = members.where("id = keep_id").groupBy("fp").agg(F.min("text").alias("chosen_text"))
    chosen = materialise(chosen.withColumnRenamed("fp", "_fp"), "chosen")
    compared = members.join(chosen, F.col("fp") == F.col("_fp")).select(
        "id", "fp", "text_sha256", F.when(F.col("text") != F.col("chosen_text"), F.col("text")).alias("other_text")
    )
    compared = materialise(compared, "compared")
    classes = materialise(
        compared.groupBy("fp", "other_text").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size")), "classes"
    )
    together = compared.alias("m").join(
        classes.alias("c"), (F.col("m.fp") == F.col("c.fp")) & F.col("m.other_text").eqNullSafe(F.col("c.other_text"))
    )
    return alone.unionByName(together.select("m.id", "c.keep_id", "c.group_size", "m.text_sha256"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too."""
    found = duplicate_groups(docs, id_col, text_col, keep)
    return found.select(
        id_back("doc_id"),
        F.nullif(F.col("keep_id"), F.lit(2**63 - 1)).alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts."""
    stay = duplicate_groups(docs, id_col, text_col, keep).where("id = keep_id")
    stay = stay.select(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        id_column(id_col),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha256"),
    )
    kept = rows.join(stay, (F.col("id") == F.col("_id")) & (F.col("_sha256") == F.col("_sha")))
    one = kept.groupBy("_id", "_sha").agg(F.first("_row").alias("_row"))
    return one.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
