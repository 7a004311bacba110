"""Mixing sources to target weights by systematic sampling, in SQL functions only.

The sources' weights give each a share of the words to take. No source is taken more than
``most`` times; what that leaves over goes to the others by weight. Within a source, documents
stand in order of size, every one expects target / size-of-source copies, and a document is
emitted once for each whole number that the running sum of expected copies, plus one random
offset, passes. Because neighbours in that order have like sizes, a source's words miss its target
by at most about its longest document.

Missing sources form a source of their own, last in order. Null and empty texts have size 0 and
are dealt like others. A source without words has target 0. Rows that repeat id, source and size
stand side by side, each for itself. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.llm.frames import WORD, id_back, id_column, prefix_sums
from tillstream.session import materialise


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(units: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """One row per source: source_size, target. ``share`` is a fraction (150 %: 3, 2) of all words."""
    part, whole = share
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")).alias("weight"),
    )
    # Sources are capped in order of size by weight, as long as the rest's even share is above the cap.
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    budget = part * F.sum("source_size").over(W.partitionBy())
    poured = weighed.select(
        "*",
        (budget - whole * F.coalesce(F.sum(most * F.col("source_size")).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("left"),
        F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)).alias("sharing"),
    ).withColumn("capped", F.col("left") * F.col("weight") > whole * most * F.col("source_size") * F.col("sharing"))
    open_ = F.when(~F.col("capped"), F.struct("left", "sharing"))
    return poured.select(
        "source",
        "source_size",
        F.max(open_).over(W.partitionBy()).alias("rest"),
        "weight",
        "capped",
    ).select(
        F.col("source").alias("of"),
        "source_size",
        F.when(F.col("capped"), (most * F.col("source_size")).cast("double"))
        .otherwise((F.col("weight") * F.col("rest.left")).cast("double") / (whole * F.col("rest.sharing")).cast("double"))
        .alias("target"),
    )


def mix_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: str = "mix",
    marks: Sequence[Column] = (),
) -> DataFrame:
    """What the mix takes: id, source, size, ``marks``, rows (that share these), source_size, target, and
    what decides their copies: the rows before them, the copies each row expects, the source's offset."""
    slim = docs.select(id_column(id_col), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), *marks)
    units = slim.groupBy(*slim.columns).agg(F.count("*").alias("rows"))
    ranked = prefix_sums(units, ["source"], ["size", "id", *slim.columns[3:]], {"rank": F.col("rows")})
    targets = source_targets(ranked, weights, share, most)
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name)), 1, 4), 16, 10).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        ranked.join(targets, ranked["source"].eqNullSafe(targets["of"]))
        .withColumns({"offset": (digits + 0.5) / 65536, "rate": rate})
        .select(*slim.columns, "rows", "source_size", "target", "rank_before", "rate", "offset")
    )


def _copies(rows: Column | int) -> Column:
    """Whole numbers passed by the running sum over the next ``rows`` rows."""
    passed = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    return passed(F.col("rank_before") + rows) - passed(F.col("rank_before"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: the rows of ``docs``, each as often as the mix takes it."""
    content = [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]) for seed in (1, 2)]
    marks = [c.alias(f"_mark{i}") for i, c in enumerate(content)]
    plan = mix_units(docs, id_col, text_col, source_col, marks=marks, **options).withColumn("copies", _copies(F.col("rows")))
    plan = plan.where("copies > 0").select(*[F.col(c).alias(f"_mix_{c}") for c in ("id", "_mark0", "_mark1", "rows", "copies")])
    plan = materialise(plan, "mix-plan")
    ours = F.coalesce(docs[id_col].cast("bigint"), F.lit(2**63 - 1))
    keyed = docs.withColumns({"_key_id": ours, "_key_mark0": content[0], "_key_mark1": content[1]})
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def taken(part: DataFrame) -> DataFrame:
        same = [keyed[f"_key_{a}"] == part[f"_mix_{b}"] for a, b in (("id", "id"), ("mark0", "_mark0"), ("mark1", "_mark1"))]
        return keyed.join(part, same).select(*columns, "_mix_copies")

    rows = taken(plan.where("_mix_rows = 1"))
    alike = plan.where("_mix_rows > 1")
    if not alike.isEmpty():  # of rows alike in all columns one is repeated as often as the mix takes them together
        rows = rows.unionByName(taken(alike).dropDuplicates())
    each = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mix_copies"))))
    return each.select(*columns)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    units = mix_units(docs, **options)
    rows = units.withColumn("_row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    rows = rows.withColumn("rank_before", F.col("rank_before") + F.col("_row"))
    return rows.select(id_back("doc_id"), "size", "source_size", "target", (_copies(1) * F.col("size")).alias("taken"))
