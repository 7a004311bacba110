"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillstream.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    quality,
    sharding,
    source_audit,
    substring_dedup,
    toxicity,
    whitening,
)
from tillstream.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def table(name):
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")

        apply_settings(spark)
        return fn(table)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_mix_sources(table):
    return mixing.mix_report(table("documents"))


@query
def op3_line_dedup(table):
    return line_dedup.line_report(table("documents"))


@query
def op4_shard_bytes(table):
    return sharding.shard_report(table("documents"), 40)


@query
def op7_decontaminate(table):
    return decontaminate.contamination_report(table("documents"), table("benchmark"))


@query
def op8_exact_dedup(table):
    return exact_dedup.dedup_report(table("documents"), keep="largest")


@query
def op9_substring_dedup(table):
    return substring_dedup.repeats_report(table("documents"))


@query
def op2_ngram_jaccard(table):
    return jaccard_join.join_report(table("documents"), words=3, similarity="0.9")


@query
def op5_language_id(table):
    return language_id.language_report(table("documents"))


@query
def op10_quality(table):
    return quality.quality_report(table("documents"), table("labels"))


@query
def op6_chat_trees(table):
    return chat_format.chat_report(table("conversations"))


@query
def op11_toxicity(table):
    return toxicity.toxicity_report(table("documents"), table("labels"))


@query
def op12_source_audit(table):
    return source_audit.audit_report(table("documents"))


@query
def op13_whitening(table):
    return whitening.whitening_report(table("embeddings"))
