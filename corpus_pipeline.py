"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Documents that the quality classifier rejects go; of each group of near duplicates (five-word
shingles, similarity 0.8 or more) the one with the smallest id stays; documents that hold four
fifths of a benchmark item's shingles go; sources are mixed to their target weights, which repeats
or leaves out documents; and what is left is cut into shards of near equal size.
"""

from pyspark.sql import DataFrame, SparkSession

from tillstream.llm import decontaminate, jaccard_join, mixing, quality, sharding
from tillstream.session import apply_settings, materialise

SHARDS = 40


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return jaccard_join.drop_near_duplicates(docs, words=5, similarity="0.8")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    apply_settings(spark)
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: Learnt scores can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
