"""Readers for the raw entity files and the pipeline's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream import schemas

# Rows per numbered file of the batched tables.
CUSTOMER_BATCH = 10_000
ORDER_BATCH = 50_000


def count_files(spark: SparkSession, path: str) -> int:
    """How many files or folders a path (or glob) names, on any file system."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.globStatus(hadoop_path) or [])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) names at least one file or folder, on any file system."""
    return count_files(spark, path) > 0


def batch_numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the ``batch_id=<n>`` folders below ``folder``: a listing, no rows are read."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch_id=*")
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path) or []
    return sorted(int(status.getPath().getName().split("=")[1]) for status in found)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists: a new location before the older ones."""
    return next((p for p in paths if path_exists(spark, p)), None)


def _file_order(row: Column | None = None) -> Column:
    """A sortable position: file, block of the file, row within the task.

    Comparable across tasks, unlike the bare increasing id, whose high bits follow
    the order in which files were packed into tasks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )


def _with_order(df: DataFrame) -> DataFrame:
    return df.select("*", _file_order().alias("ingest_ord"))


def empty(spark: SparkSession, entity: str) -> DataFrame:
    position = F.lit(None).cast("struct<file:string,block:bigint,row:bigint>")
    return spark.createDataFrame([], schemas.schema(entity)).withColumn("ingest_ord", position)


def read_json_arrays(spark: SparkSession, entity: str, *paths: str) -> DataFrame:
    """Files holding one JSON array each (plain or gzip); none at all gives no rows.

    Such a file is one task: write it as parquet once, then work on that.
    """
    path = first_existing(spark, *paths)
    if path is None:
        return empty(spark, entity)
    reader = spark.read.schema(schemas.schema(entity)).option("multiLine", True).option("mode", "PERMISSIVE")
    return _with_order(reader.json(path))


def read_json_lines(spark: SparkSession, entity: str, *paths: str) -> DataFrame:
    """One JSON object per line: splittable when not gzipped."""
    path = first_existing(spark, *paths)
    if path is None:
        return empty(spark, entity)
    return _with_order(spark.read.schema(schemas.schema(entity)).json(path))


def read_batched(spark: SparkSession, entity: str, folder: str, batch: int | None = None) -> DataFrame:
    """All numbered batch files of a table; ``batch`` reads just that file.

    The batch number is a column, so a filter on it still tells the rows apart.
    """
    files = f"{folder}/*_batch_{'*' if batch is None else batch}.json*"
    df = read_json_arrays(spark, entity, files)
    return df.withColumn("batch", F.regexp_extract("ingest_ord.file", r"_batch_(\d+)\.json", 1).try_cast("bigint"))


def convert_batched(spark: SparkSession, entity: str, folder: str, out: str) -> None:
    """Numbered array files as one parquet table with a folder for each batch.

    An array file is one task and read whole; after this, a filter on ``batch`` opens that folder only.
    """
    read_batched(spark, entity, folder).write.mode("overwrite").partitionBy("batch").parquet(out)


def read_converted(spark: SparkSession, out: str, batch: int | None = None) -> DataFrame:
    """The converted table, or one batch of it: then the other batches' folders aren't even listed."""
    if batch is None:
        return spark.read.parquet(out)
    folder = f"{out}/batch={batch}"
    found = path_exists(spark, folder)
    table = spark.read.option("basePath", out).parquet(folder) if found else spark.read.parquet(out)
    return table.where(F.col("batch") == batch)


def batch_of_customer(customer_id: int) -> int:
    return (customer_id - 1) // CUSTOMER_BATCH


def batch_of_page(page_no: int, limit: int) -> int:
    return ((page_no - 1) * limit) // ORDER_BATCH


def customer_by_id(spark: SparkSession, folder: str, customer_id: int) -> DataFrame:
    """Reads only the batch file the id falls in."""
    return read_batched(spark, "customers", folder, batch_of_customer(customer_id)).filter(
        F.col("id") == customer_id
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table or partitioned dataset; a missing path is an error."""
    return spark.read.parquet(path)


def stream_json_lines(spark: SparkSession, entity: str, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The files of a folder as a stream, a bounded number of files at a time.

    Streams can't number rows: ``ingest_ord`` has no row until :func:`with_rows` fills it in.
    """
    reader = spark.readStream.schema(schemas.schema(entity)).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).select("*", _file_order(F.lit(None).cast("bigint")).alias("ingest_ord"))


def with_rows(batch: DataFrame) -> DataFrame:
    """A micro-batch with the rows of its positions; other kinds of ``ingest_ord`` stay as they are."""
    if batch.schema["ingest_ord"].dataType.typeName() != "struct":
        return batch
    return batch.withColumn("ingest_ord", F.col("ingest_ord").withField("row", F.monotonically_increasing_id()))


def stream_parquet(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, typed like the files already there."""
    like = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (
        spark.readStream.schema(like)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
