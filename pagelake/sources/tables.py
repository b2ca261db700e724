"""Reading and writing the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.schemas import RESPONSES, TABLES

FIXTURE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def read_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for costly per-row work on a table of few file splits.

    A table that already has a split per core is returned as it is, so nothing
    is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the text tables, spread over the cores by its id."""
    key = {"pages": "page_id", "documents": "doc_id"}[name]
    return spread(read_fixture(spark, sf_dir, name), key)


def scan_table(
    spark: SparkSession, name: str, path: str | None = None, jdbc: dict[str, str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A relational table from files, or over JDBC (give partitionColumn, lowerBound, upperBound and
    numPartitions to read in parallel). File columns are those of the declared schema."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


def scan_responses(spark: SparkSession, path: str, streaming: bool = False, max_files: int = 1000) -> DataFrame:
    """Stored crawl responses; as a stream, new files in batches of at most ``max_files``."""
    if streaming:
        return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", max_files).parquet(path)
    return spark.read.schema(RESPONSES).parquet(path)


def scan_body_files(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Responses from a folder of raw page files: file path as url, status 200."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("url"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"),
        F.col("length").alias("declared_length"),
        F.col("content").alias("body"),
        F.col("modificationTime").alias("fetched_at"),
    )
