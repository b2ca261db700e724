"""Intermediate tables in the shared folder, and cells of an ordered key without a global sort in one task."""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.textbatch import BATCH_ROWS
from pagelake.session import ship_package, work_path

#: Error of the boundaries of cells, as a share of one cell's rows.
BOUNDARY_ERROR = 0.1


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as whole documents must fit beside their work arrays; and the package on the Python workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, with the path of the table."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and is computed once."""
    return stored_at(df, name)[0]


def stored_without_shuffles(df: DataFrame, name: str) -> DataFrame:
    """``stored``, and the job's shuffle files go when the table is written, not when the driver happens to collect garbage."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting, "false")
    conf.set(setting, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(setting, before)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose workers give back the memory of a partition's batches when it is done."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # freed arrays go back to the system, where its allocator can
        if trim:
            trim(0)

    return df.mapInArrow(whole, schema)


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle of the input's size, as the cluster is configured."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cell_bounds(df: DataFrame, key: str, cells: int) -> list:
    """Upper bounds (exclusive) of at most ``cells`` ranges of ``key`` with about equal numbers of rows.

    Reads only the key's column. At most ``cells - 1`` numbers come to the driver.
    """
    if cells < 2:
        return []
    found = df.select(F.col(key).alias("k")).filter("k is not null").agg(
        F.percentile_approx("k", [i / cells for i in range(1, cells)], int(cells / BOUNDARY_ERROR)).alias("b")
    ).first()["b"]
    return sorted(set(found or []))


def cell_of(column: Column, bounds: list) -> Column:
    """Cell of a value: the number of bounds that are at most the value; NULL is in cell 0.

    A binary search in one literal array, so that the expression stays small for any number of cells.
    """
    if not bounds:
        return F.lit(0)
    kind = "double" if any(isinstance(b, float) for b in bounds) else "bigint"
    limits = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")  # a constant: read once
    open_ = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(range_: Column, _: Column) -> Column:
        middle = F.shiftright(range_["low"] + range_["high"], 1)
        right = F.struct((middle + 1).alias("low"), range_["high"].alias("high"))
        left = F.struct(range_["low"].alias("low"), middle.alias("high"))
        return F.when(range_["low"] >= range_["high"], range_).when(F.get(limits, middle) <= column, right).otherwise(left)

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.when(column.isNull(), F.lit(0)).otherwise(F.aggregate(steps, open_, halve, lambda range_: range_["low"]))
