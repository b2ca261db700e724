"""Token-id files: documents' ids in the order of doc_id, coded in independent blocks.

Format: a folder of Parquet files, one row a frame, so that any storage that
Spark writes to can hold it. A frame has the documents of a stretch of ids:

    cell, frame   place in the order: by cell, then by frame
    doc_ids       the documents, in order
    lengths       ids of each document, its end id included
    n_ids         sum of the lengths
    blocks        struct of (content, n, checksum): at most 1024 ids each, coded by
                  ``range_coder`` without knowledge of other blocks; CRC-32 of
                  the ids as little-endian unsigned 16-bit integers

A block is the unit of damage: it can be read without any other one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagelake.llm.range_coder import read_blocks, write_blocks
from pagelake.llm.store import cell_bounds, cell_of, map_batches, partitions, tuned
from pagelake.llm.word_tokens import word_tokens

#: Ids after which a frame is closed; a longer document is a frame alone.
FRAME_IDS = 4_000_000
#: Frames have some MB, so a batch between the JVM and Python holds few.
_BLOCKS = pa.list_(pa.struct([("content", pa.binary()), ("n", pa.int32()), ("checksum", pa.int64())]))


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, cells: int) -> DataFrame:
    """(cell, doc_id, ids) with the end id; the cell is the document's range of doc_id."""
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary, False)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            ids, counts = tokens.encode(batch.column(2))
            if len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError("the vocabulary has ids beyond 65535")
            content, limits = ids.astype("<u2"), np.concatenate([[0], np.cumsum(counts)])
            rows = [content[a:b].tobytes() + end for a, b in zip(limits[:-1], limits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, type=pa.binary())], ["cell", "doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.select(cell_of(F.col("doc_id"), cell_bounds(docs, "doc_id", cells)).alias("cell"), "doc_id", "text")
    return map_batches(placed, run, f"cell int, doc_id {kind}, ids binary")


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Write the ids of all documents (doc_id, text), in the order of doc_id, as files of this format.

    NULL and empty texts are a document of the end id alone. NULL as doc_id comes
    first; rows that repeat a doc_id all stay, in the order of their ids' bytes.
    Other columns are not read. The ids move once, by ranges of doc_id.
    """
    cells = partitions(docs.sparkSession)
    rows = tokenized(docs, vocabulary, end_id, cells)
    ordered = rows.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "doc_id", "ids")
    schema = pa.schema([
        ("cell", pa.int32()), ("frame", pa.int32()), ("doc_ids", pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))),
        ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("blocks", _BLOCKS),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, frame, doc_ids, parts, size = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(p, dtype="<u2") for p in parts])
            blocks = [{"content": content, "n": n, "checksum": checksum} for content, n, checksum in write_blocks(ids)]
            row = {"cell": cell, "frame": frame, "doc_ids": doc_ids, "lengths": [len(p) // 2 for p in parts], "n_ids": len(ids), "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for row_cell, doc_id, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if parts and (row_cell != cell or size + len(ids) // 2 > FRAME_IDS):
                    yield close()
                    frame, doc_ids, parts, size = (frame + 1 if row_cell == cell else 0), [], [], 0
                cell = row_cell
                doc_ids.append(doc_id)
                parts.append(ids)
                size += len(ids) // 2
        if parts:
            yield close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    frames = map_batches(
        ordered, run,
        f"cell int, frame int, doc_ids array<{kind}>, lengths array<long>, n_ids long, blocks array<struct<content: binary, n: int, checksum: long>>",
    )
    frames.write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document of written files; ``start`` counts the ids before it.

    ``ids`` has little-endian unsigned 32-bit integers. A damaged block is an error.
    """
    frames = tuned(spark).read.parquet(path)
    by_cell = Window.partitionBy("cell").orderBy("frame")
    # one row a cell stands in one task
    cells = frames.groupBy("cell").agg(F.sum("n_ids").alias("n"))
    cells = cells.select(F.col("cell").alias("c"), (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("cell_start"))
    starts = frames.select("cell", "frame", (F.sum("n_ids").over(by_cell) - F.col("n_ids")).alias("within"))
    starts = starts.join(cells, F.col("cell") == F.col("c")).select("cell", "frame", (F.col("cell_start") + F.col("within")).alias("frame_start"))
    id_type = frames.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths = batch.column(2).slice(i, 1).flatten(), batch.column(3)[i].as_py()
                ids = read_blocks([(b["content"], b["n"], b["checksum"]) for b in batch.column(4)[i].as_py()]).astype("<u4")
                limits = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                parts = [ids[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
                n = len(parts)
                columns = [
                    pa.array([batch.column(0)[i].as_py()] * n, type=pa.int32()), pa.array([batch.column(1)[i].as_py()] * n, type=pa.int32()), doc_ids,
                    pa.array(limits[:-1]), pa.array(lengths, type=pa.int64()), pa.array([zlib.crc32(p) for p in parts], type=pa.int64()),
                    pa.array(parts if with_ids else [None] * n, type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "frame", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"])

    names = f"cell int, frame int, doc_id {id_type.simpleString()}, offset long, n_tokens long, ids_crc32 long, ids binary"
    found = map_batches(frames.select("cell", "frame", "doc_ids", "lengths", "blocks"), run, names)
    found = found.join(starts, ["cell", "frame"])
    columns = ["doc_id", (F.col("frame_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*columns, *["ids"][: int(with_ids)])
