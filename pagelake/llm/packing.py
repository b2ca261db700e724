"""Packing along a space-filling curve.

A document's words are hashed into a signed vector, which fixed random directions
project to a few dimensions. Places on a Hilbert curve through that space keep
like documents near each other, so documents are dealt out by ranges of the
curve, sorted by it, and their ids fill sequences one after the other. What is
left at the end of a range becomes sequences whose lengths are powers of two,
so that no sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagelake.llm.store import cell_bounds, cell_of, map_batches, partitions, tuned
from pagelake.llm.textbatch import U64, slices, span_hashes
from pagelake.llm.word_tokens import word_tokens

SEQUENCE_IDS = 2048
#: Entries of the hashed vector, dimensions of the curve, and bits of each.
HASHED, DIMENSIONS, BITS = 64, 4, 10
SEED, DIRECTION = 20, 1024
#: Bits of the doc_id's checksum below the place on the curve.
SPREAD_BITS = 20
#: A sequence's number has its cell above these bits.
SEQUENCE_BITS = 40


def directions() -> np.ndarray:
    """Whole numbers, so that a projection is exact on any machine: a task that runs again deals its rows out alike."""
    return np.random.default_rng(SEED).integers(-DIRECTION, DIRECTION + 1, (HASHED, DIMENSIONS))


def places(part) -> np.ndarray:
    """Coordinates of BITS bits of each document of a slice; texts without words are in the middle.

    The signed sums of hashed words, projected and brought to unit length, are
    about normal with a deviation of 1 along each direction.
    """
    starts, ends, document = part.words()
    hashes = span_hashes(part.data, starts, ends)
    place = document * HASHED + (hashes & U64(HASHED - 1)).astype(np.int64)
    sign = ((hashes >> U64(20)) & U64(1)).astype(np.int64) * 2 - 1
    summed = np.bincount(place, weights=sign, minlength=len(part) * HASHED).astype(np.int64).reshape(len(part), HASHED)
    norm = np.sqrt((summed * summed).sum(axis=1))
    x = (summed @ directions()) / (np.where(norm > 0, norm, 1) * DIRECTION / np.sqrt(3.0))[:, None]
    return np.clip(((x / (1 + np.abs(x)) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert_keys(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates, all rows at once.

    From the highest bit down the axes are exchanged or turned so that the
    remaining bits are those of a curve in the standard position; the bits of
    the axes are then those of the place in Gray code.
    """
    axes = coordinates.T.copy()
    n = len(axes)
    for bit in range(bits - 1, 0, -1):
        high, rest = 1 << bit, (1 << bit) - 1
        for i in range(n):
            on = (axes[i] & high) != 0
            swap = (axes[0] ^ axes[i]) & rest
            axes[0] ^= np.where(on, rest, swap)
            axes[i] ^= np.where(on, 0, swap)
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turned = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where((axes[-1] >> bit) & 1, (1 << bit) - 1, 0)
    axes ^= turned
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (axes[i] >> bit) & 1
    return key


def batch_keys(doc_ids: pa.Array, texts: pa.Array) -> np.ndarray:
    """Place on the curve, and below it bits of the doc_id, so that a range can end among copies of one text."""
    found = [hilbert_keys(places(part)) for part in slices(texts)]
    curve = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    spread = np.array([zlib.crc32(str(i).encode()) >> (32 - SPREAD_BITS) for i in doc_ids.to_pylist()], dtype=np.int64)
    return curve << SPREAD_BITS | spread


def curve_keys(docs: DataFrame) -> DataFrame:
    """(key) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(batch_keys(batch.column(0), batch.column(1)))], ["key"])

    return map_batches(docs.select("doc_id", "text"), run, "key long")


def sequence_lengths(rest: int) -> list[int]:
    """Powers of two, largest first, that sum to ``rest``."""
    return [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def fill(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, sequence, offset) of the pieces of documents with these numbers of ids, in order.

    Sequences have SEQUENCE_IDS ids, the last ones the powers of two of what is left.
    """
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    full, rest = divmod(total, SEQUENCE_IDS)
    sizes = np.array([SEQUENCE_IDS] * full + sequence_lengths(rest), dtype=np.int64)
    limits = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.union1d(limits, np.concatenate([[0], ends]))
    begin, length = cuts[:-1], np.diff(cuts)
    row = np.searchsorted(ends, begin, side="right")
    sequence = np.searchsorted(limits, begin, side="right") - 1
    return row, begin - (ends - counts)[row], length, sequence, begin - limits[sequence]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): the pieces of all documents in sequences.

    ``docs`` has doc_id and text; other columns are not read. A document's ids
    are those of the vocabulary, which drops white space, and ``end_id``. NULL
    and empty texts are the end id alone. Every id lies in one piece; a sequence
    has its pieces without a gap from offset 0, and 2048 ids or a power of two.
    NULL ids and repeated rows stay. Equal keys are ordered by doc_id, then by
    ids, so the same table and partition settings give the same sequences. An
    empty table gives no rows.

    Texts are read twice, for the ranges of the curve and for the ids; the ids
    move once. Many copies of one text are dealt out over several ranges. Only quantiles of the keys come to the driver. A task holds the
    ids of a bounded number of sequences and of one document.
    """
    spark = tuned(docs.sparkSession)
    cells = partitions(spark)
    bounds = cell_bounds(curve_keys(docs), "key", cells)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(vocabulary, True)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            ids, counts = encoder.encode(batch.column(1))
            if len(ids) and int(ids.max()) > 0xFFFF:
                raise ValueError("the vocabulary has ids beyond 65535")
            content, limits = ids.astype("<u2"), np.concatenate([[0], np.cumsum(counts)])
            rows = [content[a:b].tobytes() + end for a, b in zip(limits[:-1], limits[1:], strict=True)]
            keys = pa.array(batch_keys(batch.column(0), batch.column(1)))
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), pa.array(rows, type=pa.binary())], ["key", "doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType
    rows = map_batches(docs.select("doc_id", "text"), tokens, f"key long, doc_id {kind.simpleString()}, ids binary")
    rows = rows.select(cell_of(F.col("key"), bounds).alias("cell"), "key", "doc_id", "ids")
    ordered = rows.repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "key", "doc_id", "ids")
    schema = pa.schema([
        ("doc_id", to_arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, done = None, 0  # sequences of the cell so far
        waiting: list[tuple] = []  # (doc_id, ids, ids that are placed already) of documents with ids left

        def close(last: bool) -> pa.RecordBatch:
            """Place what fills whole sequences, or everything."""
            nonlocal done, waiting
            counts = np.array([len(ids) - placed for _, ids, placed in waiting], dtype=np.int64)
            row, start, length, sequence, offset = fill(counts)
            if not last:  # what is left waits for the next documents
                whole = sequence < counts.sum() // SEQUENCE_IDS
                row, start, length, sequence, offset = row[whole], start[whole], length[whole], sequence[whole], offset[whole]
            found = []
            taken = np.zeros(len(waiting), dtype=np.int64)
            for i, s, n, q, o in zip(row.tolist(), start.tolist(), length.tolist(), sequence.tolist(), offset.tolist(), strict=True):
                doc_id, ids, placed = waiting[i]
                piece = ids[placed + s : placed + s + n].astype("<u4").tobytes()
                taken[i] += n
                found.append((doc_id, placed + s, n, zlib.crc32(piece), len(ids), (cell << SEQUENCE_BITS) + done + q, o, piece if with_ids else None))
            done += int(sequence.max()) + 1 if len(sequence) else 0
            waiting = [(d, ids, placed + int(t)) for (d, ids, placed), t in zip(waiting, taken, strict=True) if placed + t < len(ids)]
            columns = list(zip(*found, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for row_cell, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if row_cell != cell:
                    if waiting:
                        yield close(True)
                    cell, done = row_cell, 0
                waiting.append((doc_id, np.frombuffer(ids, dtype="<u2"), 0))
            if waiting:
                yield close(False)
        if waiting:
            yield close(True)

    names = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    packed = map_batches(ordered, run, names)
    return packed if with_ids else packed.drop("ids")
