"""Document fingerprints of improbable features.

Every window of 32 bytes of a text gets a rank by its entropy: windows of very
low or very high entropy carry little, and the rarer an entropy is, the better
the rank. In each stretch of 32 neighbouring windows the leftmost best one is
noted; windows noted at least ``POPULARITY`` times are the text's features. Their
hashes go into Bloom filters of 2048 bits, the next one begun when one holds
``FILTER_FEATURES`` features, so the digest grows with the text. Two digests are
compared filter by filter by the bits that they share beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagelake.llm.store import cell_bounds, cell_of, map_batches, partitions, tuned
from pagelake.llm.textbatch import U64, mix

WINDOW = 32
STRETCH = 32
POPULARITY = 8
FILTER_BITS = 2048
FILTER_BYTES = FILTER_BITS // 8
FILTER_FEATURES = 160
BITS_PER_FEATURE = 5
#: Bytes whose windows are worked on at once; the processor's cache holds them.
BLOCK = 1 << 16
#: Entropy levels between 0 and the most bits that a window can have.
LEVELS = 1000
MOST_BITS = float(np.log2(WINDOW))
#: Entropies of usual prose lie around this level, with this spread; the farther from it, the rarer.
USUAL_BITS, USUAL_SPREAD = 3.5, 0.25
#: Windows below this entropy are runs of a few bytes that unrelated texts share.
LEAST_BITS = 1.5
#: Overlap of two filters that counts as chance, beyond the expected bits, in standard deviations.
CHANCE_DEVIATIONS = 3.0

_FIXED = 1 << 20


def _term(count: np.ndarray) -> np.ndarray:
    """count * log2(count) in fixed point, so that sums don't depend on the order."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, np.round(count * np.log2(np.maximum(count, 1)) * _FIXED), 0).astype(np.int64)


#: What a window's sum gains when the count of a byte rises from k to k + 1.
GAIN = np.diff(_term(np.arange(WINDOW + 1)))


def level_ranks() -> np.ndarray:
    """Rank of each entropy level: 0 is best, -1 is never a feature."""
    bits = (np.arange(LEVELS + 1) + 0.5) * MOST_BITS / LEVELS
    rarity = np.abs(bits - USUAL_BITS) / USUAL_SPREAD
    order = np.argsort(-rarity, kind="stable")
    ranks = np.empty(LEVELS + 1, dtype=np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    ranks[bits < LEAST_BITS] = -1
    return ranks


RANKS = level_ranks()


def equal_neighbours(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, how many of the 31 before it and of the 31 after it are the same."""
    before, after = np.zeros(len(data), dtype=np.uint8), np.zeros(len(data), dtype=np.uint8)
    for lag in range(1, min(WINDOW, len(data))):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    return before, after


def window_levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of the window that begins at each byte."""
    n = len(data) - WINDOW + 1
    before, after = equal_neighbours(data)
    total = np.empty(n, dtype=np.int64)
    total[0] = _term(np.bincount(data[:WINDOW], minlength=256)).sum()
    # from one window to the next the first byte goes and another one comes
    total[1:] = total[0] + np.cumsum(GAIN[before[WINDOW:]] - GAIN[after[: n - 1]])
    bits = MOST_BITS - total / (_FIXED * WINDOW)
    return np.clip((bits * LEVELS / MOST_BITS).astype(np.int16), 0, LEVELS)


def popularity(levels: np.ndarray) -> np.ndarray:
    """How many stretches have each window as their leftmost best one."""
    n = len(levels)
    size = min(STRETCH, n)
    noted = np.zeros(n, dtype=np.uint8)
    for at in range(0, n - size + 1, BLOCK):
        part = levels[at : at + BLOCK + size - 1]
        rank = RANKS[part]
        span = np.where(rank < 0, LEVELS + 1, rank) << 32 | np.arange(len(part))
        width = 1
        while width < size:  # minima of wider stretches from two that overlap
            step = min(width, size - width)
            span = np.minimum(span[: len(span) - step], span[step:])
            width += step
        noted[at : at + len(part)] += np.bincount(span & 0xFFFFFFFF, minlength=len(part)).astype(np.uint8)
    return noted


def window_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    if not len(places):
        return np.zeros(0, dtype=U64)
    words = np.ascontiguousarray(data[places[:, None] + np.arange(WINDOW)]).view(U64)
    total = np.zeros(len(places), dtype=U64)
    for i in range(words.shape[1]):
        total = mix(total + words[:, i] + U64(i + 1))
    return total


def features(data: np.ndarray) -> np.ndarray:
    """Different hashes of a text's features, in order."""
    if not len(data):
        return np.zeros(0, dtype=U64)
    if len(data) < WINDOW:  # a short text is one feature
        padded = np.zeros(WINDOW, dtype=np.uint8)
        padded[: len(data)] = data
        return window_hashes(padded, np.zeros(1, dtype=np.int64)) ^ U64(len(data))
    n = len(data) - WINDOW + 1
    levels = np.concatenate([window_levels(data[at : at + BLOCK + WINDOW - 1]) for at in range(0, n, BLOCK)])
    places = np.flatnonzero((popularity(levels) >= min(POPULARITY, max(1, n - STRETCH + 1))) & (RANKS[levels] >= 0))
    if not len(places):  # nothing but runs of a few bytes
        places = np.zeros(1, dtype=np.int64)
    hashes = np.concatenate([window_hashes(data, places[at : at + BLOCK]) for at in range(0, len(places), BLOCK)])
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, one row of bytes each."""
    chain = np.arange(len(hashes)) // FILTER_FEATURES
    bits = np.zeros((chain[-1] + 1 if len(hashes) else 0, FILTER_BITS), dtype=bool)
    for i in range(BITS_PER_FEATURE):
        bits[chain, ((hashes >> U64(11 * i)) & U64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def digest(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode("ascii")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared bits beyond chance, from 0 to 1; the same for (a, b) and (b, a).

    Each filter of the shorter chain counts with its best partner in the other,
    by its number of bits. Two empty digests are alike, an empty one is like no other.
    """
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    left, right = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    n, m = left.sum(axis=1)[:, None], right.sum(axis=1)[None, :]
    shared = left @ right.T
    expected = n * m / FILTER_BITS
    least = expected + CHANCE_DEVIATIONS * np.sqrt(expected * (1 - n / FILTER_BITS) * (1 - m / FILTER_BITS))
    most = np.minimum(n, m)
    score = np.where(most > least, np.clip((shared - least) / np.maximum(most - least, 1e-9), 0, 1), shared >= most)
    return float((score.max(axis=1) * n[:, 0]).sum() / n.sum())


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _chain(text: str) -> np.ndarray:
    return filters(features(np.frombuffer(text.encode("utf-8"), dtype=np.uint8)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row, without a shuffle.

    NULL and empty texts have an empty fingerprint. Equal texts have equal
    fingerprints; a text shorter than a window is a single feature. Other
    columns are not read.
    """
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(_chain(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.string())], ["doc_id", "fingerprint"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, cells: int) -> DataFrame:
    """(cell, tail, doc_id, text) in order: rows by ranges of doc_id, and in each cell as ``tail`` the first row after it.

    After the last row comes the first of all. Ranges come from quantiles of the
    ids; the texts move once, and only a cell's first row moves twice.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("cell", cell_of(F.col("doc_id"), cell_bounds(docs, "doc_id", cells)))
    # the first id of each cell that has rows: at most ``cells`` of them
    smallest = F.when(F.max(F.col("doc_id").isNull()), None).otherwise(F.min("doc_id"))
    first = placed.groupBy("cell").agg(smallest.alias("id")).orderBy("cell").collect()
    heads = [(row["id"], first[i - 1]["cell"]) for i, row in enumerate(first)]
    heads = spark.createDataFrame(heads, T.StructType([T.StructField("head", docs.schema["doc_id"].dataType), T.StructField("before", T.IntegerType())]))
    placed = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")  # one row a cell
    places = F.array(
        F.struct(F.col("cell").alias("cell"), F.lit(False).alias("tail")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("cell"), F.lit(True).alias("tail"))),
    )
    dealt = placed.select("doc_id", "text", F.explode(F.array_compact(places)).alias("p")).select("p.cell", "p.tail", "doc_id", "text")
    return dealt.repartitionById(max(1, len(first)), F.col("cell")).sortWithinPartitions("cell", "tail", "doc_id", "text")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Each text is compared with its edited form, whose last half is the begin of
    the next document's text, and with the next document. Order is by doc_id,
    NULL first, then by text, so rows that repeat an id have a defined
    neighbour; a table of one row is its own neighbour. NULL texts are empty;
    texts of one character have no half to replace. Empty tables give no rows.
    """
    tuned(docs.sparkSession)
    rows = with_next(docs, partitions(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (cell, doc_id, text, its filters): its next row has not come yet
        for batch in batches:
            found = []
            for cell, tail, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if waiting is None and tail:
                    continue  # further rows of the next cell's first id
                chain = _chain(text)
                if waiting is not None:
                    new = edited(waiting[2], text)
                    edited_chain = _chain(new)
                    found.append((
                        waiting[1], len(waiting[2]), hashlib.sha256(new.encode("utf-8")).hexdigest(), digest(waiting[3]), digest(edited_chain),
                        likeness(waiting[3], edited_chain), likeness(waiting[3], chain),
                    ))
                waiting = None if tail else (cell, doc_id, text, chain)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in found], schema=schema)

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = pa.schema([
        ("doc_id", kind), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    names = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {names}")
