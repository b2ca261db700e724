"""Exact Lloyd clustering of integer vectors with ns-bounds.

For each vector the state holds an upper bound on the distance to its centroid and a lower bound on the distance to
every centroid, each with the round in which it was evaluated. The centroids of all rounds are kept. Before a bound is
used it is loosened by the norm of its centroid's total displacement since that round, which is at most the sum of the
rounds' drifts and often far less. A vector whose loosened upper bound is below all other lower bounds stays; for the
others the distances that the bounds leave open are computed exactly, in whole numbers.

A round is one pass: it reads vectors with their state, writes both anew, and each task adds one row with the sums of
its vectors by cluster. The driver holds only the centroids of each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.store import dropped, map_batches, stored, stored_at, tuned

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Components are held at this, so that squared distances stay below 2**63.
LARGEST = 1 << 27
#: Largest component for which products and their sums are whole numbers in float64.
EXACT_IN_FLOAT = 1 << 22
#: Seed of the first centroids' hashes.
SEED = "1"


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids) of integer vectors."""
    small = max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_FLOAT
    kind = np.float64 if small else np.int64
    x, c = rows.astype(kind), centroids.astype(kind)
    if small:
        return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def below(distance: np.ndarray) -> np.ndarray:
    """A float32 that is surely at most the root of a squared distance."""
    return np.maximum(np.nextafter(np.sqrt(distance.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def above(distance: np.ndarray) -> np.ndarray:
    """A float32 that is surely at least the root of a squared distance."""
    return np.nextafter(np.sqrt(distance.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """(round, centroid): norm of the centroid's total displacement since that round, rounded up."""
    now = history[-1].astype(np.float64)
    return np.stack([above(((now - then) ** 2).sum(1) * (1 + 1e-12)) for then in history]).astype(np.float64)


class Bounds:
    """State of some vectors: cluster, upper bound and its round, lower bounds and their rounds."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, upper_seen: np.ndarray, lower: np.ndarray, lower_seen: np.ndarray):
        self.cluster, self.upper, self.upper_seen, self.lower, self.lower_seen = cluster, upper, upper_seen, lower, lower_seen

    @classmethod
    def first(cls, rows: np.ndarray, centroids: np.ndarray) -> Bounds:
        distance = squared(rows, centroids)
        cluster = distance.argmin(1)  # the first of equal ones
        nearest = distance[np.arange(len(rows)), cluster]
        return cls(cluster, above(nearest), np.zeros(len(rows), dtype=np.int64), below(distance), np.zeros(distance.shape, dtype=np.int64))

    def advance(self, rows: np.ndarray, history: list[np.ndarray]) -> int:
        """Assign to the newest centroids of ``history``; returns how many exact distances that took."""
        now, gone = len(history) - 1, displacements(history)
        centroids, n = history[-1], len(rows)
        everyone, k = np.arange(n), len(centroids)
        upper = self.upper + gone[self.upper_seen, self.cluster]
        lower = self.lower - gone[self.lower_seen, np.arange(k)[None, :]]
        others = lower.copy()
        others[everyone, self.cluster] = np.inf
        # loosened bounds are sums of float64 with a relative error far below this margin
        open_ = np.flatnonzero(upper * (1 + 1e-9) >= others.min(1, initial=np.inf) * (1 - 1e-9))
        if not len(open_):
            return 0
        own = self.cluster[open_]
        nearest = ((rows[open_].astype(np.int64) - centroids[own]) ** 2).sum(1)
        self._evaluated(open_, own, nearest, now)
        self.upper[open_], self.upper_seen[open_] = above(nearest), now
        row, centroid = np.nonzero(self.upper[open_].astype(np.float64)[:, None] * (1 + 1e-9) >= others[open_] * (1 - 1e-9))
        if len(row):
            found = ((rows[open_[row]].astype(np.int64) - centroids[centroid]) ** 2).sum(1)
            self._evaluated(open_[row], centroid, found, now)
            # least distance, then least number, among the own centroid and those that were open
            rank = np.lexsort((np.concatenate([own, centroid]), np.concatenate([nearest, found]), np.concatenate([np.arange(len(open_)), row])))
            best = rank[np.flatnonzero(np.diff(np.concatenate([np.arange(len(open_)), row])[rank], prepend=-1))]
            self.cluster[open_] = np.concatenate([own, centroid])[best]
            self.upper[open_] = above(np.concatenate([nearest, found])[best])
        return len(open_) + len(row)

    def _evaluated(self, row: np.ndarray, centroid: np.ndarray, distance: np.ndarray, now: int) -> None:
        self.lower[row, centroid] = below(distance)
        self.lower_seen[row, centroid] = now

    def columns(self) -> list[pa.Array]:
        n, k = self.lower.shape
        lower, seen = self.lower.astype("<f4").tobytes(), self.lower_seen.astype("<u2").tobytes()
        return [
            pa.array(self.cluster.astype(np.int32)), pa.array(self.upper.astype(np.float32)), pa.array(self.upper_seen.astype(np.int32)),
            _cut(lower, n, 4 * k), _cut(seen, n, 2 * k),
        ]

    @classmethod
    def read(cls, batch: pa.RecordBatch, first: int, k: int) -> Bounds:
        cluster, upper, seen = (batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(3))
        lower = np.frombuffer(b"".join(batch.column(first + 3).to_pylist()), dtype="<f4").reshape(-1, k)
        lower_seen = np.frombuffer(b"".join(batch.column(first + 4).to_pylist()), dtype="<u2").reshape(-1, k)
        return cls(cluster.astype(np.int64), upper.copy(), seen.astype(np.int64), lower.copy(), lower_seen.astype(np.int64))


def _cut(content: bytes, n: int, width: int) -> pa.Array:
    """``n`` binary values of ``width`` bytes."""
    offsets = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(content)])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


STATE = ("cluster", "upper", "upper_seen", "lower", "lower_seen")
_STATE_FIELDS = [
    pa.field(name, kind)
    for name, kind in zip((*STATE, "sums"), (pa.int32(), pa.float32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)
]
_TYPES = "cluster int, upper float, upper_seen int, lower binary, lower_seen binary, sums array<bigint>"


def _pass(table: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """Vectors with their state against the newest centroids, and a row of sums for each task."""
    k, kind = len(history[0]), table.schema["id"].dataType.simpleString()
    names = f"id {kind}, v array<int>, {_TYPES}"
    started = "cluster" in table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, DIMENSIONS + 1), dtype=np.int64)
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _vectors(batch.column(1))
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), *_STATE_FIELDS])
            if started:
                state = Bounds.read(batch, 2, k)
                state.advance(rows, history)
            else:
                state = Bounds.first(rows, history[-1])
            order = np.argsort(state.cluster, kind="stable")
            begins = np.flatnonzero(np.diff(state.cluster[order], prepend=-1))
            numbers = state.cluster[order][begins]
            total[numbers, :DIMENSIONS] += np.add.reduceat(rows[order].astype(np.int64), begins)
            total[numbers, DIMENSIONS] += np.diff(np.append(begins, len(order)))
            columns = [batch.column(0), batch.column(1), *state.columns(), pa.nulls(len(rows), schema.field("sums").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if schema is not None:
            nothing = [pa.nulls(1, field.type) for field in schema][:-1]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([total.ravel().tolist()], type=schema.field("sums").type)], schema=schema)

    return map_batches(table.select("id", "v", *(STATE if started else ())), run, names)


def _last(table: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """(id, cluster, distance) under the newest centroids; the distance is exact."""
    k, kind = len(history[0]), table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, state = _vectors(batch.column(1)), Bounds.read(batch, 2, k)
                state.advance(rows, history)
                distance = ((rows.astype(np.int64) - history[-1][state.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(state.cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return map_batches(table.select("id", "v", *STATE), run, f"id {kind}, cluster int, distance long")


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means by cluster; an empty cluster's centroid stays. At most k * 65 numbers come to the driver."""
    sums = table.filter("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    total = np.zeros(centroids.shape[0] * (DIMENSIONS + 1), dtype=object)
    for at, x in sums.collect():
        total[at] = int(x)
    total = total.reshape(len(centroids), DIMENSIONS + 1)
    return np.array([[int(x) // int(row[-1]) for x in row[:-1]] if row[-1] else old.tolist() for row, old in zip(total, centroids, strict=True)], dtype=np.int64)


def centroid_clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row of ``vectors`` (key, vector).

    Kept are vectors of exactly 64 components of which none is NULL or not
    finite; a component x becomes floor(64 * x), held within 2**27. The first
    centroids are the ``k`` kept vectors with the least lowercase-hex sha256 of
    ``1:<key>``, equal ones by their components; a NULL key counts as ''. After
    ``rounds`` rounds the vectors are assigned once more. Distances are squared,
    ties go to the smaller number, means are floored, and an empty cluster's
    centroid stays. Rows that repeat, or share a key, are vectors of their own.
    With fewer kept vectors than ``k`` there are as many clusters as vectors;
    without any, or with an empty table, no rows. Sums beyond 64 bits are NULL.
    Other columns are not read.
    """
    spark = tuned(vectors.sparkSession)
    ident, values = F.col(f"`{key}`"), F.col(f"`{vector}`")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(values, lambda x: F.least(F.greatest(F.floor(SCALE * x.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    kept = vectors.filter((F.size(values) == DIMENSIONS) & sound).select(ident.alias("id"), scaled.alias("v"))
    rank = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(rank.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    kind = kept.schema["id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    history = [np.array([row["v"] for row in first], dtype=np.int64)]
    table, old = kept, None
    for i in range(rounds):
        table, path = stored_at(_pass(table, history), f"cluster-round-{i}")
        if old:
            dropped(spark, old)
        old = path
        history.append(_moved(table, history[-1]))
        table = table.filter("sums is null")
    if not rounds:
        table, old = stored_at(_pass(kept, history), "cluster-round-0")
        table = table.filter("sums is null")
    found = stored(_last(table, history), "clusters")
    dropped(spark, old)

    sizes = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows
    inertia = {row["cluster"]: int(row["s"]) for row in sizes}
    whole = sum(inertia.values())

    def held(n: int) -> int | None:
        return n if n < 1 << 63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    rows = [(i, held(inertia.get(i, 0)), held(whole), digest) for i, digest in enumerate(digests)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    result = found.join(F.broadcast(named), "cluster")  # k rows
    return result.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
