"""Per-key rate limiting over an event log, with windows anchored to events.

The first event of a key opens a window of W seconds. The first event at or
after its end opens the next one. Every event counts, blocked ones too; an event
is allowed while its number inside the window is at most the limit.

Which events open a window is a chain per key, so a naive fold sorts each key in
one task. Here it is a segmented scan over ranges of (key, time), for keys of
any size alike:

1. The events are ranged and sorted once. A range that begins inside a key does
   not know which window is open there, so it sums up what each possible window
   would lead to: a table from the end of the open window to the window that is
   open at the range's end, and its count. Windows that begin apart run
   together, so the table of a range much longer than W is short; that of a
   range shorter than W has its times.
2. The carries, a row for each range, are scanned in order: each range's window
   at its begin is that of the range before, looked up in its table.
3. Each range is followed batch by batch from the window it begins with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import cut_lineage

MICROS = 1_000_000
FIELDS = ("window_start", "window_count", "allowed")

#: A key with its open window: start and count.
Carry = tuple[object, int, int]


def rate_limit(
    events: DataFrame,
    key: str,
    ts: str,
    order: str,
    max_requests: int,
    window_secs: int,
    state: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Events with window_start, window_count and allowed.

    Events are taken in (ts, order) order. ``state`` (key, window_start,
    window_count) carries windows that are still open from earlier events; an
    event older than its key's open window counts in that window. An event
    without key or time belongs to no window and comes back with NULLs.
    ``ranges`` sets the number of ranges; without it Spark chooses.
    """
    width = window_secs * MICROS
    placed = F.col(key).isNotNull() & F.col(ts).isNotNull()
    unplaced, known = events.filter(~placed), events.filter(placed)
    none = F.lit(None).cast("bigint")
    rows = known.select("*", F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), none.alias("_used"))
    if state is not None:
        # an open window is a row before its key's events
        given = {key: F.col(key).cast(events.schema[key].dataType), "_t": F.unix_micros(F.col("window_start").cast("timestamp")), "_used": F.col("window_count").cast("bigint")}
        opened = state.filter(F.col(key).isNotNull() & F.col("window_start").isNotNull())
        rows = rows.unionByName(opened.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]))
    along = [F.col(key), F.col("_used").isNull(), F.col("_t"), F.col(order)]
    dealt = rows.repartitionByRange(ranges, *along) if ranges else rows.repartitionByRange(*along)
    dealt = cut_lineage(dealt.sortWithinPartitions(*along).withColumn("_part", F.spark_partition_id()))

    kind = dealt.schema[key].dataType
    narrow = dealt.select(F.col(key).alias("key"), "_t", "_used", "_part")
    carries = narrow.mapInArrow(_summed(width), _summary_schema(kind))
    entries = carries.repartition(1).sortWithinPartitions("part").mapInArrow(_scanned(width), "part int, start long, used long")
    begins = {row["part"]: (row["start"], row["used"]) for row in entries.collect()}  # at most one row for each range

    columns = [*events.columns, "_t", "_used", "_part"]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in events.schema], T.StructField("_s", T.LongType()), T.StructField("_n", T.LongType())])
    followed = dealt.select(*columns).mapInArrow(_followed(width, events.columns.index(key), len(events.columns), begins), schema)
    limited = followed.select(
        *events.columns,
        F.timestamp_micros("_s").cast(events.schema[ts].dataType).alias("window_start"),
        F.col("_n").alias("window_count"),
        (F.col("_n") <= max_requests).alias("allowed"),
    )
    kinds = {name: limited.schema[name].dataType for name in FIELDS}
    return limited.unionByName(unplaced.withColumns({name: F.lit(None).cast(k) for name, k in kinds.items()}))


def limiter_state(limited: DataFrame, key: str, state: DataFrame | None = None) -> DataFrame:
    """The open window per key after the events of ``limited``; keys without events keep their state."""
    newest = limited.filter("window_start is not null").groupBy(key).agg(F.max(F.struct("window_start", "window_count")).alias("_w"))
    newest = newest.select(key, "_w.window_start", "_w.window_count")
    if state is None:
        return newest
    return newest.unionByName(state.select(*newest.columns).join(newest.select(key), key, "left_anti"))


def rate_limit_usage(limited: DataFrame, key: str) -> DataFrame:
    """Requests, blocked requests, windows and the largest counter per key."""
    return limited.groupBy(key).agg(
        F.count("*").alias("n_requests"),
        F.count_if(~F.col("allowed")).alias("n_blocked"),
        F.count_if(F.col("window_count") == 1).alias("n_windows"),
        F.max("window_count").alias("max_count"),
    )


def _open_window(t: np.ndarray, width: int, start: int, used: int, starts: np.ndarray, numbers: np.ndarray) -> tuple[int, int]:
    """Fill in window start and number of a key's sorted times after an open window; returns the window open at the end."""
    i, n = 0, len(t)
    while i < n:
        if t[i] - start >= width:
            start, used = int(t[i]), 0
        j = max(int(np.searchsorted(t, start + width)), i + 1)
        starts[i:j] = start
        numbers[i:j] = np.arange(used + 1, used + 1 + j - i)
        used, i = used + j - i, j
    return start, used


def _runs(batch: pa.RecordBatch, at: int, carry: Carry | None) -> Iterator[tuple[int, int, object, bool]]:
    """(low, high, key, continues) of each run of a key in a batch; whether the first one goes on with the carry's key."""
    coded = batch.column(at).dictionary_encode()
    codes = coded.indices.to_numpy()
    begins = np.flatnonzero(np.diff(codes, prepend=-1))
    for low, high in zip(begins.tolist(), np.append(begins[1:], len(codes)).tolist(), strict=True):
        own = coded.dictionary[codes[low]].as_py()
        yield low, high, own, low == 0 and carry is not None and carry[0] == own


def _follow(batch: pa.RecordBatch, key_at: int, t_at: int, width: int, carry: Carry | None) -> tuple[np.ndarray, np.ndarray, Carry | None]:
    """Window start and number of each row, and the window open at the end of the batch."""
    t, used = batch.column(t_at).to_numpy(), batch.column(t_at + 1)
    opened = used.is_valid().to_numpy(zero_copy_only=False)
    starts, numbers = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
    for low, high, own, continues in _runs(batch, key_at, carry):
        if continues:
            start, count = carry[1], carry[2]
        elif opened[low]:
            start, count = int(t[low]), used[low].as_py()
        else:
            start, count = int(t[low]), 0
        first = low + int(opened[low:high].sum())
        start, count = _open_window(t[first:high], width, start, count, starts[first:high], numbers[first:high])
        carry = (own, start, count)
    return starts, numbers, carry


def _transfer(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(until, start, count) of a run of sorted times: a window whose end is at most ``until``, and after the ``until``
    before, leads to this open window. A window that ends after all times stays open."""
    first = np.flatnonzero(np.diff(t, prepend=t[0] - 1))  # of equal times
    distinct = t[first]
    to = np.searchsorted(distinct, distinct + width)
    to = np.where(to < len(distinct), to, np.arange(len(distinct)))
    while True:  # jumps double until all stand at their last window
        further = to[to]
        if (further == to).all():
            break
        to = further
    last = np.flatnonzero(np.append(to[1:] != to[:-1], True))
    return distinct[last], distinct[to[last]], len(t) - first[to[last]]


def _summary_schema(kind: T.DataType) -> T.StructType:
    numbers = T.ArrayType(T.LongType())
    fields = [("part", T.IntegerType()), ("first", kind), ("last", kind), ("single", T.BooleanType()), ("opened", T.BooleanType()), ("n", T.LongType()),
              ("until", numbers), ("starts", numbers), ("counts", numbers), ("start", T.LongType()), ("used", T.LongType())]
    return T.StructType([T.StructField(*f) for f in fields])


def _summed(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a range: its first and last key, the first one's transfer table, and the window that a fresh begin leaves open."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, carry, part, first, kind = [], None, None, None, None
        single = True
        opened = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part, kind, first = batch.column(3)[0].as_py(), batch.column(0).type, batch.column(0)[0].as_py()
                opened = batch.column(2)[0].is_valid
            for low, high, own, _ in _runs(batch, 0, None):
                if own != first:
                    single = False
                    break
                head.append(batch.column(1).to_numpy()[low:high])
            _, _, carry = _follow(batch, 0, 1, width, carry)
        if part is None:
            return
        times = np.concatenate(head)
        table = [np.zeros(0, dtype=np.int64)] * 3 if opened or not single else _transfer(times, width)
        row = [part, first, carry[0], single, bool(opened), len(times), *table, carry[1], carry[2]]
        types = [pa.int32(), kind, kind, pa.bool_(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64()]
        names = ["part", "first", "last", "single", "opened", "n", "until", "starts", "counts", "start", "used"]
        yield pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, types, strict=True)], names)

    return run


def _scanned(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exclusive scan of the carries: (part, start, used) of ranges that begin inside a key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        found = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                inside = carry is not None and carry[0] == row["first"].as_py() and not row["opened"].as_py()
                if inside:
                    found.append((row["part"].as_py(), carry[1], carry[2]))
                window = row["start"].as_py(), row["used"].as_py()
                if inside and row["single"].as_py():
                    until = row["until"].values.to_numpy()
                    at = int(np.searchsorted(until, carry[1] + width))
                    stays = at == len(until)
                    window = (carry[1], carry[2] + row["n"].as_py()) if stays else (row["starts"].values[at].as_py(), row["counts"].values[at].as_py())
                carry = (row["last"].as_py(), *window)
        columns = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "start", "used"])

    return run


def _followed(width: int, key_at: int, n_columns: int, begins: dict[int, tuple[int, int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The events of a range with window start and number, from the window that is open at its begin."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, fresh = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if fresh:
                fresh = False
                begin = begins.get(batch.column(n_columns + 2)[0].as_py())
                if begin is not None:
                    carry = (batch.column(key_at)[0].as_py(), *begin)
            starts, numbers, carry = _follow(batch, key_at, n_columns, width, carry)
            out = pa.RecordBatch.from_arrays([*batch.columns[:n_columns], pa.array(starts), pa.array(numbers)], [*batch.schema.names[:n_columns], "_s", "_n"])
            yield out.filter(batch.column(n_columns + 1).is_null())  # without the rows of open windows

    return run
