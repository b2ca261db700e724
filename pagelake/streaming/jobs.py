"""Streaming forms: extraction, rate limits, job state, lease expiry.

Job state and lease expiry are Spark's own keyed state: a micro-batch costs what its rows cost, not what the history
holds. A job's rows are combined inside each Arrow batch before they are shuffled: for the job state to the six that can
matter, for leases to one packed row. The state store writes changes only (RocksDB with a change log).

The rate limit keeps its open windows as a table, because its batch form splits hot keys: every micro-batch is written
under its own version. A replayed batch starts from the state before it and rewrites its own version.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelake.operators.jobs import ACTIONS
from pagelake.operators.limits import limiter_state, rate_limit
from pagelake.operators.store import detect_changed, with_checksum
from pagelake.plans.extract import extract_pages
from pagelake.session import cut_lineage
from pagelake.sources.contents import merge_segments, read_checksums, write_contents

MICROS = 1_000_000
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _folder(base: str, name: str, version: int) -> str:
    return f"{base}/{name}/version={version:012d}"


def _previous(spark: SparkSession, base: str, name: str, version: int) -> DataFrame | None:
    """The state written by the batch before; batch 0 starts from nothing."""
    return spark.read.parquet(_folder(base, name, version - 1)) if version > 0 else None


def _forget(spark: SparkSession, base: str, name: str, version: int) -> None:
    """Delete the state that no replay can need any more: a batch reads the version before it only."""
    if version > 1:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folder(base, name, version - 2))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _start(stream: DataFrame, step, base: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_rate_limit(
    events: DataFrame, key: str, ts: str, order: str, max_requests: int, window_secs: int, base: str, available_now: bool = True
) -> StreamingQuery:
    """Limit an event stream; decisions go to ``base/decisions``, open windows to ``base/state``.

    Events are taken in (ts, order) order inside a micro-batch. An event that
    arrives later than its batch and is older than its key's open window counts
    in that window.
    """

    def step(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        state = _previous(spark, base, "state", version)
        limited = rate_limit(batch, key, ts, order, max_requests, window_secs, state)
        limited.write.mode("overwrite").parquet(_folder(base, "decisions", version))
        stored = spark.read.parquet(_folder(base, "decisions", version))
        limiter_state(stored, key, state).write.mode("overwrite").parquet(_folder(base, "state", version))
        _forget(spark, base, "state", version)

    return _start(events, step, base, available_now)


def _start_keyed(stream: DataFrame, step, base: str, available_now: bool) -> StreamingQuery:
    """Start a query with keyed state in the change-logging store, where the session names no other."""
    conf = stream.sparkSession.conf
    for key, value in STATE_STORE.items():
        if key not in conf.getAll:
            conf.set(key, value)
    writer = stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


LOG_ROW = "job_id string, t long, seq long, action string, owner string, lease_secs long, error string, next_t long, backoff long, failures binary"


def _last_of(job: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Places of the last row of each job among the kept ones; rows are in the order of their job."""
    at = np.flatnonzero(keep)
    return at[np.append(job[at][1:] != job[at][:-1], True)] if len(at) else at


def _decisive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each job in a batch the rows that can decide its state, with the places of its failures in one of them.

    These are its first enqueue and its last claim, success, extension, failure
    and failure with a next run: six rows of a job at most.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        job = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        t, seq = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        order = np.lexsort((seq, t, job))
        batch = batch.take(pa.array(order))
        job, t, seq = job[order], t[order], seq[order]
        action = np.array(batch.column(3).to_pylist())
        enqueue, failure = action == "enqueue", action == "failure"
        first = np.flatnonzero(enqueue)
        first = first[np.append(True, job[first][1:] != job[first][:-1])] if len(first) else first
        again = failure & batch.column(7).is_valid().to_numpy(zero_copy_only=False)
        chosen = [first, *[_last_of(job, keep) for keep in (action == "claim", action == "success", action == "extend", failure, again)]]
        places: list[bytes | None] = [None] * len(job)
        at = np.flatnonzero(failure)
        for own in np.split(at, np.flatnonzero(job[at][1:] != job[at][:-1]) + 1) if len(at) else []:
            places[own[-1]] = np.stack([t[own], seq[own]]).astype("<i8").tobytes()
        keep = np.unique(np.concatenate(chosen))
        columns = [c.take(pa.array(keep)) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([places[i] for i in keep], type=pa.binary())], [*batch.schema.names, "failures"])


JOB_ROW = "job_id string, status string, run_t long, attempts long, backoff_seconds long, till_t long, reserved_by string, last_error string"
#: A job's decisive rows, its failures after the enqueue, and the places of those that none precedes.
JOB_STATE = (
    "t array<long>, seq array<long>, action array<string>, owner array<string>, lease_secs array<long>, error array<string>, "
    "next_t array<long>, backoff array<long>, attempts long, early_t array<long>, early_seq array<long>"
)
_LOG_FIELDS = ("t", "seq", "action", "owner", "lease_secs", "error", "next_t", "backoff")


def _plain(value):
    return None if value is None or pd.isna(value) else value if isinstance(value, str) else int(value)


def _fold_job(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job's row after the decisive rows of one micro-batch; the rules are those of ``job_state_fold``.

    The state is itself decisive rows, so batches combine in any order.
    """
    attempts, early, rows = 0, [], []
    if state.exists:
        *columns, attempts, early_t, early_seq = state.get
        rows, early = list(zip(*columns, strict=True)), list(zip(early_t, early_seq, strict=True))
    for frame in frames:
        for r in frame.itertuples(index=False):
            rows.append(tuple(_plain(getattr(r, f)) for f in _LOG_FIELDS))
            if r.failures is not None:
                t, seq = np.frombuffer(r.failures, dtype="<i8").reshape(2, -1)
                early.extend(zip(t.tolist(), seq.tolist(), strict=True))
    rows.sort(key=lambda r: (r[0], r[1], ACTIONS[r[2]]))
    first = next((r for r in rows if r[2] == "enqueue"), None)
    born = first[:2] if first else None

    def newest(*actions: str, again: bool = False):
        return next((r for r in reversed(rows) if r[2] in actions and (not again or r[6] is not None)), None)

    last, claim, done = newest("claim", "success", "failure"), newest("claim"), newest("success")
    extended, failed, moved = newest("extend"), newest("failure"), newest("failure", again=True)
    kept = sorted({r for r in (first, claim, done, extended, failed, moved) if r is not None}, key=lambda r: (r[0], r[1], ACTIONS[r[2]]))
    if born is not None:
        attempts += sum(place > born for place in early)
        early = [place for place in early if place <= born]
    columns = [list(c) for c in zip(*kept, strict=True)]
    state.update((*columns, attempts, [t for t, _ in early], [q for _, q in early]))
    if born is None:
        return

    def valid(r):
        return r if r is not None and r[:2] > born else None

    last, extended, failed, moved = (valid(r) for r in (last, extended, failed, moved))
    status, till, owner = "queued", None, None
    if last is not None and last[2] == "claim":
        status, owner = "running", last[3]
        till = None if last[4] is None else last[0] + last[4] * MICROS
        if extended is not None and extended[:2] > last[:2]:
            till = None if extended[4] is None else extended[0] + extended[4] * MICROS
    elif last is not None:
        status = "succeeded" if last[2] == "success" else "failed" if last[6] is None else "queued"
    backoff, error = (failed[7] or 0, failed[5]) if failed is not None else (0, None)
    row = (key[0], status, moved[6] if moved is not None else born[0], attempts, backoff, till, owner, error)
    yield pd.DataFrame([row], columns=[c.split()[0] for c in JOB_ROW.split(", ")]).astype({"till_t": "Int64"})


def stream_job_state(log: DataFrame, base: str, available_now: bool = True) -> StreamingQuery:
    """Fold a stream of job log rows; ``read_jobs`` gives the current table.

    The result is that of ``job_state_fold`` over all rows so far, in whatever
    order and batches they come: a row that is late counts in its place, and
    actions that come before their job's enqueue wait for it. Only the jobs that
    a batch touches are read and written. The state of a job is at most six log
    rows, and the places of failures that no enqueue precedes.
    """
    kind = log.schema["ts"].dataType
    rows = log.filter(F.col("action").isin(*ACTIONS)).select(
        F.col("job_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("seq").cast("long"), "action", "owner",
        F.col("lease_secs").cast("long"), "error", F.unix_micros(F.col("next_run_at").cast("timestamp")).alias("next_t"), F.col("backoff_seconds").cast("long").alias("backoff"),
    )
    thin = rows.filter("t is not null and seq is not null").mapInArrow(_decisive, LOG_ROW)
    folded = thin.groupBy("job_id").applyInPandasWithState(_fold_job, JOB_ROW, JOB_STATE, "update", GroupStateTimeout.NoTimeout)
    named = folded.select(
        "job_id", "status", F.timestamp_micros("run_t").cast(kind).alias("run_at"), "attempts", "backoff_seconds",
        F.timestamp_micros("till_t").cast(kind).alias("visibility_till"), "reserved_by", "last_error",
    )

    def step(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(base, "jobs", version))

    return _start_keyed(named, step, base, available_now)


def read_jobs(spark: SparkSession, base: str) -> DataFrame:
    """The current row of every job: the one that the newest complete batch which touched it wrote."""
    rows = _complete(spark, base, "jobs")
    newest = rows.groupBy(F.col("job_id").alias("_job")).agg(F.max("version").alias("_newest"))
    return rows.join(newest, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("version") == F.col("_newest"))).drop("_job", "_newest", "version")


def _versions(spark: SparkSession, base: str, name: str) -> list[int]:
    """Versions of an output that were written to their end."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(mark.getPath().getParent().getName().partition("=")[2]) for mark in found or ())


def _complete(spark: SparkSession, base: str, name: str) -> DataFrame:
    """All rows of complete versions with ``version``."""
    versions = _versions(spark, base, name)
    if not versions:
        raise ValueError(f"no complete version of {name} in {base}")
    return spark.read.option("basePath", f"{base}/{name}").parquet(*[_folder(base, name, v) for v in versions]).withColumn("version", F.col("version").cast("long"))


def compact_jobs(spark: SparkSession, base: str) -> None:
    """Rewrite the newest version of the job table with the current rows of all, and drop the others; for a stream at rest."""
    versions = _versions(spark, base, "jobs")
    current = cut_lineage(read_jobs(spark, base))
    current.write.mode("overwrite").parquet(_folder(base, "jobs", versions[-1]))
    for version in versions[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folder(base, "jobs", version))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_latest(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The newest version of a state table that was written to its end."""
    versions = _versions(spark, base, name)
    if not versions:
        raise ValueError(f"no complete version of {name} in {base}")
    return spark.read.parquet(_folder(base, name, versions[-1]))


def stream_extract(
    pages: DataFrame, base: str, html: str = "html", profiles: DataFrame | None = None, available_now: bool = True
) -> StreamingQuery:
    """Extract a stream of pages (item_id, url, html, fetched_at) and store what changed in ``base/contents``.

    Only changed rows are written, with their clean columns. Of the stored rows only
    ids, versions and checksums are read, from segments whose Bloom filter may hold
    an id of the batch, and segments are merged as their levels fill.
    """
    contents = f"{base}/contents"

    def step(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        documents, _ = extract_pages(batch, html, profiles=profiles)
        incoming = with_checksum(
            documents.select(
                "item_id", "clean_html", F.col("text").alias("clean_text"), F.col("language").alias("lang"),
                F.col("fetched_at").alias("extracted_at"),
            )
        )
        incoming = cut_lineage(incoming)  # read again below; extraction runs once
        if version > 0:
            incoming = detect_changed(incoming, read_checksums(spark, contents, incoming, before=version))
        write_contents(incoming, contents, version, part="clean")
        merge_segments(spark, contents, version)

    return _start(pages, step, base, available_now)


# Log actions that concern a lease.
LEASE_ACTIONS = ("claim", "extend", "success", "failure")


LEASE_ROW = "job_id string, moves binary, clock long"
LEASE_STATE = "t array<long>, seq array<long>, action array<string>, lease_secs array<long>"
_MOVE = np.dtype([("t", "<i8"), ("seq", "<i8"), ("action", "<i1"), ("lease", "<i8")])
_NONE = np.iinfo(np.int64).min


def _runs_of_jobs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each job of a batch, with all its log rows packed in the order of (t, seq).

    A further row without a job carries the batch's newest time; the others have
    none, so that Spark drops no late row on the way to the state.
    """
    codes = {name: code for code, name in enumerate(LEASE_ACTIONS)}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, dtype=_MOVE)
        for name, i in (("t", 1), ("seq", 2), ("lease", 4)):
            rows[name] = batch.column(i).fill_null(_NONE).to_numpy()
        rows["action"] = [codes[a] for a in batch.column(3).to_pylist()]
        coded = batch.column(0).dictionary_encode()
        job = coded.indices.fill_null(-1).to_numpy()
        order = np.lexsort((rows["seq"], rows["t"], job))
        job, rows = job[order], rows[order]
        begins = np.flatnonzero(np.diff(job, prepend=-2))
        names = coded.dictionary.to_pylist()
        found = [(None if job[low] < 0 else names[job[low]], rows[low:high].tobytes(), None) for low, high in zip(begins, np.append(begins[1:], len(job)), strict=True)]
        newest = pa.compute.max(batch.column(1)).as_py()
        jobs, moves, clock = zip(*found, (None, None, newest), strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(jobs, type=pa.string()), pa.array(moves, type=pa.binary()), pa.array(clock, type=pa.int64())],
            ["job_id", "moves", "clock"],
        )


def _expire(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows (kind, job_id, t, seq, action, lease_secs): leases that the clock has passed, with their end as t, and late rows.

    The state holds the job's rows after the clock and, before it, the last move
    and the last extension after that. The timer stands at the next end of a lease.
    """
    clock = state.getCurrentWatermarkMs() * 1000
    held = list(zip(*state.get, strict=True)) if state.exists else []
    late, fresh = [], []
    if not state.hasTimedOut:
        for frame in frames:
            for packed in frame["moves"].dropna():
                for t, seq, action, lease in np.frombuffer(packed, dtype=_MOVE).tolist():
                    row = (*(None if x == _NONE else x for x in (t, seq)), LEASE_ACTIONS[action], None if lease == _NONE else lease)
                    (fresh if key[0] is not None and row[0] is not None and row[0] > clock else late).append(row)
    rows = sorted([*held, *fresh], key=lambda r: (r[0], r[1] or 0))
    expired, kept, running, ends = [], [], False, []
    for row, following in zip(rows, [*rows, None][1:], strict=True):
        if row[2] != "extend":
            running = row[2] == "claim"
        until = row[0] + row[3] * MICROS if running and row[3] is not None else None
        open_ = until is not None and (following is None or following[0] > until)
        if open_ and until <= clock:
            # what the clock passed at an earlier call was reported then: its row is kept with no lease
            expired.append((until, None, None, None))
            row = (row[0], row[1], row[2], None)
        elif open_:
            ends.append(until)
        elif following is not None and following[0] <= clock:
            row = (row[0], row[1], row[2], None)  # nothing can come between the two any more, and the second may go
        if row[0] <= clock and row[2] != "extend":
            kept = [row]  # nothing before the last move at the clock can matter
        elif row[0] <= clock:
            kept = [*[k for k in kept if k[2] != "extend"], row]
        else:
            kept.append(row)
    if len(kept) == 1 and kept[0][0] <= clock and kept[0][2] != "claim":
        kept = []  # at rest: a later extension finds no claim either way
    if kept:
        state.update(tuple(list(column) for column in zip(*kept, strict=True)))
        pending = [e for e in ends] + [r[0] for r in kept if r[0] > clock]
        if pending:
            state.setTimeoutTimestamp(max(min(pending) // 1000, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    found = [("expired", *e) for e in expired] + [("late", *r) for r in late]
    if found:
        out = pd.DataFrame(found, columns=["kind", "t", "seq", "action", "lease_secs"])
        out.insert(1, "job_id", key[0])
        yield out.astype({"t": "Int64", "seq": "Int64", "lease_secs": "Int64"})


def stream_lease_expiry(log: DataFrame, base: str, late_secs: int = 3600, available_now: bool = True) -> StreamingQuery:
    """Write one row (job_id, expired_at) to ``base/expired`` for every lease that runs out with no action in time.

    The log has job_id, ts, seq, action and lease_secs. The clock is Spark's
    watermark: the newest time of the batches before, less ``late_secs``. A
    lease is reported by an event-time timer when the clock passes its end, so
    rows that come out of order before that count in their place. Rows behind
    the clock, and rows without job or time, go to ``base/late``. Kept are a
    job's rows after the clock and, if its last move is a claim, that claim and
    the last extension; a job at rest keeps nothing.
    """
    kind = log.schema["ts"].dataType
    rows = log.filter(F.col("action").isin(*LEASE_ACTIONS)).select(
        F.col("job_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("seq").cast("long"), "action", F.col("lease_secs").cast("long"),
    )
    thin = rows.mapInArrow(_runs_of_jobs, LEASE_ROW).withColumn("clock", F.timestamp_micros("clock")).withWatermark("clock", f"{late_secs} seconds")
    out = thin.groupBy("job_id").applyInPandasWithState(
        _expire, "kind string, job_id string, t long, seq long, action string, lease_secs long", LEASE_STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
    named = out.withColumn("ts", F.timestamp_micros("t").cast(kind)).drop("t")

    def step(batch: DataFrame, version: int) -> None:
        batch = cut_lineage(batch)  # written in two parts
        batch.filter("kind = 'expired'").select("job_id", F.col("ts").alias("expired_at")).write.mode("overwrite").parquet(_folder(base, "expired", version))
        batch.filter("kind = 'late'").select("job_id", "ts", "seq", "action", "lease_secs").write.mode("overwrite").parquet(_folder(base, "late", version))

    return _start_keyed(named, step, base, available_now)
