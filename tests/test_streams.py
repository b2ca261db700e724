"""Streams in several micro-batches give what the batch operators give."""

import datetime as dt
import random
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pagelake.operators.jobs import job_state_fold, lease_gaps
from pagelake.operators.limits import rate_limit
from pagelake.operators.store import with_checksum
from pagelake.plans.extract import extract_pages
from pagelake.sources import fixtures as X
from pagelake.sources.contents import read_contents
from pagelake.sources.tables import read_fixture
from pagelake.streaming.jobs import (
    _decisive, _runs_of_jobs, compact_jobs, read_jobs, read_latest, stream_extract, stream_job_state, stream_lease_expiry, stream_rate_limit,
)

from conftest import SF


def _in_files(spark, df, order, path, n=4):
    """Write df as n files in time order and read it back as a stream, one file per batch."""
    df = df.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()).cache()
    for i in range(n):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    schema = df.drop("part").schema
    df.unpersist()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rate_limit(spark, tmp_path):
    events = read_fixture(spark, SF, "events").select("event_id", "user_id", "ts")
    stream = _in_files(spark, events, "ts", str(tmp_path / "in"))
    stream_rate_limit(stream, "user_id", "ts", "event_id", 3, 21600, str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "decisions"))
    assert got.select("version").distinct().count() == 4
    want = rate_limit(events, "user_id", "ts", "event_id", 3, 21600)
    assert _rows(got.select(want.columns)) == _rows(want)


def test_job_state(spark, tmp_path):
    log = X.job_log(X.with_k(read_fixture(spark, SF, "events")))
    stream = _in_files(spark, log, "ts", str(tmp_path / "in"))
    stream_job_state(stream, str(tmp_path / "out")).awaitTermination()
    want = job_state_fold(log)
    assert _rows(read_jobs(spark, str(tmp_path / "out")).select(want.columns)) == _rows(want)
    compact_jobs(spark, str(tmp_path / "out"))
    assert _rows(read_jobs(spark, str(tmp_path / "out")).select(want.columns)) == _rows(want)


def _thrown_about(spark, rows, schema, path, batches, seed=5):
    """Rows in files of a batch each, in no order."""
    rnd, rows = random.Random(seed), list(rows)
    rnd.shuffle(rows)
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], schema).coalesce(2).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


def _log(n, jobs, seed, hot=0.0):
    rnd, rows, start = random.Random(seed), [], dt.datetime(2024, 1, 1)
    for i in range(n):
        action = rnd.choice(["enqueue", "claim", "claim", "extend", "extend", "success", "failure", "failure"])
        ts, again = start + dt.timedelta(seconds=rnd.randrange(0, 40_000)), rnd.random() < 0.6
        job = "hot" if rnd.random() < hot else f"j{rnd.randrange(jobs)}"
        failed = action == "failure"
        rows.append((job, ts, i, action, f"w{i % 5}", rnd.choice([60, 300, 3000]), f"e{i}" if failed else None,
                     ts + dt.timedelta(seconds=i) if failed and again else None, i if failed and again else None))
    return rows


JOB_LOG = "job_id string, ts timestamp_ntz, seq long, action string, owner string, lease_secs long, error string, next_run_at timestamp_ntz, backoff_seconds long"


def test_job_state_in_any_order(spark, tmp_path):
    """Rows thrown about over batches fold like the whole log, also before their enqueue, and a hot job's."""
    rows = _log(1500, 40, 3, hot=0.35)
    stream_job_state(_thrown_about(spark, rows, JOB_LOG, str(tmp_path / "in"), 5), str(tmp_path / "out")).awaitTermination()
    want = job_state_fold(spark.createDataFrame(rows, JOB_LOG))
    assert _rows(read_jobs(spark, str(tmp_path / "out")).select(want.columns)) == _rows(want)


def test_job_state_replays_a_batch(spark, tmp_path):
    """A batch whose commit was lost runs again on the state before it, and writes what it wrote."""
    path, base = str(tmp_path / "in"), str(tmp_path / "out")
    rows = _log(600, 20, 4)
    stream = _thrown_about(spark, rows[:400], JOB_LOG, path, 3)
    stream_job_state(stream, base).awaitTermination()
    before = _rows(read_jobs(spark, base))
    last = max(int(p.name) for p in (tmp_path / "out" / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "out" / "checkpoint" / "commits" / name).unlink()
    stream_job_state(stream, base).awaitTermination()
    assert _rows(read_jobs(spark, base)) == before
    spark.createDataFrame(rows[400:], JOB_LOG).coalesce(1).write.mode("append").parquet(path)
    stream_job_state(stream, base).awaitTermination()
    assert _rows(read_jobs(spark, base)) == _rows(job_state_fold(spark.createDataFrame(rows, JOB_LOG)).select(*read_jobs(spark, base).columns))
    # a batch writes the jobs that it touched, not all
    touched = {r[0] for r in rows[400:]}
    newest = max(p.name for p in (tmp_path / "out" / "jobs").iterdir())
    assert {r.job_id for r in spark.read.parquet(f"{base}/jobs/{newest}").collect()} <= touched


def test_rows_are_combined_before_they_meet_the_state():
    rows = [("hot", t, t, "extend" if t % 3 else "failure", "w", 300, "e", None if t % 2 else t, 1) for t in range(3000)] + [("j", 1, 1, "enqueue", "w", 300, None, None, None)]
    names = ["job_id", "t", "seq", "action", "owner", "lease_secs", "error", "next_t", "backoff"]
    batch = pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({"next_t": "Int64", "backoff": "Int64"}), preserve_index=False)
    thin = next(_decisive([batch])).to_pandas()
    assert len(thin[thin.job_id == "hot"]) == 3  # last extension, last failure, last failure with a next run
    assert sum(len(f) // 16 for f in thin.failures if f is not None) == 1000
    beats = pa.RecordBatch.from_pydict({"job_id": ["hot"] * 1000 + ["j", None], "t": [t * 1_000_000 for t in range(1000)] + [5, None], "seq": list(range(1002)),
                                        "action": ["claim"] + ["extend"] * 1001, "lease_secs": [60] * 1001 + [None]})
    packed = next(_runs_of_jobs([beats])).to_pylist()
    assert sorted((r["job_id"] or "", len(r["moves"] or b"") // 25, r["clock"]) for r in packed) == [("", 0, 999_000_000), ("", 1, None), ("hot", 1000, None), ("j", 1, None)]


def test_leases_of_a_hot_job_equal_the_batch_form(spark, tmp_path):
    rows = sorted(_log(2000, 25, 6, hot=0.4), key=lambda r: r[1])
    log = spark.createDataFrame(rows, JOB_LOG).select("job_id", "ts", "seq", "action", "lease_secs")
    path, base = str(tmp_path / "in"), str(tmp_path / "out")
    late = random.Random(1)
    dealt = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=late.randrange(0, 3500)))  # out of order by less than an hour
    for i in range(4):
        own = [(r[0], r[1], r[2], r[3], r[5]) for r in dealt[i * 500 : i * 500 + 500]]
        spark.createDataFrame(own, log.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream_lease_expiry(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path), base).awaitTermination()
    end = rows[-1][1] - dt.timedelta(hours=1)
    got = spark.read.parquet(f"{base}/expired").select("job_id", "expired_at")
    assert _rows(got) == _rows(lease_gaps(log, F.lit(end))) and got.count() > 20
    assert spark.read.parquet(f"{base}/late").count() == 0


def test_lease_expiry(spark, tmp_path):
    log = X.job_log(X.with_k(read_fixture(spark, SF, "events"))).select("job_id", "ts", "seq", "action", "lease_secs")
    base = str(tmp_path / "out")
    stream_lease_expiry(_in_files(spark, log, "ts", str(tmp_path / "in")), base).awaitTermination()
    end = log.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    got = spark.read.parquet(f"{base}/expired").select("job_id", "expired_at")
    assert _rows(got) == _rows(lease_gaps(log, F.lit(end))) and got.count() > 0
    assert spark.read.parquet(f"{base}/late").count() == 0


def test_lease_rows_out_of_order(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [  # batch, job, minute, seq, action, lease
        (0, "a", 0, 1, "claim", 300), (0, "a", 10, 3, "extend", 300), (1, "a", 4, 2, "success", None),
        (0, "b", 0, 4, "claim", 300), (1, "b", 4, 5, "extend", 300), (0, "c", 2, 6, "claim", 600), (2, "c", 30, 7, "success", None),
        (1, "d", 400, 8, "claim", 60), (2, "d", 900, 9, "success", None), (2, "e", 100, 10, "claim", 60), (2, None, 500, 11, "claim", 60),
        (0, "f", 20, 12, "claim", 3600), (1, "f", 70, 13, "extend", 3600),
    ]
    path, base = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_id string, ts timestamp_ntz, seq long, action string, lease_secs long"
    for batch in range(3):
        own = [(j, day + dt.timedelta(minutes=m), s, a, n) for b, j, m, s, a, n in rows if b == batch]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream_lease_expiry(stream, base).awaitTermination()
    got = {(r.job_id, int((r.expired_at - day).total_seconds() / 60)) for r in spark.read.parquet(f"{base}/expired").collect()}
    # a: closed in time; b: extended in time; c: its end came too late; e: behind the clock; d and f run out
    assert got == {("b", 9), ("c", 12), ("d", 401), ("f", 130)}
    assert {r.job_id for r in spark.read.parquet(f"{base}/late").collect()} == {"c", "e", None}


def test_unfinished_versions_are_not_read(spark, tmp_path):
    base = str(tmp_path)
    for version in (3, 4):
        spark.range(version).write.parquet(f"{base}/jobs/version={version:012d}")
    (tmp_path / "jobs" / f"version={4:012d}" / "_SUCCESS").unlink()
    assert read_latest(spark, base, "jobs").count() == 3


def test_extract(spark, tmp_path):
    pages = read_fixture(spark, SF, "pages").selectExpr(
        "cast(page_id as string) as item_id", "url", "html", "timestamp'2024-01-01 00:00:00' as fetched_at"
    )
    later = pages.withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    changed = F.col("item_id").cast("int") < 20
    later = later.withColumn("html", F.when(changed, F.replace("html", F.lit("<p>"), F.lit("<p>Added. "))).otherwise(F.col("html")))
    both = pages.unionByName(later)
    base = str(tmp_path / "out")
    stream_extract(_in_files(spark, both, "fetched_at", str(tmp_path / "in"), 2), base).awaitTermination()
    stored = read_contents(spark, f"{base}/contents")
    documents, _ = extract_pages(later)
    want = with_checksum(
        documents.select("item_id", "clean_html", F.col("text").alias("clean_text"), F.col("language").alias("lang"), F.col("fetched_at").alias("extracted_at"))
    )
    assert _rows(stored.select("item_id", "checksum")) == _rows(want.select("item_id", "checksum"))
    # rows that did not change keep their first time and are not written again
    kept = stored.filter(~changed & (F.col("extracted_at") > F.lit("2024-01-15").cast("timestamp")))
    assert kept.count() == 0
    assert spark.read.parquet(str(next((tmp_path / "out" / "contents").glob("buckets=*/clean/seg=*1-*1")))).count() <= 20
