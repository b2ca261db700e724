import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pagelake.functions.retry import backoff_bounds, backoff_seconds, base_delay, jitter, next_run_at
from pagelake.operators.jobs import (
    attach_item_url, claim_rows, claimed_jobs, dead_letter, dispatch_by_kind, due_batch, due_jobs, job_monitor,
    job_state_fold, lease_expiry, lease_gaps, parse_payloads, retry_plan,
)

NOW = dt.datetime(2024, 1, 2)
LOG = "job_id string, ts timestamp_ntz, seq long, action string, owner string, lease_secs long, error string, next_run_at timestamp_ntz, backoff_seconds long"
JOBS = (
    "id string, kind string, status string, run_at timestamp, attempts int, max_attempts int, visibility_till timestamp, "
    "reserved_by string, last_error string, updated_at timestamp"
)


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


def now():
    return F.lit(NOW)


def _jobs(spark):
    rows = [
        ("due", "k", "queued", at(-5), 0, 25, None, None, None, at(-9)),
        ("exact", "k", "queued", at(0), 0, 25, None, None, None, at(-9)),
        ("later", "k", "queued", at(1), 0, 25, None, None, None, at(-9)),
        ("held", "k", "running", at(-9), 1, 25, at(1), "w1", None, at(-9)),
        ("edge", "k", "running", at(-9), 1, 25, at(0), "w1", None, at(-9)),
        ("lost", "k", "running", at(-9), 2, 25, at(-1), "w1", None, at(-9)),
        ("lostlater", "k", "running", at(3), 2, 25, at(-1), "w1", None, at(-9)),
        ("dead", "k", "failed", at(-9), 25, 25, None, None, "boom", at(-9)),
        ("done", "k", "succeeded", at(-9), 0, 25, None, None, None, at(-9)),
    ]
    return spark.createDataFrame(rows, JOBS)


def test_due(spark):
    assert {r.id for r in due_jobs(_jobs(spark), now()).collect()} == {"due", "exact", "lost"}
    assert [r.id for r in due_batch(_jobs(spark), now(), 2).collect()] == ["lost", "due"]
    assert {r.id for r in claimed_jobs(_jobs(spark), now(), 2).collect()} == {"lost", "due"}


def test_claim(spark):
    got = {r.id: r for r in claim_rows(_jobs(spark), now(), 2, "me", 300).collect()}
    assert len(got) == 9
    lost = got["lost"]
    assert (lost.status, lost.reserved_by, lost.visibility_till, lost.attempts, lost.updated_at) == ("running", "me", at(5), 2, NOW)
    assert got["exact"].status == "queued" and got["held"].reserved_by == "w1"
    # a second claim at the same time takes the next job and not the ones that are held
    again = claim_rows(spark.createDataFrame(list(got.values()), JOBS), now(), 9, "you")
    assert {r.id for r in again.collect() if r.reserved_by == "you"} == {"exact"}
    # once the lease has passed they are due again
    assert {r.id for r in due_jobs(again, F.lit(at(6))).collect()} >= {"lost", "due", "exact"}


def test_monitor_and_dead_letter(spark):
    got = {r.status: r for r in job_monitor(_jobs(spark), now()).collect()}
    assert (got["queued"].n_jobs, got["queued"].n_due, got["queued"].oldest_due) == (3, 2, at(-5))
    assert (got["running"].n_retried, got["running"].attempts, got["running"].n_due) == (4, 6, 1)
    assert got["failed"].oldest_due is None
    assert [(r.id, r.last_error, r.attempts) for r in dead_letter(_jobs(spark)).collect()] == [("dead", "boom", 25)]
    assert {r.id: r.overdue_seconds for r in lease_expiry(_jobs(spark), now()).collect()} == {"lost": 60.0, "lostlater": 60.0}


@pytest.mark.parametrize("attempt,lo,hi", [(0, 21, 39), (1, 42, 78), (2, 84, 156), (10, 21504, 39936), (20, 21504, 39936), (-5, 21, 39)])
def test_backoff_ranges(spark, attempt, lo, hi):
    low, high = backoff_bounds(F.lit(attempt), 30)
    delay = backoff_seconds(F.lit(attempt), 30, jitter(F.col("id"), F.lit(attempt)))
    row = spark.range(500).agg(F.min(delay).alias("a"), F.max(delay).alias("b"), F.min(low).alias("lo"), F.max(high).alias("hi")).first()
    assert (row.lo, row.hi) == (lo, hi)
    assert lo <= row.a < row.b <= hi


def test_backoff_saturates(one):
    assert one(base_delay(F.lit(10), 2**31)) == 2**32 - 1


def test_next_run(one):
    run = one(next_run_at(F.col("r"), F.lit(NOW), F.lit(90)), r=at(-5))
    assert run == NOW + dt.timedelta(seconds=90)
    assert one(next_run_at(F.col("r"), F.lit(NOW), F.lit(None).cast("bigint")), r=at(-5)) == at(-5)


def test_retry_plan(spark):
    rows = [("a", "fetch_page", at(-1), 0, 25), ("b", "fetch_page", at(-1), 24, 25), ("c", "nobody", at(-1), 0, 25), ("d", "fetch_page", at(-1), 1, 3)]
    failed = spark.createDataFrame(rows, "id string, kind string, run_at timestamp, attempts int, max_attempts int")
    got = {r.id: r for r in retry_plan(failed, now(), known_kinds=("fetch_page",), factor=F.lit(1.0)).collect()}
    assert (got["a"].status, got["a"].attempts, got["a"].backoff_seconds, got["a"].run_at) == ("queued", 1, 60, at(1))
    assert (got["b"].status, got["b"].attempts, got["b"].backoff_seconds, got["b"].run_at) == ("failed", 25, 0, at(-1))
    assert (got["c"].status, got["c"].backoff_seconds) == ("failed", 0)
    assert got["d"].backoff_seconds == 120
    jittered = {r.id: r for r in retry_plan(failed, now(), known_kinds=("fetch_page",)).collect()}
    assert 42 <= jittered["a"].backoff_seconds <= 78
    assert jittered["a"].run_at == NOW + dt.timedelta(seconds=jittered["a"].backoff_seconds)


def test_payloads(spark):
    docs = {
        '{"message": "hi"}': ("hi", None), '{"message": "hi", "delay_ms": 5, "more": [1]}': ("hi", 5),
        '{"message": "hi", "delay_ms": null}': ("hi", None), '{"invalid": "payload"}': None, '{"message": 5}': None,
        '{"message": null}': None, '{"message": "hi", "delay_ms": "5"}': None, "not json": None,
        '{"message": "hi", "delay_ms": -5}': None, '{"message": "hi", "delay_ms": 5.5}': None, "[]": None, '"text"': None,
    }
    jobs = spark.createDataFrame([("example_job", p) for p in docs] + [("other", "{}")], "kind string, payload string")
    good, bad = parse_payloads(jobs, "example_job")
    assert {r.payload: tuple(r.data) for r in good.collect()} == {p: v for p, v in docs.items() if v}
    assert {r.payload for r in bad.collect()} == {p for p, v in docs.items() if not v}


def test_attach_item_url(spark):
    jobs = spark.createDataFrame([("j1", "i1"), ("j2", "i9")], "id string, item_id string")
    items = spark.createDataFrame([("i1", "https://x.y")], "id string, url string")
    found, missing = attach_item_url(jobs, items)
    assert [(r.id, r.url) for r in found.collect()] == [("j1", "https://x.y")]
    assert [(r.id, r.error) for r in missing.collect()] == [("j2", "Item i9 not found")]


def test_dispatch(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz"), (4, None)], "id int, kind string")
    out, unknown = dispatch_by_kind(rows, {"a": lambda d: d.withColumn("x", F.lit(1)), "b": lambda d: d.withColumn("y", F.lit(2))})
    assert {r.id: (r.x, r.y) for r in out.collect()} == {1: (1, None), 2: (None, 2)}
    assert {r.id: r.error for r in unknown.collect()} == {3: "No handler registered for job kind: zz", 4: "No handler registered for job kind: "}


def test_dispatch_in_one_pass(spark):
    from pagelake.operators.jobs import dispatch_columns

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz"), (4, None)], "id int, kind string")
    out, unknown = dispatch_columns(rows, {"a": {"x": F.col("id") * 10}, "b": {"x": F.lit(7), "y": F.col("kind")}})
    assert {r.id: (r.x, r.y) for r in out.collect()} == {1: (10, None), 2: (7, "b")}
    assert {r.id: r.error for r in unknown.collect()} == {3: "No handler registered for job kind: zz", 4: "No handler registered for job kind: "}
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


# ------------------------------------------------------------ state from a log

def _walk(rows, state=None):
    """The same fold, one row at a time."""
    state = dict(state or {})
    for job, ts, _, action, owner, lease, error, next_run, backoff in sorted(rows, key=lambda r: (r[1], r[2])):
        if action == "enqueue":
            state.setdefault(job, dict(status="queued", run_at=ts, attempts=0, backoff_seconds=0, visibility_till=None, reserved_by=None, last_error=None))
        elif job in state:
            s = dict(state[job])
            until = ts + dt.timedelta(seconds=lease)
            if action == "claim":
                s.update(status="running", visibility_till=until, reserved_by=owner)
            elif action == "extend" and s["status"] == "running":
                s.update(visibility_till=until)
            elif action == "success":
                s.update(status="succeeded", visibility_till=None, reserved_by=None)
            elif action == "failure":
                s.update(status="queued" if next_run else "failed", attempts=s["attempts"] + 1, last_error=error,
                         run_at=next_run or s["run_at"], backoff_seconds=backoff, visibility_till=None, reserved_by=None)
            state[job] = s
    return state


def _random_log(seed, n=400, jobs=25):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        action = rnd.choice(["enqueue", "claim", "claim", "extend", "extend", "success", "failure", "failure"])
        ts = NOW + dt.timedelta(seconds=rnd.randrange(0, 4000))
        failed = action == "failure"
        again = failed and rnd.random() < 0.6
        rows.append((f"j{rnd.randrange(jobs)}", ts, i, action, f"w{i % 5}", rnd.choice([60, 300]), f"e{i}" if failed else None,
                     ts + dt.timedelta(seconds=i) if again else None, (i if again else 0) if failed else None))
    return sorted(rows, key=lambda r: (r[1], r[2]))


def _as_dict(df):
    return {r.job_id: {k: v for k, v in r.asDict().items() if k != "job_id"} for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_walk(spark, seed):
    rows = _random_log(seed)
    assert _as_dict(job_state_fold(spark.createDataFrame(rows, LOG))) == _walk(rows)


def test_fold_continues_from_a_state(spark):
    rows = _random_log(7, n=600)
    state = None
    for part in (rows[:150], rows[150:300], rows[300:310], rows[310:]):
        state = job_state_fold(spark.createDataFrame(part, LOG), state)
    assert _as_dict(state) == _walk(rows)


@pytest.mark.parametrize("cell", [10, 600, 86400])
def test_lease_gaps_equal_walk(spark, cell):
    rows = _random_log(11, n=500, jobs=12)
    end = NOW + dt.timedelta(seconds=3000)
    want, by_job = [], {}
    for r in rows:
        if r[3] != "enqueue":
            by_job.setdefault(r[0], []).append(r)
    for job, moves in by_job.items():
        running = False
        for r, nxt in zip(moves, moves[1:] + [None]):
            if r[3] != "extend":
                running = r[3] == "claim"
            until = r[1] + dt.timedelta(seconds=r[5])
            if running and until <= end and (nxt is None or nxt[1] > until):
                want.append((job, until))
    got = lease_gaps(spark.createDataFrame(rows, LOG), F.lit(end).cast("timestamp_ntz"), cell).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_fold_of_a_sound_log_joins_winners_only(spark):
    """Enqueues come first here, so no failure is early; the log meets the rows that decide on job and place, never on a hot job alone."""
    rows = [("j1", at(0), 0, "enqueue", "w", 300, None, None, None), ("j1", at(1), 1, "claim", "w", 300, None, None, None),
            ("j1", at(2), 2, "failure", "w", 300, "boom", at(9), 60), ("j1", at(3), 3, "extend", "w", 300, None, None, None)]
    folded = job_state_fold(spark.createDataFrame(rows, LOG))
    assert _as_dict(folded) == _walk(rows)
    joins = re.findall(r"\w+Join \[([^]]*)\]", folded._jdf.queryExecution().executedPlan().toString())
    scans = [keys for keys in joins if "at#" in keys]
    assert scans and all(keys.startswith("job_id#") for keys in scans)


def test_run_batch(spark):
    from pagelake.plans.work import run_batch

    rows = [
        ("ok", "good", "queued", at(-5), 0, 25, None, None, "old", at(-9)),
        ("bad", "poor", "queued", at(-4), 0, 25, None, None, None, at(-9)),
        ("last", "poor", "running", at(-3), 24, 25, at(-1), "w", None, at(-9)),
        ("odd", "nobody", "queued", at(-2), 0, 25, None, None, None, at(-9)),
        ("none", None, "queued", at(-6), 0, 25, None, None, None, at(-9)),
        ("wait", "good", "queued", at(9), 0, 25, None, None, None, at(-9)),
        ("over", "good", "queued", at(-1), 0, 25, None, None, None, at(-9)),
    ]
    jobs = spark.createDataFrame(rows, JOBS).withColumn("backoff_seconds", F.lit(0).cast("bigint"))
    handlers = {"good": lambda d: d.select("id", F.lit(None).cast("string").alias("error")), "poor": lambda d: d.select("id", F.lit("boom").alias("error"))}
    got = {r.id: r for r in run_batch(jobs, handlers, now(), 5, factor=F.lit(1.0)).collect()}
    assert {i: r.status for i, r in got.items()} == {
        "ok": "succeeded", "bad": "queued", "last": "failed", "odd": "failed", "none": "failed", "wait": "queued", "over": "queued"
    }
    assert (got["ok"].attempts, got["ok"].last_error, got["ok"].updated_at) == (0, "old", NOW)
    assert (got["bad"].attempts, got["bad"].backoff_seconds, got["bad"].run_at, got["bad"].last_error) == (1, 60, at(1), "boom")
    assert (got["last"].attempts, got["last"].visibility_till, got["last"].reserved_by, got["last"].run_at) == (25, None, None, at(-3))
    assert got["odd"].last_error == "Failed to create handler: No handler registered for job kind: nobody"
    assert got["over"].updated_at == at(-9) and got["wait"].updated_at == at(-9)


def test_extend_leases(spark):
    from pagelake.operators.jobs import extend_leases

    jobs = spark.createDataFrame(
        [("r", "running", None, dt.datetime(2024, 1, 1)), ("q", "queued", None, dt.datetime(2024, 1, 1)), ("s", None, None, None), ("t", "running", None, None)],
        "id string, status string, visibility_till timestamp, updated_at timestamp",
    )
    requests = spark.createDataFrame([("r", 60), ("r", 300), ("r", None), ("q", 60), ("s", 60), ("gone", 60), (None, 60), ("t", None)], "id string, lease_secs long")
    now = dt.datetime(2024, 1, 2)
    got = {r.id: (r.visibility_till, r.updated_at) for r in extend_leases(jobs, requests, F.lit(now)).collect()}
    assert got == {"r": (now + dt.timedelta(seconds=300), now), "q": (None, dt.datetime(2024, 1, 1)), "s": (None, None), "t": (None, None)}


def test_packed_order_of_extreme_rows(spark):
    """Times of any year and numbers of any sign keep the order of (ts, seq)."""
    from pagelake.operators.jobs import ACTIONS, packed_at

    times = [dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(9999, 12, 31)]
    rows = [(t, s, a) for t in times for s in (-(1 << 63), -1, 0, (1 << 63) - 1) for a in ("enqueue", "failure")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, seq long, action string")
    got = [tuple(r) for r in df.orderBy(packed_at(F.col("ts"), F.col("seq"), F.col("action"))).collect()]
    assert got == sorted(rows, key=lambda r: (r[0], r[1], ACTIONS[r[2]]))
