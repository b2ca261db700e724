"""Registered queries over job tables, job logs, request logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions.retry import backoff_bounds, backoff_seconds, next_run_at
from pagelake.operators.jobs import (
    attach_item_url, claim_rows, claimed_jobs, dead_letter, dispatch_by_kind, dispatch_columns, due_batch, due_jobs, extend_leases,
    job_monitor, job_state_fold, lease_expiry, lease_gaps, parse_payloads, retry_plan,
)
from pagelake.operators.language import language_profiles
from pagelake.operators.limits import rate_limit, rate_limit_usage
from pagelake.plans import sqltext as S
from pagelake.plans.crawl_queries import GRAMS_SQL, MAIN_SQL, language_sql
from pagelake.plans.work import run_batch
from pagelake.session import cut_lineage, work_path
from pagelake.sources import fixtures as X
from pagelake.sources.contents import read_contents
from pagelake.sources.tables import read_fixture, read_texts
from pagelake.streaming.jobs import read_jobs, stream_extract, stream_job_state, stream_lease_expiry, stream_rate_limit

QUERIES = {}

NOW_SQL = f"timestamp '{X.AS_OF}'"
DUE_SQL = f"((status = 'queued' or (status = 'running' and visibility_till < {NOW_SQL})) and run_at <= {NOW_SQL})"
BATCH = 100
WINDOW_SECS, MAX_REQUESTS = 21600, 3


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


# ------------------------------------------------------------------ due, claim

@query("due_jobs", f"with {X.JOBS_SQL} select id, status, run_at, visibility_till from jobs where {DUE_SQL}")
def due(spark, d):
    return due_jobs(X.jobs(spark, d), X.as_of()).select("id", "status", "run_at", "visibility_till")


@query("due_batch", f"with {X.JOBS_SQL} select id, kind, status, run_at from jobs where {DUE_SQL} order by run_at, id limit {BATCH}")
def batch(spark, d):
    return due_batch(X.jobs(spark, d), X.as_of(), BATCH).select("id", "kind", "status", "run_at")


@query(
    "claim_semi",
    f"with {X.JOBS_SQL} select id, kind, attempts, last_error from jobs where id in (select id from jobs where {DUE_SQL} order by run_at, id limit {BATCH})",
)
def claimed(spark, d):
    return claimed_jobs(X.jobs(spark, d), X.as_of(), BATCH).select("id", "kind", "attempts", "last_error")


@query(
    "claim_rows",
    f"""with {X.JOBS_SQL}, b as (select id from jobs where {DUE_SQL} order by run_at, id limit {BATCH}),
    m as (select *, id in (select id from b) as hit from jobs)
    select id, attempts, case when hit then 'running' else status end as status,
      case when hit then {NOW_SQL} + to_seconds(300) else visibility_till end as visibility_till,
      case when hit then 'me' else reserved_by end as reserved_by, case when hit then {NOW_SQL} else updated_at end as updated_at from m""",
)
def claim(spark, d):
    return claim_rows(X.jobs(spark, d), X.as_of(), BATCH, "me").select(
        "id", "attempts", "status", "visibility_till", "reserved_by", "updated_at"
    )


@query(
    "extend_leases",
    f"""with {X.JOBS_SQL}, r as (select cast(l_orderkey as varchar) as id, max(60 * l_linenumber) as secs from lineitem where l_returnflag = 'R' group by l_orderkey)
    select jobs.id, status, case when r.id is not null and status = 'running' then {NOW_SQL} + to_seconds(secs) else visibility_till end as visibility_till,
      case when r.id is not null and status = 'running' then {NOW_SQL} else updated_at end as updated_at from jobs left join r on jobs.id = r.id""",
)
def extended(spark, d):
    requests = read_fixture(spark, d, "lineitem").filter("l_returnflag = 'R'").selectExpr("cast(l_orderkey as string) as id", "cast(60 * l_linenumber as bigint) as lease_secs")
    return extend_leases(X.jobs(spark, d), requests, X.as_of()).select("id", "status", "visibility_till", "updated_at")


@query(
    "job_monitor",
    f"""with {X.JOBS_SQL} select kind, status, count(*) as n_jobs, cast(count_if(attempts > 0) as bigint) as n_retried, cast(sum(attempts) as bigint) as attempts,
      cast(count_if({DUE_SQL}) as bigint) as n_due, min(case when {DUE_SQL} then run_at end) as oldest_due from jobs group by kind, status""",
)
def monitor(spark, d):
    return job_monitor(X.jobs(spark, d), X.as_of())


@query("dead_letter", f"with {X.JOBS_SQL} select id, kind, attempts, last_error from jobs where status = 'failed'")
def dead(spark, d):
    return dead_letter(X.jobs(spark, d)).select("id", "kind", "attempts", "last_error")


@query(
    "lease_expiry",
    f"""with {X.JOBS_SQL} select id, reserved_by, epoch_us({NOW_SQL}) / 1e6 - epoch_us(visibility_till) / 1e6 as overdue_seconds
    from jobs where status = 'running' and visibility_till < {NOW_SQL}""",
)
def expired(spark, d):
    return lease_expiry(X.jobs(spark, d), X.as_of()).select("id", "reserved_by", "overdue_seconds")


# --------------------------------------------------------------------- retries

DELAY_SQL = "30::bigint * (1 << cast(least(greatest({a}, 0), 10) as integer))"


@query(
    "backoff_bounds",
    f"""with {X.JOBS_SQL} select id, attempts, cast(round({DELAY_SQL.format(a='attempts')} * 0.7::double) as bigint) as lo,
      cast(round({DELAY_SQL.format(a='attempts')} * 1.3::double) as bigint) as hi from jobs""",
)
def bounds(spark, d):
    lo, hi = backoff_bounds(F.col("attempts"), 30)
    return X.jobs(spark, d).select("id", "attempts", lo.alias("lo"), hi.alias("hi"))


@query(
    "backoff_seconds",
    f"""with {X.JOBS_SQL} select id, {DELAY_SQL.format(a='attempts')} as plain, true as in_bounds from jobs""",
)
def delays(spark, d):
    from pagelake.functions.retry import jitter

    lo, hi = backoff_bounds(F.col("attempts"), 30)
    real = backoff_seconds(F.col("attempts"), 30, jitter(F.col("id"), F.col("attempts")))
    return X.jobs(spark, d).select(
        "id", backoff_seconds(F.col("attempts"), 30, F.lit(1.0)).alias("plain"), real.between(lo, hi).alias("in_bounds")
    )


@query(
    "next_run_at",
    f"with {X.JOBS_SQL} select id, case when attempts < 25 then {NOW_SQL} + to_seconds({DELAY_SQL.format(a='attempts')}) else run_at end as next_run_at from jobs",
)
def next_runs(spark, d):
    delay = F.when(F.col("attempts") < 25, backoff_seconds(F.col("attempts"), 30, F.lit(1.0)))
    return X.jobs(spark, d).select("id", next_run_at(F.col("run_at"), X.as_of(), delay).alias("next_run_at"))


@query(
    "retry_plan",
    f"""with {X.JOBS_SQL}, p as (select *, attempts + 1 as attempt, kind in ('fetch_page', 'example_job') and attempts + 1 < max_attempts as again from jobs)
    select id, attempt as attempts, case when again then 'queued' else 'failed' end as status,
      case when again then {DELAY_SQL.format(a='attempt')} else 0 end as backoff_seconds,
      case when again then {NOW_SQL} + to_seconds({DELAY_SQL.format(a='attempt')}) else run_at end as run_at from p""",
)
def retries(spark, d):
    """With the jitter factor held at 1, so that SQL can give the same delay."""
    planned = retry_plan(X.jobs(spark, d), X.as_of(), 30, ("fetch_page", "example_job"), factor=F.lit(1.0))
    return planned.select("id", "attempts", "status", "backoff_seconds", "run_at")


# -------------------------------------------------------------------- payloads

PAYLOAD = """case event_type when 'click' then concat('{"message": "m', k, '", "delay_ms": ', k, '}')
  when 'view' then concat('{"message": "m', k, '", "extra": [', k, ']}') when 'signup' then '{"invalid": "payload"}'
  when 'error' then concat('{"message": ', k, '}') else concat('{"message": "m", "delay_ms": "', k, '"}') end"""
PAYLOADS_SQL = f"""j as (select event_id as id, 'example_job' as kind, event_type, k, {PAYLOAD} as payload
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)),
typed as (select *, json_type(payload, '$.message') as mt, json_type(payload, '$.delay_ms') as dt from j),
judged as (select *, coalesce(mt = 'VARCHAR' and (dt is null or dt in ('UBIGINT', 'BIGINT', 'NULL')), false) as good from typed)"""


def _payload_jobs(spark, d):
    events = X.with_k(read_fixture(spark, d, "events"))
    return events.selectExpr("event_id as id", "'example_job' as kind", "event_type", "k", f"{PAYLOAD} as payload")


@query(
    "parse_payloads",
    f"""with {PAYLOADS_SQL} select id, json_extract_string(payload, '$.message') as message, cast(json_extract_string(payload, '$.delay_ms') as bigint) as delay_ms
    from judged where good""",
)
def payloads(spark, d):
    good, _ = parse_payloads(_payload_jobs(spark, d), "example_job")
    return good.select("id", "data.message", "data.delay_ms")


@query("parse_payloads_malformed", f"with {PAYLOADS_SQL} select id, payload from judged where not good")
def malformed(spark, d):
    _, bad = parse_payloads(_payload_jobs(spark, d), "example_job")
    return bad.select("id", "payload")


def _fetch_jobs(spark, d):
    return read_fixture(spark, d, "orders").selectExpr("o_orderkey as id", "cast(o_custkey as string) as item_id")


def _url_items(spark, d):
    return read_fixture(spark, d, "pages").selectExpr("cast(page_id as string) as id", "url")


@query(
    "attach_item_url",
    "select o_orderkey as id, cast(o_custkey as varchar) as item_id, url from orders join pages on page_id = o_custkey",
)
def attached(spark, d):
    return attach_item_url(_fetch_jobs(spark, d), _url_items(spark, d))[0].select("id", "item_id", "url")


@query(
    "attach_item_url_missing",
    "select o_orderkey as id, 'Item ' || o_custkey || ' not found' as error from orders where o_custkey not in (select page_id from pages)",
)
def unattached(spark, d):
    return attach_item_url(_fetch_jobs(spark, d), _url_items(spark, d))[1].select("id", "error")


def _dispatched(spark, d):
    jobs = X.jobs(spark, d)
    handlers = {
        "fetch_page": lambda df: df.select("id", F.concat(F.lit("fetch "), "status").alias("result")),
        "example_job": lambda df: df.select("id", F.concat(F.lit("message "), F.col("attempts").cast("string")).alias("result")),
    }
    return dispatch_by_kind(jobs, handlers)


@query(
    "dispatch_by_kind",
    f"""with {X.JOBS_SQL} select id, case kind when 'fetch_page' then 'fetch ' || status else 'message ' || attempts end as result
    from jobs where kind in ('fetch_page', 'example_job')""",
)
def dispatched(spark, d):
    return _dispatched(spark, d)[0]


@query(
    "dispatch_columns",
    f"""with {X.JOBS_SQL} select id, case kind when 'fetch_page' then 'fetch ' || status else 'message ' || attempts end as result
    from jobs where kind in ('fetch_page', 'example_job')""",
)
def dispatched_in_one_pass(spark, d):
    handlers = {"fetch_page": {"result": F.concat(F.lit("fetch "), "status")}, "example_job": {"result": F.concat(F.lit("message "), F.col("attempts").cast("string"))}}
    return dispatch_columns(X.jobs(spark, d), handlers)[0].select("id", "result")


@query(
    "dispatch_by_kind_unknown",
    f"with {X.JOBS_SQL} select id, 'No handler registered for job kind: ' || kind as error from jobs where kind not in ('fetch_page', 'example_job')",
)
def undispatched(spark, d):
    return _dispatched(spark, d)[1].select("id", "error")


RUN_LIMIT = 5000


@query(
    "run_batch",
    f"""with {X.JOBS_SQL}, b as (select * from jobs where {DUE_SQL} order by run_at, id limit {RUN_LIMIT}),
    o as (select *, attempts + 1 as attempt, case kind when 'fetch_page' then case when reserved_by is not null then 'lease of ' || reserved_by || ' ran out' end
        when 'example_job' then case when attempts > 20 then 'too many attempts' end
        else 'Failed to create handler: No handler registered for job kind: ' || kind end as error from b),
    n as (select *, error is not null and kind <> 'reindex_item' and attempt < max_attempts as again from o)
    select j.id, case when n.id is null then j.status when n.error is null then 'succeeded' when again then 'queued' else 'failed' end as status,
      case when again then {NOW_SQL} + to_seconds({DELAY_SQL.format(a='attempt')}) else j.run_at end as run_at,
      case when n.error is not null then attempt else j.attempts end as attempts,
      case when n.error is null then j.backoff_seconds when again then {DELAY_SQL.format(a='attempt')} else 0 end as backoff_seconds,
      case when n.id is null then j.visibility_till end as visibility_till, case when n.id is null then j.reserved_by end as reserved_by,
      coalesce(n.error, j.last_error) as last_error
    from jobs j left join n on n.id = j.id""",
)
def worked(spark, d):
    """A due batch with one failing and one mostly working handler, and a kind that nobody handles."""
    handlers = {
        "fetch_page": lambda df: df.select(
            "id", F.when(F.col("reserved_by").isNotNull(), F.concat(F.lit("lease of "), "reserved_by", F.lit(" ran out"))).alias("error")
        ),
        "example_job": lambda df: df.select("id", F.when(F.col("attempts") > 20, "too many attempts").alias("error")),
    }
    out = run_batch(X.jobs(spark, d), handlers, X.as_of(), RUN_LIMIT, factor=F.lit(1.0))
    return out.select("id", "status", "run_at", "attempts", "backoff_seconds", "visibility_till", "reserved_by", "last_error")


# ------------------------------------------------------------- state from a log

FOLD_SQL = f"""with {X.LOG_SQL}, o as (select *, row_number() over (partition by job_id order by ts, seq) as n from log),
born as (select job_id, min(n) as n0, arg_min(ts, n) as ts0 from o where action = 'enqueue' group by job_id),
live as (select o.*, n0 from o join born using (job_id) where n > n0 and action <> 'enqueue'),
marks as (select job_id, max(case when action in ('claim', 'success', 'failure') then n end) as last_n,
  max(case when action = 'extend' then n end) as ext_n, max(case when action = 'failure' then n end) as fail_n,
  max(case when action = 'failure' and next_run_at is not null then n end) as moved_n, count_if(action = 'failure') as failures from live group by job_id)
select b.job_id,
  case when l.action is null then 'queued' when l.action = 'claim' then 'running' when l.action = 'success' then 'succeeded'
       when l.next_run_at is not null then 'queued' else 'failed' end as status,
  coalesce(m.next_run_at, b.ts0) as run_at, cast(coalesce(failures, 0) as bigint) as attempts, coalesce(f.backoff_seconds, 0) as backoff_seconds,
  case when l.action = 'claim' then case when ext_n > last_n then e.ts + to_seconds(e.lease_secs) else l.ts + to_seconds(l.lease_secs) end end as visibility_till,
  case when l.action = 'claim' then l.owner end as reserved_by, f.error as last_error
from born b left join marks k using (job_id)
left join o l on l.job_id = b.job_id and l.n = last_n left join o e on e.job_id = b.job_id and e.n = ext_n
left join o f on f.job_id = b.job_id and f.n = fail_n left join o m on m.job_id = b.job_id and m.n = moved_n"""


@query("job_state_fold", FOLD_SQL)
def folded(spark, d):
    return job_state_fold(X.job_log(X.with_k(read_fixture(spark, d, "events"))))


def _arriving(spark, df, batch, name, n=4):
    """``df`` as a stream whose files arrive in ``n`` lots, one for each value of ``batch`` (0 to n - 1), in their order.

    Gives the stream again after each lot; a query on the same checkpoint that runs until nothing is left takes the lot as
    one micro-batch. A lot has as many files as ``df`` has partitions, so no task reads or writes a whole lot.
    """
    path, dealt = work_path(spark, name), df.withColumn("_batch", batch)
    for i in range(n):
        dealt.filter(F.col("_batch") == i).drop("_batch").write.mode("append").parquet(path)
        yield spark.readStream.schema(df.schema).parquet(path)


def _quarter(ts, end, start):
    """Which quarter of the time from start to end holds ts, 0 to 3."""
    share = (F.unix_micros(ts.cast("timestamp")) - start) * 4 / (end - start + 1)
    return F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(3)).cast("int")


def _event_stream(spark, d, late_secs=0):
    """The events table as a stream of four lots by time, after each of them; rows come up to ``late_secs`` out of order, and by hash inside a batch."""
    events = read_fixture(spark, d, "events")
    start, end = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    delay = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(late_secs + 1)).cast("decimal(18,6)"))
    batch = _quarter(F.col("ts") + delay, end or 0, start or 0)
    return _arriving(spark, events.sortWithinPartitions(F.xxhash64("event_id", F.lit(1))), batch, "events")


@query("stream_job_state", FOLD_SQL)
def streamed_state(spark, d):
    base = work_path(spark, "job-state")
    for events in _event_stream(spark, d, 30 * 86400):
        stream_job_state(X.job_log(X.with_k(events)), base).awaitTermination()
    return read_jobs(spark, base)


LOG_END = "2024-02-15 00:00:00"


def gaps_sql(condition: str) -> str:
    """Leases of the log that ran out, under a condition on until and next_ts."""
    return f"""with {X.LOG_SQL}, r as (select * from log where action <> 'enqueue'),
    s as (select *, ts + to_seconds(lease_secs) as until, lead(ts) over w as next_ts,
        last_value(case when action <> 'extend' then action end ignore nulls) over w as state
      from r window w as (partition by job_id order by ts, seq))
    select job_id, until as expired_at from s where state = 'claim' and {condition}"""


@query("lease_gaps", gaps_sql(f"until <= timestamp '{LOG_END}' and (next_ts is null or next_ts > until)"))
def gaps(spark, d):
    return lease_gaps(X.job_log(X.with_k(read_fixture(spark, d, "events"))), X.as_of(LOG_END))


# a lease is reported when the stream's clock passes its end: the newest row less an hour
@query(
    "stream_lease_expiry",
    gaps_sql("until <= (select max(ts) - interval 1 hour from log) and (next_ts is null or next_ts > until)"),
)
def streamed_leases(spark, d):
    base = work_path(spark, "leases")
    for events in _event_stream(spark, d, 3000):
        stream_lease_expiry(X.job_log(X.with_k(events)), base).awaitTermination()
    return spark.read.parquet(f"{base}/expired").select("job_id", "expired_at")


# -------------------------------------------------------------------- limiter

LIMIT_SQL = f"""with recursive starts as (
  select user_id, min(ts) as window_start from events group by user_id
  union all
  select s.user_id, min(e.ts) from starts s join events e on e.user_id = s.user_id and e.ts >= s.window_start + to_seconds({WINDOW_SECS})
  group by s.user_id),
placed as (select e.event_id, e.user_id, e.ts, s.window_start from events e asof join starts s on s.user_id = e.user_id and e.ts >= s.window_start),
counted as (select event_id, user_id, window_start, row_number() over (partition by user_id, window_start order by ts, event_id) as window_count from placed),
limited as (select *, window_count <= {MAX_REQUESTS} as allowed from counted)"""


def _limited(spark, d):
    return rate_limit(read_fixture(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", MAX_REQUESTS, WINDOW_SECS)


@query("rate_limit", LIMIT_SQL + " select event_id, user_id, window_start, window_count, allowed from limited")
def limited(spark, d):
    return _limited(spark, d).select("event_id", "user_id", "window_start", "window_count", "allowed")


@query(
    "rate_limit_usage",
    LIMIT_SQL + " select user_id, count(*) as n_requests, cast(count_if(not allowed) as bigint) as n_blocked, cast(count_if(window_count = 1) as bigint) as n_windows, max(window_count) as max_count from limited group by user_id",
)
def usage(spark, d):
    return rate_limit_usage(_limited(spark, d), "user_id")


@query("stream_rate_limit", LIMIT_SQL + " select event_id, user_id, window_count, allowed from limited")
def streamed_limits(spark, d):
    base = work_path(spark, "limits")
    for events in _event_stream(spark, d):
        stream_rate_limit(events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", MAX_REQUESTS, WINDOW_SECS, base).awaitTermination()
    return spark.read.parquet(f"{base}/decisions").select("event_id", "user_id", "window_count", "allowed")


# ------------------------------------------------------------------ extraction

@query(
    "stream_extract",
    f"""with {GRAMS_SQL}, parts as (select page_id as id, {S.title('html')} as title, {S.normalize(MAIN_SQL)} as text from pages),
    given as (select id, text from parts where title is not null and {S.trim('text')} <> '' and ({S.reject_reason('title', 'text')}) is null), {language_sql('given')}
    select cast(g.id as varchar) as item_id, g.text as clean_text, case when s.confidence >= 0.25 then s.lang end as lang,
      timestamp '2024-01-01 00:00:00' as extracted_at, true as has_checksum from given g join scored s using (id)""",
)
def streamed_pages(spark, d):
    base = work_path(spark, "extract")
    profiles = cut_lineage(language_profiles(read_texts(spark, d, "documents")))  # asked for by every micro-batch
    for pages in _arriving(spark, read_texts(spark, d, "pages"), F.pmod(F.hash("page_id"), F.lit(3)), "pages", 3):
        pages = pages.selectExpr("cast(page_id as string) as item_id", "url", "html", "timestamp'2024-01-01 00:00:00' as fetched_at")
        stream_extract(pages, base, profiles=profiles).awaitTermination()
    return read_contents(spark, f"{base}/contents").select(
        "item_id", "clean_text", "lang", F.col("extracted_at").cast("timestamp_ntz").alias("extracted_at"),
        (F.col("checksum") == F.md5(F.concat("clean_html", "clean_text"))).alias("has_checksum"),
    )
