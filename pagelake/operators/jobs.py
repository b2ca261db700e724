"""Job-state tables: due sets, claims, retries, payloads, monitoring, state from a log."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.text import compute_once
from pagelake.functions.retry import backoff_seconds, jitter
from pagelake.session import cut_lineage
from pagelake.schemas import DEFAULT_BASE_BACKOFF_SECONDS, DEFAULT_LEASE_SECONDS, struct_of

# Payload fields per job kind; the first tuple is required.
PAYLOADS = {
    "example_job": ("message string, delay_ms bigint", ("message",)),
    "fetch_page": ("item_id string", ("item_id",)),
}


def seconds(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def lease_expired(as_of: Column) -> Column:
    return (F.col("status") == "running") & (F.col("visibility_till") < as_of)


def is_due(as_of: Column) -> Column:
    """Queued, or running past its lease; and run_at reached in both cases."""
    return ((F.col("status") == "queued") | lease_expired(as_of)) & (F.col("run_at") <= as_of)


def due_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.filter(is_due(as_of))


def due_batch(jobs: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The first due jobs by run_at, ties by id (one TakeOrderedAndProject)."""
    return due_jobs(jobs, as_of).orderBy("run_at", "id").limit(limit)


def claim_rows(
    jobs: DataFrame, as_of: Column, limit: int, owner: str, lease_secs: int = DEFAULT_LEASE_SECONDS
) -> DataFrame:
    """Job table after one worker claimed its batch; attempts stay as they are."""
    batch = due_batch(jobs.select("id", "status", "visibility_till", "run_at"), as_of, limit)
    marked = jobs.join(batch.select("id", F.lit(True).alias("_claimed")), "id", "left")
    hit = F.col("_claimed").isNotNull()
    new = {
        "status": F.lit("running"),
        "visibility_till": as_of + seconds(lease_secs),
        "reserved_by": F.lit(owner),
        "updated_at": as_of,
    }
    return marked.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns]
    )


def claimed_jobs(jobs: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """Rows of the claimed batch, by a semi join on the batch ids."""
    batch = due_batch(jobs.select("id", "status", "visibility_till", "run_at"), as_of, limit)
    return jobs.join(batch.select("id"), "id", "left_semi")


def lease_expiry(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Running jobs whose lease has passed, with the seconds since."""
    late = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("visibility_till").cast("timestamp"))) / 1e6
    return jobs.filter(lease_expired(as_of)).withColumn("overdue_seconds", late)


def lease_gaps(log: DataFrame, as_of: Column, cell_secs: int = 86400) -> DataFrame:
    """(job_id, expired_at) for every lease in a job log that ran out by ``as_of`` with no action in time.

    A claim opens a lease, an extension while running moves its end, success or
    failure closes it. What follows a row is looked up inside (job, cell of time)
    first; only the last row of a cell needs the first row of the job's next
    cell, and that lookup runs over one row per cell. An extension counts when
    the last claim, success or failure before it is a claim.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cell = (micros - F.pmod(micros, F.lit(cell_secs * 1_000_000))).alias("cell")
    rows = log.filter(F.col("action").isin("claim", "extend", "success", "failure"))
    rows = rows.select("job_id", "ts", "seq", "action", "lease_secs", cell)
    # per cell: its first row's time, and its last move (anything but an extension)
    move = F.when(F.col("action") != "extend", F.struct("ts", "seq", "action"))
    cells = rows.groupBy("job_id", "cell").agg(F.min("ts").alias("first_ts"), F.max(move).alias("last_move"))
    along = Window.partitionBy("job_id").orderBy("cell")
    cells = cells.select(
        "job_id", "cell",
        F.lead("first_ts").over(along).alias("cell_next"),
        F.last("last_move.action", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("cell_move"),
    )
    inside = Window.partitionBy("job_id", "cell").orderBy("ts", "seq")
    moved = F.when(F.col("action") != "extend", F.col("action"))
    rows = rows.withColumns(
        {"next_ts": F.lead("ts").over(inside), "state": F.last(moved, ignorenulls=True).over(inside)}
    ).join(cells, ["job_id", "cell"])
    running = F.coalesce("state", "cell_move") == "claim"
    until = F.col("ts") + seconds(F.col("lease_secs"))
    following = F.coalesce("next_ts", "cell_next")
    ran_out = (until <= as_of) & (following.isNull() | (following > until))
    return rows.filter(running & F.coalesce(ran_out, F.lit(False))).select("job_id", until.alias("expired_at"))


def dead_letter(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "failed")


def job_monitor(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs, retries, due jobs and the oldest due run_at per kind and status."""
    due = is_due(as_of)
    return jobs.groupBy("kind", "status").agg(
        F.count("*").alias("n_jobs"),
        F.count_if(F.col("attempts") > 0).alias("n_retried"),
        F.sum(F.col("attempts").cast("bigint")).alias("attempts"),
        F.count_if(due).alias("n_due"),
        F.min(F.when(due, F.col("run_at"))).alias("oldest_due"),
    )


def retry_plan(
    failed: DataFrame,
    as_of: Column,
    base_secs: int = DEFAULT_BASE_BACKOFF_SECONDS,
    known_kinds: tuple[str, ...] | None = None,
    factor: Column | None = None,
) -> DataFrame:
    """Next state of jobs whose attempt failed (id, kind, run_at, attempts, max_attempts).

    The delay uses the attempt that just failed, so the first retry waits twice
    the base. A kind without a handler fails for good at once.
    """
    attempt = F.col("attempts") + 1
    known = F.col("kind").isin(*known_kinds) if known_kinds is not None else F.lit(True)
    retry = known & (attempt < F.col("max_attempts"))
    factor = jitter(F.col("id"), attempt) if factor is None else factor
    planned = failed.withColumns({"_retry": retry, "_delay": backoff_seconds(attempt, base_secs, factor)})
    delay = F.when(F.col("_retry"), F.col("_delay")).otherwise(F.lit(0)).cast("bigint")
    return planned.withColumns(
        {
            "attempts": attempt,
            "status": F.when(F.col("_retry"), "queued").otherwise("failed"),
            "backoff_seconds": delay,
            "run_at": F.when(F.col("_retry"), as_of + seconds(F.col("_delay"))).otherwise(F.col("run_at")),
        }
    ).drop("_retry", "_delay")


def parse_payloads(jobs: DataFrame, kind: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good, malformed) jobs of one kind; good rows carry the payload as a typed struct ``data``.

    A missing or mistyped required field is malformed, more fields are fine.
    """
    fields, required = PAYLOADS[kind]
    schema = struct_of(fields)
    rows = compute_once(jobs.filter(F.col("kind") == kind), {"_doc": F.try_parse_json(payload)})
    found, broken = [], []
    for f in schema.fields:
        raw = F.try_variant_get("_doc", f"$.{f.name}", "variant")
        there = raw.isNotNull() & ~F.is_variant_null(raw)
        value = F.try_variant_get("_doc", f"$.{f.name}", f.dataType.simpleString())
        # a JSON string must not pass for a number, nor a fraction or a negative number for a count
        text = f.dataType == T.StringType()
        fits = (F.schema_of_variant(raw) == ("STRING" if text else "BIGINT")) & (F.lit(True) if text else value >= 0)
        found.append(F.when(fits, value).alias(f.name))
        wrong = there & ~F.coalesce(fits & value.isNotNull(), F.lit(False))
        broken.append((wrong | ~there) if f.name in required else wrong)
    bad = reduce(lambda a, b: a | b, broken)
    rows = compute_once(rows, {"data": F.struct(*found), "_bad": F.coalesce(bad, F.lit(True))}).drop("_doc")
    return rows.filter(~F.col("_bad")).drop("_bad"), rows.filter("_bad").drop("_bad", "data")


def attach_item_url(jobs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) for jobs with ``item_id``: found rows carry the item's url, missing ones an error."""
    urls = items.select(F.col("id").alias("item_id"), "url")
    joined = jobs.join(urls, "item_id", "left")
    found = joined.filter(F.col("url").isNotNull())
    missing = joined.filter(F.col("url").isNull()).drop("url")
    return found, missing.withColumn("error", F.concat(F.lit("Item "), F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit(" not found")))


def dispatch_by_kind(
    df: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "kind"
) -> tuple[DataFrame, DataFrame]:
    """(output of all handlers, rows of unknown kinds with an error).

    A handler is a DataFrame-to-DataFrame function; it sees only the rows of its
    kind, and Spark prunes by kind where the table is partitioned that way.
    """
    outputs = [handler(df.filter(F.col(kind) == name)) for name, handler in handlers.items()]
    unknown = df.filter(~F.coalesce(F.col(kind).isin(*handlers), F.lit(False))).withColumn(
        "error", F.concat(F.lit("No handler registered for job kind: "), F.coalesce(F.col(kind), F.lit("")))
    )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs), unknown


def dispatch_columns(
    df: DataFrame, handlers: dict[str, dict[str, Column]], kind: str = "kind"
) -> tuple[DataFrame, DataFrame]:
    """``dispatch_by_kind`` in one pass, for handlers that only add columns: kind -> new columns over the row.

    All kinds are worked on in one scan; a column that a kind does not have is NULL.
    """
    names = list(dict.fromkeys(name for columns in handlers.values() for name in columns))

    def chosen(name: str) -> Column:
        return F.coalesce(*[F.when(F.col(kind) == k, columns[name]) for k, columns in handlers.items() if name in columns]).alias(name)

    known = F.coalesce(F.col(kind).isin(*handlers), F.lit(False))
    error = F.concat(F.lit("No handler registered for job kind: "), F.coalesce(F.col(kind), F.lit("")))
    return df.filter(known).select("*", *[chosen(name) for name in names]), df.filter(~known).withColumn("error", error)


# ------------------------------------------------------------- state from a log

#: Codes of the actions in the packed order; the last three move a job.
ACTIONS = {"enqueue": 0, "extend": 1, "claim": 2, "success": 3, "failure": 4}


def packed_at(ts: Column, seq: Column, action: Column) -> Column:
    """(ts, seq) and the action's code as one number, in the order of (ts, seq), so that maxima are hash aggregates.

    Times of the years 1 to 9999 have less than 2**58 microseconds, so the number has at most 38 digits.
    """
    kind = "decimal(20,0)"
    micros = F.unix_micros(ts.cast("timestamp")).cast(kind)
    place = (micros * F.lit(Decimal(1 << 64)).cast(kind) + (seq.cast(kind) + F.lit(Decimal(1 << 63)).cast(kind))).cast("decimal(37,0)")
    code = F.element_at(F.create_map(*[F.lit(x) for item in ACTIONS.items() for x in item]), action)
    return (place * 8 + code).cast("decimal(38,0)")


def _place(packed: Column) -> Column:
    """The packed number without its action."""
    return packed - F.pmod(packed, F.lit(8))


def _log_rows(log: DataFrame) -> DataFrame:
    """The rows of a log that fold, with their packed number."""
    rows = log.filter(F.col("action").isin(*ACTIONS))
    return rows.withColumn("at", packed_at(F.col("ts"), F.col("seq"), F.col("action")))


def job_moves(rows: DataFrame) -> DataFrame:
    """One row per job of the log rows (with ``at``): what decides its state, in fixed-width columns.

    Every column is a minimum, a maximum, the value at one, or a count, so rows
    combine in any order, and in a hash aggregate before the shuffle.
    """
    action = F.col("action")
    failure, extended, claimed = action == "failure", action == "extend", action == "claim"
    moved = failure & F.col("next_run_at").isNotNull()

    def newest(value: str, condition: Column) -> Column:
        return F.max_by(value, F.when(condition, F.col("at")))

    return rows.groupBy("job_id").agg(
        F.min(F.when(action == "enqueue", F.col("at"))).alias("born"),
        F.min_by("ts", F.when(action == "enqueue", F.col("at"))).alias("born_ts"),
        F.max(F.when(action.isin("claim", "success", "failure"), F.col("at"))).alias("last"),
        F.max(F.when(claimed, F.col("at"))).alias("claim"),
        newest("ts", claimed).alias("claim_ts"),
        newest("lease_secs", claimed).alias("claim_secs"),
        F.max(F.when(extended, F.col("at"))).alias("ext"),
        newest("ts", extended).alias("ext_ts"),
        newest("lease_secs", extended).alias("ext_secs"),
        F.max(F.when(failure, F.col("at"))).alias("fail"),
        newest("backoff_seconds", failure).alias("fail_backoff"),
        newest("next_run_at", failure).alias("fail_next"),
        F.max(F.when(moved, F.col("at"))).alias("moved"),
        newest("next_run_at", moved).alias("moved_next"),
        F.count_if(failure).alias("failures"),
        F.min(F.when(failure, F.col("at"))).alias("first_failure"),
    )


def _texts(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """(job_id, owner, error) of the claim and the failure that decide a job.

    The log meets the winners on (job_id, at), so a hot job's rows lie in many tasks.
    """
    wanted = moves.select("job_id", F.explode(F.array_compact(F.array(F.when(F.col("claim") == F.col("last"), F.col("claim")), "fail"))).alias("at"))
    texts = rows.filter(F.col("action").isin("claim", "failure")).select("job_id", "at", "owner", "error")
    found = texts.join(wanted, ["job_id", "at"], "left_semi")  # two rows of a job, but for repeated ones
    claimed, job = F.pmod(F.col("at"), F.lit(8)) == ACTIONS["claim"], Window.partitionBy("job_id")
    named = found.select(
        "job_id", F.max(F.when(claimed, F.col("owner"))).over(job).alias("owner"), F.max(F.when(~claimed, F.col("error"))).over(job).alias("error"),
        F.row_number().over(job.orderBy("at")).alias("_n"),
    )
    return named.filter("_n = 1").drop("_n")


def job_state_fold(log: DataFrame, initial: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """Current row of every job from its log of enqueue, claim, extend, success and failure.

    Rows are ordered by (ts, seq). Actions before a job's enqueue touch nothing,
    a second enqueue of the same id adds nothing, and no action checks the owner.
    ``initial`` is an earlier result, to which the log is then added.

    The fold is one hash aggregate over packed numbers that combines before the
    shuffle, so a job that holds a third of the log is one row per task: status
    and lease come from the last claim, success or failure; an extension counts
    only if it is later than a claim that nothing has followed; attempts is a
    count; run_at is the last next_run_at given. All but the count are void when
    they are older than the enqueue. Owner and error are joined in for the rows
    that decide. Failures older than the enqueue, which a sound log does not
    have, are counted apart and taken off.
    """
    rows = _log_rows(log)
    moves = job_moves(rows)
    ts_type = log.schema["ts"].dataType
    fields = {
        "status": F.lit("queued"), "run_at": F.col("born_ts"), "attempts": F.lit(0).cast("bigint"),
        "backoff_seconds": F.lit(0).cast("bigint"), "visibility_till": F.lit(None).cast(ts_type),
        "reserved_by": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string"),
    }
    if initial is not None:
        known = initial.select("job_id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_known"))
        moves = moves.join(known, "job_id", "full_outer").withColumn("born", F.when(F.col("_known").isNull(), F.col("born")))
        new = F.col("_known").isNull()
        fields = {c: F.when(new, v).otherwise(F.col(f"_{c}")) for c, v in fields.items()}
        moves = moves.filter(~new | F.col("born").isNotNull())
    else:
        moves = moves.filter(F.col("born").isNotNull())
    moves = cut_lineage(moves.withColumns(fields))

    early = moves.filter(F.col("first_failure") < F.col("born")).select("job_id", "born")
    if early.isEmpty():
        void = F.lit(0)
    else:
        # the early side has one row per job, repeated per salt, so that a hot job's failures meet it in many tasks
        early = early.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        failures = rows.filter(F.col("action") == "failure").select("job_id", "at", F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int").alias("salt"))
        counted = failures.join(early, ["job_id", "salt"]).filter(F.col("at") < F.col("born"))
        moves = moves.join(counted.groupBy("job_id").agg(F.count("*").alias("void")), "job_id", "left")
        void = F.coalesce(F.col("void"), F.lit(0))

    def valid(name: str) -> Column:
        return F.col(name).isNotNull() & (F.col("born").isNull() | (F.col(name) > F.col("born")))

    state = moves.join(_texts(rows, moves.select("job_id", "claim", "last", "fail")), "job_id", "left")
    state = state.withColumns({
        "_moved": valid("last"), "_claimed": valid("last") & (F.col("last") == F.col("claim")), "_extends": valid("ext"), "_failed": valid("fail"),
    })
    # with no move in this log the stored status decides whether an extension counts
    running = F.when(F.col("_moved"), F.col("_claimed")).otherwise(F.col("status") == "running")
    own_lease = F.when(~F.col("_moved"), F.col("visibility_till")).when(F.col("_claimed"), F.col("claim_ts") + seconds(F.col("claim_secs")))
    extended = running & F.col("_extends") & (~F.col("_moved") | (_place(F.col("ext")) > _place(F.col("last"))))
    status = (
        F.when(~F.col("_moved"), F.col("status"))
        .when(F.col("_claimed"), "running")
        .when(F.pmod(F.col("last"), F.lit(8)) == ACTIONS["success"], "succeeded")
        .when(F.col("fail_next").isNotNull(), "queued")
        .otherwise("failed")
    )
    return state.select(
        "job_id",
        status.alias("status"),
        F.coalesce(F.when(valid("moved"), F.col("moved_next")), F.col("run_at")).alias("run_at"),
        (F.col("attempts") + F.coalesce("failures", F.lit(0)) - void).alias("attempts"),
        F.coalesce(F.when(F.col("_failed"), F.col("fail_backoff")).cast("bigint"), F.col("backoff_seconds")).alias("backoff_seconds"),
        F.when(extended, F.col("ext_ts") + seconds(F.col("ext_secs"))).otherwise(own_lease).alias("visibility_till"),
        F.when(~F.col("_moved"), F.col("reserved_by")).when(F.col("_claimed"), F.col("owner")).alias("reserved_by"),
        F.when(F.col("_failed"), F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def extend_leases(jobs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Job table after lease extensions (id, lease_secs): running jobs get a lease from ``as_of``, and updated_at.

    Requests for jobs in another state, or for no job, touch nothing; of several
    for one job the longest counts.
    """
    longest = requests.filter(F.col("lease_secs").isNotNull()).groupBy("id").agg(F.max("lease_secs").alias("_secs"))
    joined = jobs.join(longest, "id", "left")
    hit = F.col("_secs").isNotNull() & F.coalesce(F.col("status") == "running", F.lit(False))
    new = {"visibility_till": as_of + seconds(F.col("_secs")), "updated_at": as_of}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])
