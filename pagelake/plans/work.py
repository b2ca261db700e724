"""One round of job work as a table step: claim, dispatch, record success, retry or failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.jobs import claimed_jobs, dispatch_by_kind, retry_plan
from pagelake.session import cut_lineage
from pagelake.schemas import DEFAULT_BASE_BACKOFF_SECONDS

Handler = Callable[[DataFrame], DataFrame]


def run_batch(
    jobs: DataFrame,
    handlers: dict[str, Handler],
    as_of: Column,
    limit: int,
    base_secs: int = DEFAULT_BASE_BACKOFF_SECONDS,
    factor: Column | None = None,
) -> DataFrame:
    """Job table after the due batch was worked on.

    A handler gets the claimed jobs of its kind and returns (id, error), with a
    NULL error for success. A failed job is queued again with its delay while it
    has attempts left. A kind without a handler fails at once. Done and failed
    jobs lose their lease; jobs outside the batch stay as they are.
    """
    claimed = cut_lineage(claimed_jobs(jobs, as_of, limit))  # at most ``limit`` rows, read several times below
    outcomes, unknown = dispatch_by_kind(claimed, handlers)
    lost = unknown.select("id", F.concat(F.lit("Failed to create handler: "), "error").alias("error"), F.lit(False).alias("ok"))
    errors = cut_lineage(outcomes.select("id", "error", F.isnull("error").alias("ok")).unionByName(lost))  # a handler runs once

    failed = claimed.select("id", "kind", "run_at", "attempts", "max_attempts").join(errors.filter("not ok").drop("ok"), "id")
    planned = retry_plan(failed, as_of, base_secs, tuple(handlers), factor)
    done = claimed.select("id", "kind", "run_at", "attempts", "max_attempts", "backoff_seconds")
    done = done.join(errors.filter("ok").select("id"), "id", "left_semi").withColumns(
        {"status": F.lit("succeeded"), "error": F.lit(None).cast("string")}
    )
    columns = ["status", "run_at", "attempts", "backoff_seconds", "error"]
    news = planned.select("id", *columns).unionByName(done.select("id", *columns))
    news = news.select("id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    new = {
        "status": F.col("_status"), "run_at": F.col("_run_at"), "attempts": F.col("_attempts"),
        "backoff_seconds": F.col("_backoff_seconds"), "last_error": F.coalesce("_error", "last_error"),
        "visibility_till": F.lit(None), "reserved_by": F.lit(None), "updated_at": as_of,
    }
    merged = jobs.join(news, "id", "left")
    return merged.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns]
    )
