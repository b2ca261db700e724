"""Retry delay columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exponent cap, jitter range, largest base delay before jitter.
MAX_EXPONENT = 10
JITTER_LOW, JITTER_HIGH = 0.7, 1.3
MAX_DELAY = 2**32 - 1


def base_delay(attempt: Column, base_seconds: Column | int) -> Column:
    """base * 2^attempt with the attempt held in 0..10, saturating."""
    base = base_seconds if isinstance(base_seconds, Column) else F.lit(base_seconds)
    capped = F.least(F.greatest(attempt, F.lit(0)), F.lit(MAX_EXPONENT)).cast("int")
    return F.least(base.cast("bigint") * F.pow(F.lit(2.0), capped).cast("bigint"), F.lit(MAX_DELAY))


def backoff_bounds(attempt: Column, base_seconds: Column | int) -> tuple[Column, Column]:
    """Smallest and largest delay that jitter can give, in seconds."""
    delay = base_delay(attempt, base_seconds).cast("double")
    return F.round(delay * JITTER_LOW).cast("bigint"), F.round(delay * JITTER_HIGH).cast("bigint")


def jitter(key: Column, attempt: Column) -> Column:
    """Replayable factor in [0.7, 1.3) from the job key and the attempt number."""
    unit = F.pmod(F.xxhash64(key, attempt), F.lit(1_000_000)).cast("double") / 1_000_000
    return F.lit(JITTER_LOW) + unit * (JITTER_HIGH - JITTER_LOW)


def backoff_seconds(attempt: Column, base_seconds: Column | int, factor: Column) -> Column:
    """Delay before the next attempt in whole seconds."""
    return F.round(base_delay(attempt, base_seconds).cast("double") * factor).cast("bigint")


def next_run_at(run_at: Column, now: Column, delay: Column) -> Column:
    """now + delay; the old run_at where there is no delay."""
    return F.coalesce(now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay.cast("decimal(18,6)")), run_at)
