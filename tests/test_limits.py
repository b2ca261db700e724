import datetime as dt
import random

import numpy as np
import pytest

from pagelake.operators.limits import _transfer, limiter_state, rate_limit, rate_limit_usage

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp"


def walk(rows, limit, width, state=None):
    """The counter, one event at a time."""
    state = dict(state or {})
    out = {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        start, count = state.get(key, (ts, 0))
        if (ts - start).total_seconds() >= width:
            start, count = ts, 0
        count += 1
        state[key] = (start, count)
        out[i] = (start, count, count <= limit)
    return out, state


def run(spark, rows, limit, width, ranges=None, state=None):
    events = spark.createDataFrame(rows, SCHEMA)
    return rate_limit(events, "key", "ts", "id", limit, width, state, ranges)


def as_dict(limited):
    return {r.id: (r.window_start, r.window_count, r.allowed) for r in limited.collect()}


def sec(s):
    return T0 + dt.timedelta(seconds=s)


def test_edges(spark):
    rows = [(1, "a", sec(0)), (2, "a", sec(1)), (3, "a", sec(2)), (4, "a", sec(59.999999)), (5, "a", sec(60)), (6, "a", sec(119)),
            (7, "a", sec(120.5)), (8, "b", sec(0)), (9, "a", sec(2))]
    got = as_dict(run(spark, rows, 3, 60))
    assert got == walk(rows, 3, 60)[0]
    assert got[3][1:] == (3, True) and got[9][1:] == (4, False)  # blocked events count too
    assert got[5] == (sec(60), 1, True) and got[7] == (sec(120.5), 1, True)


def random_rows(seed, n, keys, span):
    rnd = random.Random(seed)
    return [(i, rnd.choice(keys), sec(round(rnd.random() * span, rnd.choice([0, 3, 6])))) for i in range(n)]


@pytest.mark.parametrize("ranges", [None, 9, 60])
@pytest.mark.parametrize("seed,span,width", [(1, 2000, 60), (2, 100, 60), (3, 50000, 60), (4, 3000, 7)])
def test_equals_walk_over_any_ranges(spark, ranges, seed, span, width):
    """Many ranges cut the hot key, its windows and equal times; windows are longer and shorter than a range."""
    rows = random_rows(seed, 600, ["hot"] * 8 + ["a", "b", "c"], span)
    assert as_dict(run(spark, rows, 3, width, ranges)) == walk(rows, 3, width)[0]


def test_third_of_the_rows_on_one_key_and_windows_of_a_second(spark):
    rows = random_rows(8, 6000, ["hot"] * 10 + [f"k{i}" for i in range(20)], 900)
    assert as_dict(run(spark, rows, 3, 1, 40)) == walk(rows, 3, 1)[0]


def test_carries_are_small_where_windows_are_short():
    """Windows run together: a range of a dense key sums up to far less than its rows."""
    t = np.sort(np.random.default_rng(2).integers(0, 10_000 * 1_000_000, 200_000))
    until, starts, counts = _transfer(t, 1_000_000)
    assert len(until) < len(t) / 500
    for end in (int(t[0]) - 5, int(t[777]), int(t[100_000]) + 1, int(t[-1])):
        i = int(np.searchsorted(t, end))
        while (j := int(np.searchsorted(t, t[i] + 1_000_000))) < len(t):
            i = j
        at = int(np.searchsorted(until, end))
        assert (starts[at], counts[at]) == (t[i], len(t) - i)


def test_periodic_events_over_many_ranges(spark):
    rows = [(i, "hot", sec(i * 5)) for i in range(300)] + [(1000 + i, "hot", sec(20000 + i * 61)) for i in range(20)]
    assert as_dict(run(spark, rows, 2, 60, 10)) == walk(rows, 2, 60)[0]


@pytest.mark.parametrize("ranges", [None, 20])
def test_batches_carry_their_windows(spark, ranges):
    rows = sorted(random_rows(5, 400, ["a", "b", "c", "d"], 3000), key=lambda r: (r[2], r[0]))
    want, _ = walk(rows, 3, 60)
    got, state = {}, None
    for part in (rows[:100], rows[100:103], rows[103:250], rows[250:]):
        limited = run(spark, part, 3, 60, ranges, state)
        got |= as_dict(limited)
        # as a stream does, through a stored table
        state = spark.createDataFrame(limiter_state(limited, "key", state).collect(), "key string, window_start timestamp, window_count long")
    assert got == want


def test_late_event_counts_in_the_open_window(spark):
    first = run(spark, [(1, "a", sec(100)), (2, "a", sec(110))], 3, 60)
    state = limiter_state(first, "key")
    late = as_dict(run(spark, [(3, "a", sec(10)), (4, "a", sec(120)), (5, "a", sec(160))], 3, 60, state=state))
    assert late == {3: (sec(100), 3, True), 4: (sec(100), 4, False), 5: (sec(160), 1, True)}


def test_state_keeps_quiet_keys(spark):
    state = limiter_state(run(spark, [(1, "a", sec(0)), (2, "b", sec(0))], 3, 60), "key")
    after = limiter_state(run(spark, [(3, "a", sec(90))], 3, 60, state=state), "key", state)
    assert {r.key: (r.window_start, r.window_count) for r in after.collect()} == {"a": (sec(90), 1), "b": (sec(0), 1)}


def test_usage(spark):
    rows = [(i, "a", sec(i)) for i in range(5)] + [(9, "a", sec(90)), (10, "b", sec(0))]
    got = {r.key: tuple(r)[1:] for r in rate_limit_usage(run(spark, rows, 3, 60), "key").collect()}
    assert got == {"a": (6, 2, 2, 5), "b": (1, 0, 1, 1)}


def test_events_without_key_or_time_come_back(spark):
    rows = [("a", T0, 1), (None, T0, 2), ("a", None, 3), (None, None, 4), ("a", T0, 5)]
    events = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int")
    limited = rate_limit(events, "k", "ts", "id", 1, 60)
    assert {r.id: (r.window_count, r.allowed) for r in limited.collect()} == {1: (1, True), 5: (2, False), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert limiter_state(limited, "k").count() == 1
