"""Plans have the shape that holds at scale."""

import re

import pytest

import __spark_entry__ as entry

from conftest import SF

EAGER = ("stream", "write_contents", "rate_limit", "search_stored", "search_own", "match_stored", "index_update")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in entry.OWN_QUERIES if not n.startswith(EAGER)])
def test_no_cross_join_and_no_single_partition_exchange(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # one task for all rows is allowed only for scalars
    assert "Exchange SinglePartition" not in text or name in ("rank_bm25",), text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["lookup_by_key"](spark, SF))
    assert "GreaterThan" in text or "LessThan(c_acctbal" in text
    text = plan(entry.queries()["dead_letter"](spark, SF))
    assert "o_orderdate" not in text.split("ReadSchema")[1]


def test_due_batch_is_a_top_n(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["due_batch"](spark, SF))


def test_top_n_per_group_limits_before_the_shuffle(spark):
    assert plan(entry.queries()["latest_items"](spark, SF)).count("WindowGroupLimit") == 2


WIDE = re.compile(r"(html|text)#\d+")


def blocks(df):
    """Operators of the formatted plan with their arguments, inputs and outputs."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"(?m)^\(\d+\) (.+(?:\n(?!\n).+)*)", text)


def assert_wide_columns_stream(df):
    """No html or text enters an aggregate, a sort, a sort-merge join or a full outer join."""
    found = blocks(df)
    assert any("FullOuter" not in b and "ShuffledHashJoin" in b for b in found)
    for block in found:
        kind = block.split()[0]
        assert not (kind in ("SortAggregate", "ObjectHashAggregate", "HashAggregate", "Sort", "SortMergeJoin", "Window") and WIDE.search(block)), block
        assert "Join type: FullOuter" not in block, block


@pytest.mark.parametrize("name", ["upsert_clean", "upsert_raw", "raw_then_clean", "detect_changed"])
def test_upserts_decide_on_narrow_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    assert_wide_columns_stream(df)
    assert "SortAggregate" not in plan(df)


def test_stored_contents_are_read_by_bucket(spark, tmp_path):
    from pagelake.operators.store import with_checksum
    from pagelake.sources import fixtures as X
    from pagelake.sources.contents import read_contents, write_contents

    base = str(tmp_path / "contents")
    write_contents(X.contents(spark, SF), base, 0, buckets=3)
    write_contents(with_checksum(X.incoming_contents(spark, SF)), base, 1, part="clean")
    whole = read_contents(spark, base)
    assert_wide_columns_stream(whole)
    assert "Exchange" not in plan(whole)  # neither the wide columns nor the ids are shuffled
    texts = read_contents(spark, base, columns=["clean_text"])
    assert "raw_html" not in plan(texts) and "clean_html" not in plan(texts) and "Exchange" not in plan(texts)


def test_job_fold_is_a_hash_aggregate_that_combines(spark):
    from pagelake.operators.jobs import _log_rows, job_moves
    from pagelake.sources import fixtures as X
    from pagelake.sources.tables import read_fixture

    log = X.job_log(X.with_k(read_fixture(spark, SF, "events")))
    text = plan(job_moves(_log_rows(log)))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    below = text[text.index("Exchange") :]
    assert "HashAggregate" in below and "partial_max" in below
    assert "SortAggregate" not in plan(entry.queries()["job_state_fold"](spark, SF))


def test_redirect_edges_are_dealt_once(spark):
    from pagelake.operators.responses import resolve_redirects

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows which exchanges are read again
    try:
        starts = spark.range(100).selectExpr("cast(id as string) as url")
        edges = spark.range(1000).selectExpr("cast(id as string) as url", "cast(id + 7 as string) as location")
        text = plan(resolve_redirects(starts, edges))
        assert text.count("ReusedExchange") == 10 and "SortMergeJoin [at" not in text and "Scan ExistingRDD" not in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
