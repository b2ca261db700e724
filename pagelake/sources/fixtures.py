"""Lake tables derived from the supplied star-schema and text tables.

Every mapping runs over the whole source table; the formulas only give columns
that the sources do not have, and are written the same way in the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.tables import read_fixture, read_texts

AS_OF = "2000-01-01 00:00:00"


def as_of(text: str = AS_OF) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """pages as crawl responses (with page_id)."""
    pages = read_texts(spark, d, "pages")
    ctype = F.expr(
        "case when page_id % 11 = 0 then 'image/jpeg' when page_id % 11 = 1 then null "
        "else 'text/html; charset=utf-8' end"
    )
    headers = F.map_filter(F.create_map(F.lit("Content-Type"), ctype), lambda _, v: v.isNotNull())
    return pages.select(
        "page_id",
        "url",
        F.expr("case page_id % 10 when 7 then 404 when 8 then 500 when 9 then 301 else 200 end").alias("status"),
        headers.alias("headers"),
        F.lit(None).cast("bigint").alias("declared_length"),
        F.encode("html", "UTF-8").alias("body"),
        as_of("2024-01-01 00:00:00").alias("fetched_at"),
    )


RESPONSES_SQL = """resp as (
  select page_id, url, html,
         case page_id % 10 when 7 then 404 when 8 then 500 when 9 then 301 else 200 end as status,
         case when page_id % 11 = 0 then 'image/jpeg' when page_id % 11 = 1 then 'text/html'
              else 'text/html; charset=utf-8' end as content_type
  from pages)"""


def users(spark: SparkSession, d: str) -> DataFrame:
    return read_fixture(spark, d, "customer").selectExpr(
        "cast(c_custkey as string) as id",
        "concat(lower(c_mktsegment), '.', c_nationkey, '@mail.example') as email",
        "timestamp_ntz'1995-01-01 00:00:00' as created_at",
        "c_acctbal",
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    return read_fixture(spark, d, "orders").selectExpr(
        "cast(o_orderkey as string) as id",
        "cast(o_custkey as string) as user_id",
        "concat('https://shop.example/orders/', o_orderkey) as url",
        "case when o_totalprice < 100000 then null else concat('Order ', o_orderpriority) end as title",
        "'shop.example' as site",
        "case o_orderstatus when 'O' then 'pending' when 'P' then 'fetched' else 'archived' end as status",
        "o_orderdate as created_at",
        "o_orderdate as updated_at",
    )


def tags(spark: SparkSession, d: str) -> DataFrame:
    return (
        read_fixture(spark, d, "orders")
        .selectExpr("cast(o_custkey as string) as user_id", "o_orderpriority as name")
        .distinct()
        .select(F.md5(F.concat_ws(":", "user_id", "name")).alias("id"), "user_id", "name")
    )


def item_tags(spark: SparkSession, d: str) -> DataFrame:
    return read_fixture(spark, d, "orders").selectExpr(
        "cast(o_orderkey as string) as item_id",
        "md5(concat_ws(':', cast(o_custkey as string), o_orderpriority)) as tag_id",
    )


LAKE_SQL = """users as (
  select cast(c_custkey as varchar) as id, lower(c_mktsegment) || '.' || c_nationkey || '@mail.example' as email,
         timestamp '1995-01-01 00:00:00' as created_at, c_acctbal from customer),
items as (
  select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as user_id,
         'https://shop.example/orders/' || o_orderkey as url,
         case when o_totalprice < 100000 then null else 'Order ' || o_orderpriority end as title,
         'shop.example' as site,
         case o_orderstatus when 'O' then 'pending' when 'P' then 'fetched' else 'archived' end as status,
         o_orderdate as created_at, o_orderdate as updated_at from orders),
tags as (
  select md5(user_id || ':' || name) as id, user_id, name from
    (select distinct cast(o_custkey as varchar) as user_id, o_orderpriority as name from orders)),
item_tags as (
  select cast(o_orderkey as varchar) as item_id,
         md5(cast(o_custkey as varchar) || ':' || o_orderpriority) as tag_id from orders)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """orders as a job table snapshot."""
    return read_fixture(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "case o_orderkey % 3 when 0 then 'fetch_page' when 1 then 'example_job' else 'reindex_item' end as kind",
        "case o_orderstatus when 'O' then 'queued' when 'P' then 'running' when 'F' then "
        "  case when o_totalprice > 250000 then 'failed' else 'succeeded' end end as status",
        "o_orderdate as run_at",
        "cast(o_custkey % 27 as bigint) as attempts",
        "cast(25 as bigint) as max_attempts",
        "cast(0 as bigint) as backoff_seconds",
        "case when o_orderstatus = 'P' then o_orderdate + make_dt_interval(o_custkey % 900, 0, 0, 0) end as visibility_till",
        "case when o_orderstatus = 'P' then concat('worker-', o_custkey % 7) end as reserved_by",
        "case when o_orderstatus = 'F' and o_totalprice > 250000 then concat('error ', o_orderpriority) end as last_error",
        "o_orderdate as created_at",
        "o_orderdate as updated_at",
    )


JOBS_SQL = """jobs as (
  select o_orderkey as id,
         case o_orderkey % 3 when 0 then 'fetch_page' when 1 then 'example_job' else 'reindex_item' end as kind,
         case o_orderstatus when 'O' then 'queued' when 'P' then 'running' when 'F' then
           case when o_totalprice > 250000 then 'failed' else 'succeeded' end end as status,
         o_orderdate as run_at, cast(o_custkey % 27 as bigint) as attempts, cast(25 as bigint) as max_attempts,
         cast(0 as bigint) as backoff_seconds,
         case when o_orderstatus = 'P' then o_orderdate + to_days(cast(o_custkey % 900 as integer)) end as visibility_till,
         case when o_orderstatus = 'P' then 'worker-' || (o_custkey % 7) end as reserved_by,
         case when o_orderstatus = 'F' and o_totalprice > 250000 then 'error ' || o_orderpriority end as last_error,
         o_orderdate as created_at, o_orderdate as updated_at
  from orders)"""


def job_log(events: DataFrame) -> DataFrame:
    """events as a job log: user_id is the job, the event type is the action."""
    return events.selectExpr(
        "cast(user_id as string) as job_id",
        "ts",
        "event_id as seq",
        "case event_type when 'signup' then 'enqueue' when 'click' then 'claim' when 'view' then 'extend' "
        "when 'purchase' then 'success' else 'failure' end as action",
        "concat('worker-', event_id % 7) as owner",
        "cast(300 as bigint) as lease_secs",
        "case when event_type = 'error' then concat('error ', k) end as error",
        "case when event_type = 'error' and k < 70 then ts + make_dt_interval(0, 0, cast(k as int), 0) end as next_run_at",
        "case when event_type = 'error' then case when k < 70 then k * 60 else 0 end end as backoff_seconds",
    )


def with_k(events: DataFrame) -> DataFrame:
    """events with the number inside their JSON props."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


LOG_SQL = """log as (
  select cast(user_id as varchar) as job_id, ts, event_id as seq,
         case event_type when 'signup' then 'enqueue' when 'click' then 'claim' when 'view' then 'extend'
              when 'purchase' then 'success' else 'failure' end as action,
         'worker-' || (event_id % 7) as owner, cast(300 as bigint) as lease_secs,
         case when event_type = 'error' then 'error ' || k end as error,
         case when event_type = 'error' and k < 70 then ts + to_minutes(k) end as next_run_at,
         case when event_type = 'error' then case when k < 70 then k * 60 else 0 end end as backoff_seconds
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""


def contents(spark: SparkSession, d: str) -> DataFrame:
    """documents as stored contents; Spanish rows have no checksum yet."""
    return read_texts(spark, d, "documents").selectExpr(
        "concat('d', doc_id) as item_id",
        "concat('<html>', source, '</html>') as raw_html",
        "cast(null as string) as raw_text",
        "concat('<p>', text, '</p>') as clean_html",
        "text as clean_text",
        "lang",
        "timestamp_ntz'2024-01-01 00:00:00' as extracted_at",
        "case when lang <> 'es' then md5(concat('<p>', text, '</p>', text)) end as checksum",
    )


def incoming_contents(spark: SparkSession, d: str) -> DataFrame:
    """documents again with French ones revised, and the benchmark texts as new items."""
    old = read_texts(spark, d, "documents").selectExpr(
        "concat('d', doc_id) as item_id",
        "case when lang = 'fr' then concat(text, ' revised') else text end as clean_text",
        "lang",
    )
    new = read_fixture(spark, d, "benchmark").selectExpr(
        "concat('b', item_id) as item_id", "text as clean_text", "cast(null as string) as lang"
    )
    return old.unionByName(new).selectExpr(
        "item_id", "concat('<p>', clean_text, '</p>') as clean_html", "clean_text", "lang",
        "timestamp_ntz'2024-02-01 00:00:00' as extracted_at",
    )


CONTENTS_SQL = """contents as (
  select 'd' || doc_id as item_id, '<html>' || source || '</html>' as raw_html, cast(null as varchar) as raw_text,
         '<p>' || text || '</p>' as clean_html, text as clean_text, lang,
         timestamp '2024-01-01 00:00:00' as extracted_at,
         case when lang <> 'es' then md5('<p>' || text || '</p>' || text) end as checksum
  from documents),
incoming as (
  select item_id, '<p>' || clean_text || '</p>' as clean_html, clean_text, lang,
         timestamp '2024-02-01 00:00:00' as extracted_at,
         md5('<p>' || clean_text || '</p>' || clean_text) as checksum
  from (select 'd' || doc_id as item_id, case when lang = 'fr' then text || ' revised' else text end as clean_text, lang
        from documents
        union all select 'b' || item_id, text, null from benchmark))"""
