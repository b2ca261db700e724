"""Registered queries over relational tables: keys, references, upserts, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.integrity import (
    cascade_delete, find_duplicates, find_orphans, insert_if_absent, items_by_tag, lookup_by_key, tag_items,
)
from pagelake.operators.quality import check_domains, validate_emails, validate_urls
from pagelake.operators.search import latest_items, project_item_response, search_document
from pagelake.operators.store import (
    contents_backward, contents_forward, delete_rows, detect_changed, enqueue_rows, jobs_backward, jobs_forward,
    mark_fetched, partial_patch, touch_updated_at, upsert_clean, upsert_raw, with_checksum,
)
from pagelake.plans.extract import store_responses
from pagelake.schemas import ITEM_STATUS, JOB_STATUS, NOT_NULL, UNIQUE_KEYS
from pagelake.session import work_path
from pagelake.sources import fixtures as X
from pagelake.sources.tables import read_fixture, scan_table

QUERIES = {}

NOW_SQL = f"timestamp '{X.AS_OF}'"
LAKE = X.LAKE_SQL


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


def lake(spark, d) -> dict:
    return {
        "users": X.users(spark, d).select("id", "email", "created_at"),
        "items": X.items(spark, d),
        "tags": X.tags(spark, d),
        "item_tags": X.item_tags(spark, d),
        "contents": X.items(spark, d).select(F.col("id").alias("item_id"), F.md5("url").alias("checksum")),
        "jobs": X.items(spark, d).select(F.concat(F.lit("job-"), "id").alias("id"), F.col("id").alias("item_id")),
    }


# -------------------------------------------------------------- scans, lookups

@query("scan_table", f"with {LAKE} select id, email, created_at from users")
def scan_users(spark, d):
    path = work_path(spark, "users")
    X.users(spark, d).write.parquet(path)
    return scan_table(spark, "users", path)


@query(
    "lookup_by_key",
    f"with {LAKE} select i.id, i.user_id, i.url, i.status from items i where i.user_id in (select id from users where c_acctbal < 0)",
)
def lookup(spark, d):
    keys = X.users(spark, d).filter("c_acctbal < 0").select(F.col("id").alias("user_id"))
    return lookup_by_key(X.items(spark, d), keys, "user_id").select("id", "user_id", "url", "status")


@query("lookup_by_email", f"with {LAKE} select id, email from users where email = 'building.7@mail.example'")
def lookup_email(spark, d):
    wanted = spark.createDataFrame([("building.7@mail.example",)], "email string")
    return lookup_by_key(X.users(spark, d).select("id", "email"), wanted, "email").select("id", "email")


@query("project_item_response", f"with {LAKE} select id, user_id, url, title, site, status, created_at, updated_at from items")
def item_response(spark, d):
    return project_item_response(X.items(spark, d))


# ----------------------------------------------------------------------- rules


@query(
    "validate_urls",
    """with u as (select doc_id, case when n_chars < 300 then '' when n_chars > 2000 then 'https://a.example/' || text else 'https://a.example/' || source end as url from documents)
    select 'URL cannot be empty' as rule, cast(doc_id as varchar) as key from u where url = ''
    union all select 'URL too long', cast(doc_id as varchar) from u where strlen(url) > 2048""",
)
def url_rules(spark, d):
    docs = read_fixture(spark, d, "documents").selectExpr(
        "doc_id",
        "case when n_chars < 300 then '' when n_chars > 2000 then concat('https://a.example/', text) "
        "else concat('https://a.example/', source) end as url",
    )
    return validate_urls(docs, "url", "doc_id")


EMAIL_EXPR = (
    "replace(c_name, '#', case c_nationkey % 4 when 0 then '@mail.' when 1 then '@mail' when 2 then ' @mail.' else '@@mail.' end)"
)


@query(
    "validate_emails",
    f"""with u as (select c_custkey, {EMAIL_EXPR} as email from customer)
    select 'Invalid email' as rule, cast(c_custkey as varchar) as key from u where not regexp_matches(email, '\\A[^\\s@]+@[^\\s@]+\\.[^\\s@]+\\z')""",
)
def email_rules(spark, d):
    users = read_fixture(spark, d, "customer").selectExpr("c_custkey", f"{EMAIL_EXPR} as email")
    return validate_emails(users, "email", "c_custkey")


@query(
    "check_domains",
    f"""with i as (select o_orderkey as id, case o_orderstatus when 'O' then 'pending' when 'P' then 'fetched' else lower(o_orderpriority) end as status,
      case when o_totalprice > 100000 then o_orderpriority end as title, cast(floor(o_totalprice / 1000) as bigint) - 50 as attempts from orders)
    select 'status domain' as rule, cast(id as varchar) as key from i where status not in {ITEM_STATUS}
    union all select 'title not null', cast(id as varchar) from i where title is null
    union all select 'attempts >= 0', cast(id as varchar) from i where attempts < 0""",
)
def domain_rules(spark, d):
    rows = read_fixture(spark, d, "orders").selectExpr(
        "o_orderkey as id",
        "case o_orderstatus when 'O' then 'pending' when 'P' then 'fetched' else lower(o_orderpriority) end as status",
        "case when o_totalprice > 100000 then o_orderpriority end as title",
        "cast(floor(o_totalprice / 1000) as bigint) - 50 as attempts",
    )
    return check_domains(rows, "id", {"status": ITEM_STATUS}, ["title"], ["attempts"])


ODD_JOBS_SQL = f"""{X.JOBS_SQL}, odd as (select id, kind, case when attempts = 26 then 'lost' else status end as status, run_at, attempts,
  max_attempts - attempts as max_attempts, backoff_seconds, case when last_error is null then '{{}}' end as payload, created_at, updated_at from jobs)"""


@query(
    "check_domains_jobs",
    f"""with {ODD_JOBS_SQL} select 'status domain' as rule, cast(id as varchar) as key from odd where status not in {JOB_STATUS}
    union all select 'payload not null', cast(id as varchar) from odd where payload is null
    union all select 'max_attempts >= 0', cast(id as varchar) from odd where max_attempts < 0""",
)
def job_rules(spark, d):
    odd = X.jobs(spark, d).withColumns({
        "status": F.when(F.col("attempts") == 26, "lost").otherwise(F.col("status")),
        "payload": F.when(F.col("last_error").isNull(), "{}"),
        "max_attempts": F.col("max_attempts") - F.col("attempts"),
    })
    return check_domains(odd, "id", {"status": JOB_STATUS}, NOT_NULL["jobs"], ["attempts", "max_attempts", "backoff_seconds"])


@query("find_duplicates", f"with {LAKE} select email, count(*) as n from users group by email having count(*) > 1")
def duplicate_emails(spark, d):
    return find_duplicates(X.users(spark, d), ["email"])


@query(
    "find_duplicates_text",
    "select lang, md5(text) as text_md5, count(*) as n from documents group by 1, 2 having count(*) > 1",
)
def duplicate_texts(spark, d):
    docs = read_fixture(spark, d, "documents").select("lang", F.md5("text").alias("text_md5"))
    return find_duplicates(docs, ["lang", "text_md5"])


@query(
    "find_duplicate_keys",
    f"""with {LAKE}, contents as (select id as item_id, md5(url) as checksum from items union all select id, md5(url) from items where status = 'archived')
    select 'users' as table_name, email as key, count(*) as n from users group by email having count(*) > 1
    union all select 'tags', user_id || '|' || name, count(*) from tags group by user_id, name having count(*) > 1
    union all select 'item_tags', item_id || '|' || tag_id, count(*) from item_tags group by item_id, tag_id having count(*) > 1
    union all select 'contents', item_id || '|' || checksum, count(*) from contents group by item_id, checksum having count(*) > 1""",
)
def duplicate_keys(spark, d):
    tables = lake(spark, d)
    archived = tables["items"].filter("status = 'archived'").select(F.col("id").alias("item_id"), F.md5("url").alias("checksum"))
    tables["contents"] = tables["contents"].unionByName(archived)
    found = [
        find_duplicates(tables[name], list(key)).select(F.lit(name).alias("table_name"), F.concat_ws("|", *key).alias("key"), "n")
        for name, keys in UNIQUE_KEYS.items() for key in keys
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "find_orphans",
    f"""with {LAKE}, kept as (select * from users where c_acctbal >= 0), open_items as (select * from items where status <> 'archived')
    select 'items.user_id' as rule, user_id as key, count(*) as n from open_items where user_id not in (select id from kept) group by user_id
    union all select 'tags.user_id', user_id, count(*) from tags where user_id not in (select id from kept) group by user_id
    union all select 'item_tags.tag_id', tag_id, count(*) from item_tags where tag_id not in (select id from tags) group by tag_id
    union all select 'item_tags.item_id', item_id, count(*) from item_tags where item_id not in (select id from open_items) group by item_id
    union all select 'contents.item_id', id, 1 from items where id not in (select id from open_items)
    union all select 'jobs.item_id', id, 1 from items where id not in (select id from open_items)""",
)
def orphans(spark, d):
    tables = lake(spark, d)
    tables["users"] = X.users(spark, d).filter("c_acctbal >= 0")
    tables["items"] = tables["items"].filter("status <> 'archived'")
    return find_orphans(tables)


@query(
    "cascade_delete",
    f"""with {LAKE}, gone as (select id from users where c_acctbal < 0), gone_items as (select id from items where user_id in (select id from gone))
    select 'users' as table_name, id as key, cast(null as varchar) as ref from users where id not in (select id from gone)
    union all select 'items', id, user_id from items where user_id not in (select id from gone)
    union all select 'tags', id, user_id from tags where user_id not in (select id from gone)
    union all select 'contents', id, null from items where id not in (select id from gone_items)
    union all select 'item_tags', item_id, tag_id from item_tags where item_id not in (select id from gone_items) and tag_id not in (select id from tags where user_id in (select id from gone))
    union all select 'jobs', 'job-' || id, case when id not in (select id from gone_items) then id end from items""",
)
def cascaded(spark, d):
    out = cascade_delete(lake(spark, d), X.users(spark, d).filter("c_acctbal < 0").select("id"))
    none = F.lit(None).cast("string")
    key = {"users": ("id", none), "items": ("id", "user_id"), "tags": ("id", "user_id"), "contents": ("item_id", none),
           "item_tags": ("item_id", "tag_id"), "jobs": ("id", "item_id")}
    parts = [
        out[t].select(F.lit(t).alias("table_name"), F.col(k).alias("key"), (F.col(r) if isinstance(r, str) else r).alias("ref"))
        for t, (k, r) in key.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


SIGNUPS_SQL = """base as (select distinct 'building.' || s_nationkey as email from supplier),
signups as (select c_custkey as seq, lower(c_mktsegment) || '.' || c_nationkey as email from customer),
firsts as (select min(seq) as seq from signups where email not in (select email from base) group by email)"""


def _signups(spark, d):
    base = read_fixture(spark, d, "supplier").selectExpr("concat('building.', s_nationkey) as email")
    incoming = read_fixture(spark, d, "customer").selectExpr(
        "c_custkey as seq", "concat(lower(c_mktsegment), '.', c_nationkey) as email"
    )
    return insert_if_absent(base, incoming, "email", "seq")


@query("insert_if_absent", f"with {SIGNUPS_SQL} select seq, email from signups where seq in (select seq from firsts)")
def inserted(spark, d):
    return _signups(spark, d)[0].select("seq", "email")


@query("insert_if_absent_conflicts", f"with {SIGNUPS_SQL} select seq, email from signups where seq not in (select seq from firsts)")
def conflicts(spark, d):
    return _signups(spark, d)[1].select("seq", "email")


# ------------------------------------------------------------------------ tags

@query("tag_items", f"with {LAKE} select item_id, name as tag from item_tags join tags on tags.id = tag_id")
def tagged(spark, d):
    return tag_items(X.items(spark, d), X.item_tags(spark, d), X.tags(spark, d))


@query(
    "items_by_tag",
    f"with {LAKE} select id, user_id, status from items where id in (select item_id from item_tags join tags on tags.id = tag_id where name = '1-URGENT')",
)
def by_tag(spark, d):
    return items_by_tag(X.items(spark, d), X.item_tags(spark, d), X.tags(spark, d), "1-URGENT").select("id", "user_id", "status")


@query(
    "search_document",
    f"""with {LAKE}, texts as (select cast(doc_id as varchar) as item_id, text as clean_text from documents),
    named as (select item_id as id, string_agg(distinct name, ' ' order by name) as tag_text from item_tags join tags on tags.id = tag_id group by 1)
    select i.id, concat_ws(chr(10), title, site, tag_text, clean_text) as document
    from items i left join named n on n.id = i.id left join texts t on t.item_id = i.id""",
)
def search_documents(spark, d):
    texts = read_fixture(spark, d, "documents").selectExpr("cast(doc_id as string) as item_id", "text as clean_text")
    return search_document(X.items(spark, d), X.item_tags(spark, d), X.tags(spark, d), texts)


@query(
    "latest_items",
    f"""with {LAKE} select id, user_id, created_at, row_number() over (partition by user_id order by created_at desc, id) as rank
    from items where status = 'fetched' qualify rank <= 3""",
)
def newest_items(spark, d):
    return latest_items(X.items(spark, d), 3, F.lit("fetched")).select("id", "user_id", "created_at", "rank")


# -------------------------------------------------------------------- mutations

@query(
    "partial_patch",
    f"""with {LAKE}, p as (select l_orderkey, max(case when l_returnflag = 'A' then 'Returned' end) as title, max(case when l_linestatus = 'F' then 'archived' end) as status
      from lineitem group by 1)
    select i.id, i.user_id, i.url, coalesce(p.title, i.title) as title, i.site, coalesce(p.status, i.status) as status, i.created_at,
      case when p.l_orderkey is not null then {NOW_SQL} else i.updated_at end as updated_at
    from items i left join p on cast(p.l_orderkey as varchar) = i.id""",
)
def patched(spark, d):
    patches = (
        read_fixture(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id"))
        .agg(F.expr("max(case when l_returnflag = 'A' then 'Returned' end) as title"),
             F.expr("max(case when l_linestatus = 'F' then 'archived' end) as status"))
    )
    return partial_patch(X.items(spark, d), patches, X.as_of())


@query(
    "detect_changed",
    f"with {X.CONTENTS_SQL} select i.item_id, i.checksum, i.lang from incoming i left join contents c using (item_id) where c.checksum is null or c.checksum <> i.checksum",
)
def changed(spark, d):
    return detect_changed(with_checksum(X.incoming_contents(spark, d)), X.contents(spark, d)).select("item_id", "checksum", "lang")


@query(
    "upsert_clean",
    f"""with {X.CONTENTS_SQL} select item_id, c.raw_html, case when same then c.clean_text else i.clean_text end as clean_text,
      case when same then c.lang else i.lang end as lang, case when same then c.extracted_at else i.extracted_at end as extracted_at,
      case when same then c.checksum else i.checksum end as checksum
    from (select item_id, coalesce(c.checksum = i.checksum, i.item_id is null) as same, c, i from contents c full join incoming i using (item_id))""",
)
def upserted_clean(spark, d):
    out = upsert_clean(X.contents(spark, d), X.incoming_contents(spark, d))
    return out.select("item_id", "raw_html", "clean_text", "lang", "extracted_at", "checksum")


RAW_SQL = """pagesraw as (select 'd' || page_id as item_id, html as raw_html, timestamp '2024-03-01 00:00:00' as extracted_at, md5(html) as checksum from pages)"""


def _raw(spark, d):
    return read_fixture(spark, d, "pages").selectExpr(
        "concat('d', page_id) as item_id", "html as raw_html", "timestamp_ntz'2024-03-01 00:00:00' as extracted_at", "md5(html) as checksum"
    )


@query(
    "upsert_raw",
    f"""with {X.CONTENTS_SQL}, {RAW_SQL} select item_id, md5(coalesce(r.raw_html, c.raw_html)) as raw_md5, md5(c.clean_text) as clean_md5, c.lang,
      coalesce(r.extracted_at, c.extracted_at) as extracted_at, case when r.item_id is not null then r.checksum else c.checksum end as checksum
    from contents c full join pagesraw r using (item_id)""",
)
def upserted_raw(spark, d):
    out = upsert_raw(X.contents(spark, d), _raw(spark, d))
    return out.select("item_id", F.md5("raw_html").alias("raw_md5"), F.md5("clean_text").alias("clean_md5"), "lang", "extracted_at", "checksum")


@query(
    "raw_then_clean",
    f"""with {X.CONTENTS_SQL}, {RAW_SQL}, r as (select item_id, case when p.item_id is not null then p.checksum else c.checksum end as checksum from contents c full join pagesraw p using (item_id))
    select i.item_id, i.checksum from incoming i left join r using (item_id) where r.checksum is null or r.checksum <> i.checksum""",
)
def raw_then_clean(spark, d):
    """A raw write makes the next clean write of the same text look changed."""
    current = upsert_raw(X.contents(spark, d), _raw(spark, d))
    return detect_changed(with_checksum(X.incoming_contents(spark, d)), current).select("item_id", "checksum")


@query(
    "mark_fetched",
    f"""with {LAKE}, done as (select distinct cast(page_id as varchar) as id from pages)
    select i.id, case when done.id is not null then 'fetched' else status end as status,
      case when done.id is not null then {NOW_SQL} else updated_at end as updated_at from items i left join done using (id)""",
)
def marked(spark, d):
    stored = read_fixture(spark, d, "pages").selectExpr("cast(page_id as string) as item_id")
    return mark_fetched(X.items(spark, d), stored, X.as_of()).select("id", "status", "updated_at")


GONE_SQL = "gone as (select distinct c_custkey as o_custkey from customer where c_acctbal < 0)"


@query("delete_rows", f"with {GONE_SQL} select o_orderkey, o_custkey from orders where o_custkey not in (select o_custkey from gone)")
def kept_rows(spark, d):
    keys = read_fixture(spark, d, "customer").filter("c_acctbal < 0").selectExpr("c_custkey as o_custkey")
    return delete_rows(read_fixture(spark, d, "orders"), keys, "o_custkey")[0].select("o_orderkey", "o_custkey")


@query(
    "delete_rows_report",
    f"with {GONE_SQL} select o_custkey, o_custkey in (select o_custkey from orders) as deleted from gone",
)
def deletion_report(spark, d):
    keys = read_fixture(spark, d, "customer").filter("c_acctbal < 0").selectExpr("c_custkey as o_custkey")
    return delete_rows(read_fixture(spark, d, "orders"), keys, "o_custkey")[1]


@query(
    "touch_updated_at",
    f"with {LAKE} select id, case when status = 'pending' then {NOW_SQL} else updated_at end as updated_at from items",
)
def touched(spark, d):
    return touch_updated_at(X.items(spark, d), F.col("status") == "pending", X.as_of()).select("id", "updated_at")


REQUESTS_SQL = """requests as (select event_id as id, 'fetch_page' as kind, '{"item_id": "' || user_id || '"}' as payload,
  case when event_type = 'view' then ts end as run_at, case when event_type = 'error' then 3 end as max_attempts from events)"""


def _requests(spark, d):
    return read_fixture(spark, d, "events").selectExpr(
        "event_id as id", "'fetch_page' as kind", "concat('{\"item_id\": \"', user_id, '\"}') as payload",
        "case when event_type = 'view' then ts end as run_at", "case when event_type = 'error' then 3 end as max_attempts",
    )


@query(
    "enqueue_rows",
    f"""with {REQUESTS_SQL} select id, kind, 'queued' as status, coalesce(run_at, {NOW_SQL}) as run_at, 0 as attempts,
      coalesce(max_attempts, 25) as max_attempts, 0 as backoff_seconds, payload, {NOW_SQL} as created_at from requests""",
)
def enqueued(spark, d):
    return enqueue_rows(_requests(spark, d), X.as_of()).select(
        "id", "kind", "status", "run_at", "attempts", "max_attempts", "backoff_seconds", "payload", "created_at"
    )


@query(
    "enqueue_rows_once",
    f"""with {REQUESTS_SQL}, known as (select distinct 'fetch_page' as kind, '{{"item_id": "' || c_custkey || '"}}' as payload from customer where c_acctbal < 0)
    select min(id) as id, payload from requests where payload not in (select payload from known) group by payload""",
)
def enqueued_once(spark, d):
    known = read_fixture(spark, d, "customer").filter("c_acctbal < 0").selectExpr(
        "'fetch_page' as kind", "concat('{\"item_id\": \"', c_custkey, '\"}') as payload"
    )
    return enqueue_rows(_requests(spark, d), X.as_of(), known, ["kind", "payload"]).select("id", "payload")


OLD_JOBS_SQL = """old as (select o_orderkey as id, case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'running' end as status,
  o_orderdate as run_at from orders)"""


def _old_jobs(spark, d):
    return read_fixture(spark, d, "orders").selectExpr(
        "o_orderkey as id", "case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'running' end as status", "o_orderdate as run_at"
    )


@query(
    "migrate_jobs",
    f"""with {OLD_JOBS_SQL} select id, case status when 'done' then 'succeeded' else status end as status, run_at, '{{}}' as payload,
      25 as max_attempts, 0 as backoff_seconds, {NOW_SQL} as created_at from old""",
)
def migrated_jobs(spark, d):
    return jobs_forward(_old_jobs(spark, d), X.as_of()).select(
        "id", "status", "run_at", "payload", "max_attempts", "backoff_seconds", "created_at"
    )


@query("migrate_jobs_back", f"with {OLD_JOBS_SQL} select id, status, run_at from old")
def migrated_back(spark, d):
    return jobs_backward(jobs_forward(_old_jobs(spark, d), X.as_of()))


@query(
    "migrate_contents",
    "select doc_id, text as raw_text, source as raw_html, cast(null as varchar) as clean_html, cast(null as varchar) as clean_text from documents",
)
def migrated_contents(spark, d):
    old = read_fixture(spark, d, "documents").selectExpr("doc_id", "source as html", "text")
    return contents_forward(contents_backward(contents_forward(old)))


# ------------------------------------------------- responses to stored contents

STORED_SQL = f"""{LAKE}, {X.RESPONSES_SQL},
judged as (select *, case when status not between 200 and 299 then 'Http' when not contains(content_type, 'text/html') then 'UnsupportedContentType'
  when strlen(html) > 8000 then 'BodyTooLarge' end as code,
  case when page_id % 6 = 5 then 'gone-' || page_id else cast(page_id as varchar) end as item_id from resp),
kept as (select * from judged where code is null and item_id in (select id from items))"""


def _stored(spark, d):
    name = F.when(F.col("page_id") % 6 == 5, F.concat(F.lit("gone-"), "page_id")).otherwise(F.col("page_id").cast("string"))
    found = X.responses(spark, d).withColumn("item_id", name)
    current = X.contents(spark, d).withColumn("item_id", F.expr("substring(item_id, 2)"))
    return store_responses(X.items(spark, d), current, found, X.as_of(), 8000)


@query(
    "store_responses_contents",
    f"""with {STORED_SQL}, {X.CONTENTS_SQL}, old as (select substr(item_id, 2) as item_id, raw_html, clean_text, checksum, extracted_at from contents)
    select item_id, md5(coalesce(k.html, old.raw_html)) as raw_md5, md5(old.clean_text) as clean_md5,
      case when k.html is not null then md5(k.html) else old.checksum end as checksum,
      case when k.html is not null then {NOW_SQL} else old.extracted_at end as extracted_at
    from old full join kept k using (item_id)""",
)
def stored_contents(spark, d):
    return _stored(spark, d)["contents"].select(
        "item_id", F.md5("raw_html").alias("raw_md5"), F.md5("clean_text").alias("clean_md5"), "checksum", "extracted_at"
    )


@query(
    "store_responses_items",
    f"""with {STORED_SQL} select id, case when id in (select item_id from kept) then 'fetched' else status end as status,
      case when id in (select item_id from kept) then {NOW_SQL} else updated_at end as updated_at from items""",
)
def stored_items(spark, d):
    return _stored(spark, d)["items"].select("id", "status", "updated_at")


@query(
    "store_responses_errors",
    f"""with {STORED_SQL} select item_id, code, case code when 'Http' then cast(status as varchar) when 'BodyTooLarge' then cast(strlen(html) as varchar)
      else content_type end as detail from judged where code is not null
    union all select item_id, 'ItemNotFound', 'Item ' || item_id || ' not found' from judged where code is null and item_id not in (select id from items)""",
)
def stored_errors(spark, d):
    return _stored(spark, d)["errors"].select("item_id", "error.code", "error.detail")
