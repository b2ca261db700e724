"""All registered queries: name -> (query function, SQL twin or None)."""

from __future__ import annotations

from pagelake.plans import crawl_queries, job_queries, search_queries, table_queries

QUERIES = {
    **crawl_queries.QUERIES,
    **table_queries.QUERIES,
    **job_queries.QUERIES,
    **search_queries.QUERIES,
}
