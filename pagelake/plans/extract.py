"""Composed jobs: pages to clean documents, responses to stored contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.fixed import MAX_BODY_BYTES
from pagelake.functions.html import sanitize_html
from pagelake.functions.text import compute_once, normalize_whitespace, raw_checksum
from pagelake.operators.language import assign_language
from pagelake.operators.pages import page_parts
from pagelake.operators.quality import non_blank, reject_reason
from pagelake.operators.responses import decode_responses, gate_responses
from pagelake.operators.store import mark_fetched, numbered, upsert_raw
from pagelake.session import cut_lineage


def judge_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with title, site_name, text, main_html and ``reason`` (NULL for pages that are kept)."""
    parts = compute_once(page_parts(pages, html), {"clean": normalize_whitespace("main_text")})
    reason = (
        F.when(F.col("title").isNull(), "no_title")
        .when(~F.coalesce(non_blank("main_text"), F.lit(False)), "no_text")
        .otherwise(reject_reason("title", "clean"))
    )
    return compute_once(parts, {"reason": reason}).drop("main_text", html).withColumnRenamed("clean", "text")


def extract_pages(
    pages: DataFrame, html: str = "html", url: str = "url", profiles: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected).

    Rejection comes before sanitising and language, which run on kept rows only;
    the result is the same in either order. Without ``profiles`` the language is NULL.
    """
    judged = judge_pages(pages, html)
    kept = judged.filter(F.col("reason").isNull()).drop("reason")
    documents = kept.withColumn("clean_html", sanitize_html("main_html", url)).withColumn("byline", F.lit(None).cast("string"))
    if profiles is None:
        documents = documents.withColumn("language", F.lit(None).cast("string"))
    else:
        documents = assign_language(documents, profiles).drop("confidence")
    rejected = judged.filter(F.col("reason").isNotNull()).drop("main_html")
    return documents.drop("main_html", "selector"), rejected.drop("selector")


def article_documents(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages judged by their ``article``: title, site_name, its text and reason."""
    article = F.when(F.col("selector") == "article", F.col("main_text"))
    parts = compute_once(page_parts(pages, html).withColumn("main_text", article), {"text": normalize_whitespace("main_text")})
    return compute_once(parts, {"reason": reject_reason("title", "text")}).drop("main_text", "main_html", "selector", html)


def store_responses(
    items: DataFrame, contents: DataFrame, responses: DataFrame, as_of: Column, max_bytes: int = MAX_BODY_BYTES
) -> dict[str, DataFrame]:
    """Gate, decode and store fetched responses (they carry item_id): new items, new contents, errors.

    Every response is either stored or among the errors; one of an unknown item is an error.
    """
    accepted, rejected = gate_responses(responses, max_bytes)
    decoded, undecodable = decode_responses(accepted)
    fetched = decoded.select(
        "item_id", F.col("text").alias("raw_html"), as_of.alias("extracted_at"), raw_checksum("body").alias("checksum")
    )
    fetched = cut_lineage(numbered(fetched))  # decoded once for all outputs
    ids = items.select(F.col("id").alias("item_id"))
    known = fetched.join(ids, "item_id", "left_semi")
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    missing = F.struct(F.lit("ItemNotFound").alias("code"), F.concat(F.lit("Item "), name, F.lit(" not found")).alias("detail"), F.lit(False).alias("retriable"))
    unknown = fetched.select("item_id").join(ids, "item_id", "left_anti").select("item_id", missing.alias("error"))
    errors = rejected.select("item_id", "error").unionByName(undecodable.select("item_id", "error")).unionByName(unknown)
    return {
        "contents": upsert_raw(contents, known),
        "items": mark_fetched(items, known, as_of),
        "errors": errors,
    }
