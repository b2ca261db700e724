"""Page tables: metadata, main content, links, safe HTML, clean text, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.html import (
    HREF, SRC, article_parts, article_tags, extract_site_name, extract_title, head_items, html_to_text, is_regular, parse_pages,
    sanitize_html, without_hidden,
)
from pagelake.functions.text import (
    boilerplate_ratio, byte_count, char_count, compute_once, content_checksum, normalize_whitespace, raw_checksum, word_count,
)
from pagelake.functions.urls import resolve_reference, url_host


def page_parts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add title, site_name, main_text, main_html and selector.

    Pages with regular markup are read by JVM columns. Only the others reach the
    Arrow stage (it is handed NULL for the rest), which runs once for all parts.
    """
    staged = compute_once(pages, {"_plain": without_hidden(html)})
    staged = compute_once(
        staged, {"_items": head_items("_plain"), "_tags": article_tags("_plain"), "_parts": article_parts("_plain")}
    )
    tags, parts = F.col("_tags"), F.col("_parts")
    staged = compute_once(staged, {"_text": F.when(F.size(tags) == 2, html_to_text(parts[1]))})
    staged = compute_once(staged, {"_regular": is_regular(html, F.col("_plain"), F.col("_items"), tags, parts, F.col("_text"))})
    staged = staged.withColumn("_parsed", parse_pages(F.when(~F.col("_regular"), F.col(html))))

    def pick(native, parsed):
        return F.when(F.col("_regular"), native).otherwise(F.col(f"_parsed.{parsed}"))

    return compute_once(
        staged,
        {
            "title": pick(extract_title(F.col("_items")), "title"),
            "site_name": pick(extract_site_name(F.col("_items")), "site_name"),
            "main_text": pick(F.col("_text"), "text"),
            "main_html": pick(F.concat(tags[0], parts[1], tags[1]), "html"),
            "selector": pick(F.lit("article"), "selector"),
        },
    ).drop("_plain", "_items", "_tags", "_parts", "_text", "_regular", "_parsed")


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add title and site_name."""
    return page_parts(pages, html).drop("main_text", "main_html", "selector")


def main_content_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add main_text, main_html and the selector that found them (``body`` as the last resort)."""
    return page_parts(pages, html).drop("title", "site_name")


def article_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add main_text of the ``article`` selector; NULL where there is none."""
    parts = page_parts(pages, html)
    text = F.when(F.col("selector") == "article", F.col("main_text"))
    return parts.withColumn("main_text", text).drop("title", "site_name", "main_html", "selector")


def link_edges(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per double-quoted ``href`` or ``src``: key, kind, pos, raw, absolute, host."""

    def links(kind: str, pattern: str):
        raw = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
        return F.transform(raw, lambda r, i: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("pos"), r.alias("raw")))

    rows = pages.select(key, url, F.explode(F.concat(links("href", HREF), links("src", SRC))).alias("link"))
    rows = rows.select(key, url, "link.kind", "link.pos", "link.raw")
    resolved = resolve_reference(rows, url, "raw", "absolute")
    return resolved.withColumn("host", F.nullif(url_host("absolute"), F.lit(""))).drop(url)


def sanitize_table(pages: DataFrame, html: str = "html", url: str | None = "url") -> DataFrame:
    """Add clean_html: safe markup only, links made absolute against the page URL."""
    base = F.col(url) if url else F.lit(None).cast("string")
    return pages.withColumn("clean_html", sanitize_html(F.col(html), base))


def clean_text_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add clean_text and its size in characters, bytes and words."""
    return compute_once(docs, {"clean_text": normalize_whitespace(text)}).withColumns(
        {"n_chars": char_count("clean_text"), "n_bytes": byte_count("clean_text"), "n_words": word_count("clean_text")}
    )


def checksum_table(docs: DataFrame, html: str = "clean_html", text: str = "clean_text", body: str = "body") -> DataFrame:
    """Add content_checksum over the clean parts and raw_checksum over the body."""
    return docs.withColumns({"content_checksum": content_checksum(html, text), "raw_checksum": raw_checksum(body)})


def boilerplate_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add boilerplate_ratio (keyword occurrences per word)."""
    return docs.withColumn("boilerplate_ratio", boilerplate_ratio(text))
