"""Crawl responses: gate, retry classes, transport errors, redirects, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.charset import decode_body, detect_charset, encoding_name
from pagelake.functions.fixed import ACCEPTED_TYPES, FATAL_FETCH_ERRORS, MAX_BODY_BYTES, MAX_REDIRECTS
from pagelake.functions.text import compute_once
from pagelake.functions.urls import valid_url


def header(headers: Column, name: str) -> Column:
    """Header value by case-insensitive name; NULL where it is missing."""
    hit = F.map_filter(headers, lambda k, _: F.lower(k) == name.lower())
    return F.try_element_at(F.map_values(hit), F.lit(1))


def is_retriable(code: Column, status: Column) -> Column:
    """Whether a fetch error is worth another attempt."""
    return (
        F.when(code.isin(*FATAL_FETCH_ERRORS), F.lit(False))
        .when(code == "Http", F.coalesce(status.between(500, 599), F.lit(False)))
        .when(code.isNotNull(), F.lit(True))
    )


def classify_fetch_error(df: DataFrame, code: str = "code", status: str = "status") -> DataFrame:
    return df.withColumn("retriable", is_retriable(F.col(code), F.col(status)))


def with_error(responses: DataFrame, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Add ``content_type`` and the first gate a response fails as ``error`` (NULL when it passes)."""
    df = responses.withColumn(
        "content_type", F.coalesce(header(F.col("headers"), "content-type"), F.lit("text/html"))
    )
    supported = F.lit(False)
    for kind in ACCEPTED_TYPES:
        supported = supported | F.col("content_type").contains(kind)
    size = F.octet_length("body").cast("bigint")
    code = (
        F.when(~valid_url("url"), "InvalidUrl")
        .when(F.col("declared_length") > max_bytes, "BodyTooLarge")
        .when(~F.col("status").between(200, 299), "Http")
        .when(~supported, "UnsupportedContentType")
        .when(size > max_bytes, "BodyTooLarge")
    )
    detail = (
        F.when(F.col("_code") == "InvalidUrl", F.col("url"))
        .when(
            F.col("_code") == "BodyTooLarge",
            F.when(F.col("declared_length") > max_bytes, F.col("declared_length")).otherwise(size).cast("string"),
        )
        .when(F.col("_code") == "Http", F.col("status").cast("string"))
        .when(F.col("_code") == "UnsupportedContentType", F.col("content_type"))
    )
    error = F.when(
        F.col("_code").isNotNull(),
        F.struct(
            F.col("_code").alias("code"),
            detail.alias("detail"),
            is_retriable(F.col("_code"), F.col("status")).alias("retriable"),
        ),
    )
    return compute_once(df, {"_code": code}).withColumn("error", error).drop("_code")


def gate_responses(responses: DataFrame, max_bytes: int = MAX_BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """Split responses into (accepted, rejected); rejected rows carry ``error``."""
    judged = with_error(responses, max_bytes)
    accepted = judged.filter(F.col("error").isNull()).drop("error")
    rejected = judged.filter(F.col("error").isNotNull()).drop("body")
    return accepted, rejected


def map_transport_error(df: DataFrame) -> DataFrame:
    """Error code from the flags of a failed request; flags are boolean columns, status may be NULL."""
    code = (
        F.when(F.col("is_timeout") & F.col("is_connect"), "ConnectTimeout")
        .when(F.col("is_timeout"), "RequestTimeout")
        .when(F.col("is_redirect"), "RedirectLoop")
        .when(F.col("status").isNotNull(), "Http")
        .when(F.col("is_request"), "Dns")
        .otherwise("Unknown")
    )
    return df.withColumn("code", code).withColumn("retriable", is_retriable(F.col("code"), F.col("status")))


def resolve_redirects(starts: DataFrame, edges: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """Final URL of every start URL, or code ``RedirectLoop`` past ``max_hops``.

    ``edges`` is (url, location) with one location per url. The starts are the
    frontier: hop by hop they meet the edges that leave it, in a join that
    builds the frontier and streams the edges past it. The edges are dealt by
    url once, and every hop reads that same exchange; start URLs that many rows
    share are followed once. Nothing is written or run on the way.
    """
    step = edges.filter(F.col("location").isNotNull()).select(F.col("url").alias("_from"), F.col("location").alias("_to"))
    reached = starts.select("url").distinct().select("url", F.col("url").alias("at"), F.lit(0).alias("hops"))
    for _ in range(max_hops + 1):  # an edge found at the last step means that the limit was exceeded
        met = reached.hint("shuffle_hash").join(step, F.col("at") == F.col("_from"), "left")
        reached = met.select("url", F.coalesce("_to", "at").alias("at"), (F.col("hops") + F.col("_to").isNotNull().cast("int")).alias("hops"))
    done = F.col("hops") <= max_hops
    resolved = reached.select(
        "url",
        F.when(done, F.col("at")).alias("final_url"),
        F.when(done, F.col("hops")).cast("bigint").alias("hops"),
        F.when(~done, F.lit("RedirectLoop")).alias("code"),
    )
    return starts.join(resolved, "url", "left")


def decode_responses(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``charset`` and ``text``; rows that do not decode come second, with a Charset error."""
    df = compute_once(accepted, {"charset": detect_charset(F.col("content_type"), F.col("body"))})
    df = compute_once(df, {"text": decode_body(F.col("body"), F.col("charset"))})
    decoded = df.filter(F.col("text").isNotNull())
    failed = df.filter(F.col("text").isNull()).drop("text", "body").withColumn(
        "error",
        F.struct(
            F.lit("Charset").alias("code"),
            F.concat(F.lit("Failed to decode content with encoding: "), encoding_name(F.col("charset"))).alias("detail"),
            F.lit(False).alias("retriable"),
        ),
    )
    return decoded, failed
