"""Quality verdicts and field checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.fixed import MAX_BOILERPLATE_RATIO, MIN_CONTENT_CHARS, MIN_UNTITLED_WORDS
from pagelake.functions.text import NON_WS, WS_RANGES, boilerplate_ratio, col, utrim, word_count

EMAIL = rf"\A[^{WS_RANGES}@]+@[^{WS_RANGES}@]+\.[^{WS_RANGES}@]+\z"
MAX_URL_BYTES = 2048


def reject_reason(title: Column | str, text: Column | str) -> Column:
    """Why a document is rejected; NULL for a good one. Checks run in this order."""
    words = word_count(text)
    untitled = utrim(F.coalesce(col(title), F.lit(""))) == ""
    return (
        F.when(F.char_length(col(text)) < MIN_CONTENT_CHARS, "too_short")
        .when(untitled & (words < MIN_UNTITLED_WORDS), "untitled")
        .when(F.coalesce(boilerplate_ratio(text, words) > MAX_BOILERPLATE_RATIO, F.lit(False)), "boilerplate")
    )


def reject_content(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    return df.withColumn("reason", reject_reason(title, text))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One (rule, key) row per broken rule; ``rules`` maps a rule name to a condition that is true when broken."""
    broken = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda name: name.isNotNull()
    )
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def validate_urls(df: DataFrame, url: str, key: str) -> DataFrame:
    """(rule, key) for URLs that are empty or longer than 2048 bytes."""
    size = F.octet_length(url)
    return violations(df, key, {"URL cannot be empty": size == 0, "URL too long": size > MAX_URL_BYTES})


def validate_emails(df: DataFrame, email: str, key: str) -> DataFrame:
    """(rule, key) for texts that are not an e-mail address."""
    return violations(df, key, {"Invalid email": ~F.col(email).rlike(EMAIL)})


def check_domains(
    df: DataFrame,
    key: str,
    domains: dict[str, tuple[str, ...]] | None = None,
    not_null: list[str] | None = None,
    non_negative: list[str] | None = None,
) -> DataFrame:
    """(rule, key) rows for values outside a domain, missing values, negative counters; one pass."""
    rules: dict[str, Column] = {}
    for name, allowed in (domains or {}).items():
        rules[f"{name} domain"] = F.col(name).isNotNull() & ~F.col(name).isin(*allowed)
    for name in not_null or []:
        rules[f"{name} not null"] = F.col(name).isNull()
    for name in non_negative or []:
        rules[f"{name} >= 0"] = F.col(name) < 0
    return violations(df, key, rules)


def non_blank(c: Column | str) -> Column:
    return col(c).rlike(NON_WS)
