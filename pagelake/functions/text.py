"""Text columns: trimming, whitespace, counting, checksums, tokens.

Everything here is a Column expression evaluated in the JVM. Whitespace means
Unicode White_Space: ``(?U)`` makes Java's classes follow it, and the trim set
is spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.fixed import BOILERPLATE_KEYWORDS

WS_RANGES = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_RANGES}]"
NON_WS = f"[^{WS_RANGES}]"
WS_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD_PATTERN = r"[\p{L}\p{N}]++"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that costly patterns feed, each evaluated once per row.

    Catalyst substitutes a column's definition into the filters and projections
    above it, which repeats costly expressions; it does not look through a generator.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def utrim(c: Column | str) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def normalize_whitespace(c: Column | str) -> Column:
    """Trim, then runs of blanks to one space, then runs of blank lines to one."""
    # a single blank needs no replacing
    spaced = F.regexp_replace(utrim(c), r"[ \t]{2,}|\t", " ")
    return F.regexp_replace(spaced, r"(?U)\n\s*\n+", "\n\n")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"(?U)\S++")).cast("bigint")


def char_count(c: Column | str) -> Column:
    return F.char_length(col(c)).cast("bigint")


def byte_count(c: Column | str) -> Column:
    return F.octet_length(col(c)).cast("bigint")


def content_checksum(html: Column | str, text: Column | str) -> Column:
    """md5 over the clean HTML bytes followed by the clean text bytes."""
    return F.md5(F.concat(col(html), col(text)))


def raw_checksum(body: Column | str) -> Column:
    return F.md5(col(body))


def keyword_count(c: Column | str, keywords: tuple[str, ...] = BOILERPLATE_KEYWORDS) -> Column:
    """Occurrences per keyword, then summed, so overlapping keywords each count.

    A literal pattern is searched by skipping (Boyer-Moore), which one big
    alternation is not. ``transform`` binds the lower-cased text once per row.
    """

    def total(text: Column) -> Column:
        return sum((F.regexp_count(text, F.lit(re.escape(k))) for k in keywords), F.lit(0)).cast("bigint")

    return F.transform(F.array(F.lower(col(c))), total)[0]


def boilerplate_ratio(
    c: Column | str, words: Column | None = None, keywords: tuple[str, ...] = BOILERPLATE_KEYWORDS
) -> Column:
    """Keyword occurrences per word; NULL where there is no word."""
    words = word_count(c) if words is None else words
    return F.try_divide(keyword_count(c, keywords).cast("double"), words.cast("double"))


def words(c: Column | str) -> Column:
    """Letter or digit runs in their own case, in text order."""
    return F.regexp_extract_all(col(c), F.lit(WORD_PATTERN), F.lit(0))


def tokenize_simple(c: Column | str) -> Column:
    """Lower-case letter or digit runs; no stemming, no stop words."""
    return F.transform(words(c), lambda w: F.lower(w))
