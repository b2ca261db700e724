"""Charset detection and decoding of response bodies."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.fixed import CHARSET_LABELS, CHARSET_SNIFF_BYTES, ENCODING_NAMES, OTHER_CHARSET_LABELS

# Where a charset label is read from.
HEADER_PATTERN = r"""(?i)charset\s*=\s*["']?([^"'\s;]+)"""
META_PATTERN = r"""(?i)<meta\s+[^>]*?charset\s*=\s*["']?([^"'\s/>]+)"""

# The Python codec that reads each charset the way web browsers do.
CODECS = {
    "Windows1252": "cp1252",
    "ShiftJis": "cp932",
    "Gb2312": "gb18030",
    "Big5": "big5hkscs",
}


def charset_label(label: Column) -> Column:
    """Charset name for a web encoding label; NULL where the label is unknown."""
    name = F.lower(label)
    out = F.when(name.isin(*OTHER_CHARSET_LABELS), F.lit("Other"))
    for charset, labels in CHARSET_LABELS.items():
        out = F.when(name.isin(*labels), F.lit(charset)).otherwise(out)
    return F.when(name == "", F.lit(None).cast("string")).otherwise(out)


def encoding_name(charset: Column) -> Column:
    """The standard's name of the encoding that reads a charset."""
    table = F.create_map(*[F.lit(x) for pair in ENCODING_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, charset), charset)


def sniffed_text(body: Column) -> Column:
    """The first bytes of a body as text in which every byte is one character."""
    return F.decode(F.substring(body, 1, CHARSET_SNIFF_BYTES), "ISO-8859-1")


def is_utf8(body: Column) -> Column:
    return F.is_valid_utf8(body.cast("string"))


def detect_charset(content_type: Column, body: Column) -> Column:
    """Header label, then a meta label near the start, then a guess from the bytes.

    A meta tag with ``http-equiv`` also carries ``charset=`` inside its content
    attribute, so one pattern covers both forms. The guess is UTF-8 where the
    sniffed bytes are ASCII or the body is valid UTF-8, windows-1252 otherwise.
    """
    header = F.regexp_extract(F.coalesce(content_type, F.lit("")), HEADER_PATTERN, 1)
    meta = F.regexp_extract(sniffed_text(body), META_PATTERN, 1)
    guess = F.when(is_utf8(body), F.lit("Utf8")).otherwise(F.lit("Windows1252"))
    return F.coalesce(charset_label(header), charset_label(meta), guess)


def _control_character(error: UnicodeDecodeError) -> tuple[str, int]:
    # the five unassigned bytes of windows-1252 are control characters on the web
    return chr(error.object[error.start]), error.start + 1


def _decode_bytes(body: bytes, charset: str) -> str | None:
    codecs.register_error("control", _control_character)
    wide = body.startswith((b"\xff\xfe", b"\xfe\xff"))
    codec = "utf-16" if wide else CODECS[charset]
    try:
        return body.decode(codec, "control" if codec == "cp1252" else "strict")
    except UnicodeDecodeError:
        return None


@F.pandas_udf(T.StringType())
def _decode_other(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for bodies, charsets in batches:
        yield pd.Series(
            [None if b is None else _decode_bytes(bytes(b), c) for b, c in zip(bodies, charsets)],
            dtype="object",
        )


def decode_body(body: Column, charset: Column) -> Column:
    """Body as text; NULL where any byte sequence is malformed.

    A byte order mark (UTF-8 or UTF-16) says more than the label. UTF-8 stays in the JVM. Other charsets go through one Arrow stage, which is
    handed NULL instead of the bytes for every UTF-8 row.
    """
    bom16 = F.coalesce(F.hex(F.substring(body, 1, 2)).isin("FFFE", "FEFF"), F.lit(False))
    bom8 = F.coalesce(F.hex(F.substring(body, 1, 3)) == "EFBBBF", F.lit(False))
    native = bom8 | (charset.isin("Utf8", "Other") & ~bom16)
    text = F.regexp_replace(F.try_validate_utf8(body.cast("string")), r"\A\x{FEFF}", "")
    other = _decode_other(F.when(~native, body), F.when(~native, F.coalesce(charset, F.lit(""))))
    return F.when(native, text).otherwise(other)
