"""URL columns: validity, reference resolution, normal form.

Each step adds plain columns to a DataFrame, so that Catalyst evaluates one
part once instead of inlining the same pattern many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.fixed import DEFAULT_PORTS
from pagelake.functions.text import col

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
SPECIAL = r"(?i)^(https?|wss?|ftp):"
WEB_URL = (
    r"(?i)^(https?|wss?|ftp)://([^/?#@\s]*@)?([^/?#@:\s\[\]<>^|%]+|\[[0-9a-f:.]+\])"
    # a port of at most 65535
    r"(:0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])?)?([/?#].*)?$"
)
ENCODED_CHARS = r"[^\x21-\x7E]|[\"<>`{}]"
# parts of a hierarchical URL: scheme, authority, path, query, fragment
PARTS = r"(?s)^([^:/?#]+):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def full_slashes(url: Column) -> Column:
    """Two slashes after a web scheme, as the URL standard reads any number of them."""
    return F.regexp_replace(url, r"(?i)^(https?|wss?|ftp):[/\\]*", "$1://")


def valid_url(url: Column | str) -> Column:
    """True where the text is an absolute URL; web schemes also need a host."""
    u = full_slashes(F.trim(col(url)))
    return F.coalesce(
        F.when(u.rlike(SPECIAL), u.rlike(WEB_URL)).otherwise(u.rlike(SCHEME)), F.lit(False)
    )


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), WEB_URL, 3))


def percent_encode(part: Column) -> Column:
    """Percent-encode blanks, quotes and non-ASCII characters; leave other bytes alone."""
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(part, F.lit(r"(?s)(.)"), F.lit(1)),
            lambda ch: F.when(ch.rlike(ENCODED_CHARS), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20")))
            .otherwise(ch),
        ),
        "",
    )
    return F.when(part.rlike(ENCODED_CHARS), encoded).otherwise(part)


def remove_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    folded = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments) - 1),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(
        path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(folded, "/"), tail)
    ).otherwise(path)


def normalize_url(df: DataFrame, url: str, out: str, keep_fragment: bool = False) -> DataFrame:
    """Add the normal form of a URL column; NULL where the URL is not valid.

    Lower-case scheme and host, no default port, no dot segments, ``/`` for an
    empty path, percent-encoded path and query, no fragment unless asked for.
    Applying it twice changes nothing.
    """
    u = full_slashes(F.regexp_replace(F.trim(F.col(url)), r"[\t\r\n]", ""))
    ports = F.lit("|".join(f"{s}:{p}" for s, p in DEFAULT_PORTS.items()))
    parts = df.withColumns(
        {
            "_ok": valid_url(url),
            "_special": u.rlike(SPECIAL),
            "_plain": u,
        }
    ).withColumns(
        {
            "_scheme": F.lower(F.regexp_extract("_plain", PARTS, 1)),
            "_auth": F.regexp_extract("_plain", PARTS, 2),
            "_path": F.regexp_extract("_plain", PARTS, 3),
            "_query": F.regexp_extract("_plain", PARTS, 4),
            "_frag": F.regexp_extract("_plain", PARTS, 5),
        }
    )
    user = F.regexp_extract("_auth", r"^(.*@)?(.*?)(:[0-9]*)?$", 1)
    host = F.lower(F.regexp_extract("_auth", r"^(.*@)?(.*?)(:[0-9]*)?$", 2))
    port = F.regexp_extract("_auth", r"^(.*@)?(.*?)(:([0-9]*))?$", 4)
    default = F.concat(F.lit("|"), ports, F.lit("|")).contains(
        F.concat(F.lit("|"), F.col("_scheme"), F.lit(":"), port, F.lit("|"))
    )
    shown_port = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path"))
    web = F.concat(
        F.col("_scheme"), F.lit("://"), user, host, shown_port,
        percent_encode(remove_dot_segments(path)),
        percent_encode(F.col("_query")),
        percent_encode(F.col("_frag")) if keep_fragment else F.lit(""),
    )
    plain = F.col("_plain")
    other = F.concat(F.col("_scheme"), F.expr("substring(_plain, char_length(_scheme) + 1)"))
    other = other if keep_fragment else F.regexp_replace(other, r"#.*$", "")
    result = F.when(F.col("_ok") & F.col("_special"), web).when(F.col("_ok") & plain.rlike(SCHEME), other)
    return parts.withColumn(out, result).drop(
        "_ok", "_special", "_plain", "_scheme", "_auth", "_path", "_query", "_frag"
    )


def resolve_reference(df: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """Add the absolute form of ``ref`` against ``base``; the raw text where that fails."""
    r = F.regexp_replace(F.trim(F.col(ref)), r"[\t\r\n]", "")
    b = F.trim(F.col(base))
    staged = df.withColumns(
        {
            "_ref": r,
            "_bscheme": F.regexp_extract(b, PARTS, 1),
            "_bauth": F.regexp_extract(b, PARTS, 2),
            "_bpath": F.regexp_extract(b, PARTS, 3),
            "_bquery": F.regexp_extract(b, PARTS, 4),
        }
    )
    ref_c = F.col("_ref")
    origin = F.concat(F.col("_bscheme"), F.lit("://"), F.col("_bauth"))
    folder = F.coalesce(F.nullif(F.regexp_extract("_bpath", r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    joined = (
        F.when(ref_c.rlike(SCHEME), ref_c)
        .when(ref_c.startswith("//"), F.concat(F.col("_bscheme"), F.lit(":"), ref_c))
        .when(ref_c.startswith("/"), F.concat(origin, ref_c))
        .when(ref_c.startswith("?"), F.concat(origin, F.col("_bpath"), ref_c))
        .when(ref_c.startswith("#") | (ref_c == ""), F.concat(origin, F.col("_bpath"), F.col("_bquery"), ref_c))
        .otherwise(F.concat(origin, folder, ref_c))
    )
    staged = staged.withColumn("_joined", joined)
    return (
        normalize_url(staged, "_joined", "_abs", keep_fragment=True)
        .withColumn(out, F.coalesce(F.col("_abs"), F.col(ref)))
        .drop("_ref", "_bscheme", "_bauth", "_bpath", "_bquery", "_joined", "_abs")
    )
