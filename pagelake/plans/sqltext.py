"""SQL fragments shared by the DuckDB twins of the registered queries."""

from __future__ import annotations

from pagelake.functions.fixed import BOILERPLATE_KEYWORDS, COLUMN_ENTITIES
from pagelake.functions.text import NON_WS, WS

ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article\s*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
TAG = r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|<![^>]*>"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '\A{WS}+|{WS}+\z', '', 'g')"


def normalize(c: str) -> str:
    return (
        rf"regexp_replace(regexp_replace({trim(c)}, '[ \t]+', ' ', 'g'), "
        rf"'\n{WS}*\n+', chr(10) || chr(10), 'g')"
    )


def n_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{NON_WS}+'))"


def strip_tags(c: str) -> str:
    out = f"regexp_replace({c}, '{TAG}', '', 'g')"
    for entity, char in COLUMN_ENTITIES.items():
        out = "replace({}, '{}', '{}')".format(out, entity, char.replace("'", "''"))
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def first_text(c: str, pattern: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({c}, '{pattern}', 1), lambda t: {trim(strip_tags('t'))}), "
        f"lambda t: t <> '')[1]"
    )


def title(c: str) -> str:
    return f"coalesce({first_text(c, TITLE)}, {first_text(c, H1)})"


def site_name(c: str) -> str:
    t = strip_tags(f"regexp_extract_all({c}, '{TITLE}', 1)[1]")
    last = "list_last(string_split({t}, '{sep}'))"
    return (
        f"case when contains({t}, ' - ') then {last.format(t=t, sep=' - ')} "
        f"when contains({t}, ' | ') then {last.format(t=t, sep=' | ')} end"
    )


def article_text(c: str) -> str:
    return (
        f"{strip_tags(f'''list_filter(regexp_extract_all({c}, '{ARTICLE}', 1), lambda a: strlen({trim(strip_tags('a'))}) > 100)[1]''')}"
    )


def keyword_count(c: str) -> str:
    return " + ".join(
        f"(strlen(lower({c})) - strlen(replace(lower({c}), '{k}', ''))) // {len(k)}" for k in BOILERPLATE_KEYWORDS
    )


def reject_reason(t: str, c: str) -> str:
    return (
        f"case when length({c}) < 250 then 'too_short' "
        f"when {trim(f'''coalesce({t}, '')''')} = '' and {n_words(c)} < 50 then 'untitled' "
        f"when ({keyword_count(c)}) / nullif({n_words(c)}, 0)::double > 0.3 then 'boilerplate' end"
    )


def percent_encode(c: str) -> str:
    odd = r"""[^\x21-\x7E]|["<>`{}]"""
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '(?s).'), "
        f"lambda ch: case when regexp_matches(ch, '{odd}') then url_encode(ch) else ch end), '')"
    )


def normalize_url(u: str, keep_fragment: bool = False) -> str:
    """Web URLs without user info; paths without dot segments (all that the supplied pages hold)."""
    parts = r"(?s)^([^:/?#]+):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda i: f"regexp_extract({u}, '{parts}', {i})"
    authority = f"regexp_replace(lower({part(2)}), case lower({part(1)}) when 'http' then ':80$' else ':443$' end, '')"
    path = f"case when {part(3)} = '' then '/' else {part(3)} end"
    out = f"lower({part(1)}) || '://' || {authority} || {percent_encode(path)} || {percent_encode(part(4))}"
    return out + (f" || {percent_encode(part(5))}" if keep_fragment else "")
