"""HTML columns and the one Arrow stage that needs a real parser.

The column forms (regular expressions, JVM-side) are exact for regular markup.
``parse_pages`` handles the rest: it walks a page once with the standard
library's parser and returns the main content and the metadata.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.fixed import (
    COLUMN_ENTITIES, CONTENT_SELECTORS, DEFAULT_PORTS, MIN_MAIN_CONTENT_BYTES, SAFE_ATTRIBUTES, SAFE_SCHEMES,
    SAFE_TAGS, VOID_TAGS,
)
from pagelake.schemas import struct_of
from pagelake.functions.text import WS_CHARS, byte_count, col, utrim

ARTICLE_TAG = r"(?i)</?article\b[^>]*+>"
HEAD_ITEM = r"(?is)<(?:meta\s[^>]*+|title\b[^>]*+>.*?</title\s*|h1\b[^>]*+>.*?</h1\s*)>"
TAG = r"(?s)<(?:/?[a-zA-Z][^>]*+|!--.*?--|![^>]*+)>"
HREF = r'href="([^"]+)"'
SRC = r'src="([^"]+)"'


# ---------------------------------------------------------------- column forms

def html_to_text(html: Column | str) -> Column:
    """Text between tags, nothing put in place of a tag, common entities decoded."""

    def decoded(text: Column) -> Column:
        out = text
        for entity, char in COLUMN_ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(char))
        # browsers also read an ampersand entity that lacks its semicolon; no longer name starts like it
        return F.when(text.contains("&"), F.regexp_replace(out, "&amp;?", "&")).otherwise(text)

    return F.transform(F.array(F.regexp_replace(col(html), TAG, "")), decoded)[0]


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def head_items(html: Column | str) -> Column:
    """All meta tags, titles and top headings of a page, found in one scan."""
    return _all(col(html), HEAD_ITEM)


def _texts(items: Column, tag: str) -> Column:
    return F.transform(F.filter(items, lambda i: i.rlike(f"(?i)^<{tag}\\b")), html_to_text)


def meta_property(items: Column, name: str) -> Column:
    """``content`` of the first ``meta`` with this property that has one; NULL if there is none."""
    quoted = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    wanted = rf"""(?i)^<meta\s[^>]*property\s*=\s*["']{re.escape(name)}["']"""
    first = F.try_element_at(F.filter(items, lambda t: t.rlike(wanted) & t.rlike(quoted)), F.lit(1))
    return html_to_text(F.concat(F.regexp_extract(first, quoted, 1), F.regexp_extract(first, quoted, 2)))


def extract_title(items: Column) -> Column:
    """og:title as it is, else the first title, else the first heading with text, else NULL."""
    texts = F.transform(F.concat(_texts(items, "title"), _texts(items, "h1")), utrim)
    first = F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1))
    return F.coalesce(meta_property(items, "og:title"), first)


def extract_site_name(items: Column) -> Column:
    """og:site_name, else what follows the last `` - `` or `` | `` of the first title, else NULL."""
    title = F.try_element_at(_texts(items, "title"), F.lit(1))
    tail = F.transform(
        F.array(title),
        lambda t: F.when(t.contains(" - "), F.substring_index(t, " - ", -1)).when(
            t.contains(" | "), F.substring_index(t, " | ", -1)
        ),
    )[0]
    return F.coalesce(meta_property(items, "og:site_name"), tail)


def article_tags(html: Column | str) -> Column:
    return _all(col(html), ARTICLE_TAG)


def article_parts(html: Column | str) -> Column:
    """Page source cut at article tags: outside, inside, outside, ..."""
    return F.split(col(html), ARTICLE_TAG)


def without_hidden(html: Column | str) -> Column:
    """The page without comments, scripts and styles, whose content is never markup."""
    return F.regexp_replace(col(html), r"(?is)<!--.*?-->|<(script|style)\b[^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+>.*?</\1\s*>", "")


def is_regular(html: Column | str, plain: Column, items: Column, tags: Column, parts: Column, text: Column) -> Column:
    """True where the column forms give what the parser would give.

    ``plain`` is the page without comments, scripts and styles, from which the
    others come. There must be one ``article`` with enough text that is the same
    in the page itself, with no textarea or unfinished tag inside, and no entity
    but the ones that the columns decode; nowhere may a tag have ``<`` or ``>``
    inside quotes, nor a hidden part begin that does not end. Titles must pair
    and hold no markup.
    """
    special = r"template|noscript|svg|math|plaintext|xmp|iframe|textarea"
    known = "|".join(e[1:] for e in (*COLUMN_ENTITIES, "&amp;"))
    other_entity = rf"&(?!(?:{known}))[#a-zA-Z]"
    one = (F.size(tags) == 2) & ~tags[0].startswith("</") & tags[1].startswith("</")
    enough = byte_count(utrim(text)) > MIN_MAIN_CONTENT_BYTES
    odd = parts[1].rlike(
        rf"(?i)<(?:(?:script|style|textarea|title|{special})\b|(?!/?[a-z][a-z0-9]*+(?:\s[^<>]*+)?/?>))|{other_entity}"
    )
    odd_head = parts[0].rlike(rf"(?i)<(?:{special})\b")
    odd_item = F.exists(items, lambda i: i.rlike(other_entity))
    odd_quotes = plain.rlike(r"""<[a-zA-Z][^<>"']*+(?:(?:"[^"<>]*+"|'[^'<>]*+')[^<>"']*+)*+["']""")
    left_over = plain.rlike(r"(?i)<(?:!--|script\b|style\b)") | col(html).rlike(r"(?is)<(?:title|textarea)\b[^>]*+>[^<]*+<(?:!--|script\b|style\b)")
    same = col(html).contains(F.concat(tags[0], parts[1], tags[1]))
    titles = F.size(F.filter(items, lambda i: i.rlike("(?i)^<title\\b")))
    paired = (F.regexp_count(plain, F.lit(r"(?i)<title\b")) == titles) & (F.regexp_count(plain, F.lit(r"(?i)</title\b")) == titles)
    bare = ~F.exists(items, lambda i: i.rlike(r"(?is)^<title\b[^>]*+>[^<]*+<(?!/title)"))
    no_odd_characters = ~(col(html).contains("\r") | col(html).contains("\x00"))
    return F.coalesce(one & enough & ~odd & ~odd_head & ~odd_item & ~odd_quotes & ~left_over & same & paired & bare & no_odd_characters, F.lit(False))


# ----------------------------------------------------- the Arrow stage (parser)

def serialize_url(url: str) -> str:
    """URL as a browser would print it: lower-case host, no default port, percent-encoded path."""
    parts = urlsplit(url)
    if parts.scheme.lower() not in DEFAULT_PORTS:
        return url
    user, at, place = parts.netloc.rpartition("@")
    host, port = re.fullmatch(r"(.*?)(?::(\d*))?", place, re.S).groups()
    shown = f":{port}" if port and port != DEFAULT_PORTS[parts.scheme.lower()] else ""
    netloc = user + at + host.lower() + shown
    keep = "%/:@!$&'()*+,;=~-._|^[]\\"
    return urlunsplit(
        (parts.scheme.lower(), netloc, quote(parts.path or "/", safe=keep), quote(parts.query, safe=keep + "?"),
         quote(parts.fragment, safe=keep + "?"))
    )


def absolute_links(html: str, base: str) -> str:
    """Rewrite double-quoted ``href`` and ``src`` values to absolute URLs; keep what does not parse."""

    def rewrite(match: re.Match[str]) -> str:
        try:
            return f'{match[1]}="{serialize_url(urljoin(base, match[2]))}"'
        except ValueError:
            return match[0]

    for name in ("href", "src"):
        html = re.sub(rf'({name})="([^"]+)"', rewrite, html)
    return html


class _Cleaner(HTMLParser):
    """Re-emits safe markup only; the content of script and style goes too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.muted = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.muted or tag in ("script", "style"):
            self.muted = self.muted or tag
            return
        if tag not in SAFE_TAGS:
            return
        names = SAFE_ATTRIBUTES.get(tag, ()) + SAFE_ATTRIBUTES["*"]
        kept = "".join(
            f' {k}="{escape(v or "")}"' for k, v in attrs if k in names and (k not in ("href", "src", "cite") or _safe_url(v))
        )
        self.out.append(f"<{tag}{kept}>")
        if tag not in VOID_TAGS:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.muted:
            self.muted = "" if tag == self.muted else self.muted
        elif tag in self.open:
            while True:
                top = self.open.pop()
                self.out.append(f"</{top}>")
                if top == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.out.append(escape(data, quote=False))


def _safe_url(value: str | None) -> bool:
    scheme = re.match(r"[\s\x00-\x20]*([a-zA-Z][a-zA-Z0-9+.\-\s\x00-\x20]*):", value or "")
    return scheme is None or re.sub(r"[\s\x00-\x20]", "", scheme[1]).lower() in SAFE_SCHEMES


def sanitize(html: str) -> str:
    cleaner = _Cleaner()
    cleaner.feed(html)
    cleaner.close()
    return "".join(cleaner.out + [f"</{tag}>" for tag in reversed(cleaner.open)])


class _Page(HTMLParser):
    """Collects metadata and the text and source span of every main-content candidate."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.starts = [0]
        for line in html.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.html, self.size = html, len(html)
        self.meta: dict[str, str] = {}
        self.texts: list[str] = []
        self.open: list[tuple[str, list[dict]]] = []
        # candidate: selector rank, first and last text, first and last character
        self.found: list[dict] = []
        self.feed(html)
        self.close()
        for _, started in self.open:
            for c in started:
                c.update(t1=len(self.texts), s1=self.size)

    def here(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = dict(reversed(attrs))
        if tag == "meta" and values.get("property") in ("og:title", "og:site_name") and values.get("content") is not None:
            self.meta.setdefault(values["property"], values["content"])
        if tag in VOID_TAGS:
            return
        classes = (values.get("class") or "").split()
        ranks = [
            r for r, s in enumerate(CONTENT_SELECTORS)
            if s == tag or (s[0] == "." and s[1:] in classes) or (s[0] == "#" and s[1:] == values.get("id"))
            or (s[0] == "[" and values.get("role") == "main")
        ]
        names = ranks + [n for n in ("title", "h1", "body", "head") if n == tag]
        started = [{"rank": r, "t0": len(self.texts), "s0": self.here()} for r in names]
        self.found += started
        self.open.append((tag, started))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a trailing slash does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        begin = self.here()
        while True:
            top, started = self.open.pop()
            # an element ends after its own end tag, or before the end tag of its ancestor
            end = self.html.find(">", begin) + 1 or self.size if top == tag else begin
            for c in started:
                c.update(t1=len(self.texts), s1=end)
            if top == tag:
                return

    def handle_data(self, data: str) -> None:
        self.texts.append(data)

    def text(self, c: dict) -> str:
        return "".join(self.texts[c["t0"]:c["t1"]])


def read_page(html: str) -> tuple[str | None, str | None, str, str, str]:
    """(title, site name, main text, main HTML, selector) of one page."""
    page = _Page(html)
    of = lambda rank: (c for c in page.found if c["rank"] == rank)
    texts = [page.text(c).strip(WS_CHARS) for name in ("title", "h1") for c in of(name)]
    title = page.meta.get("og:title", next((t for t in texts if t), None))
    first = next((page.text(c) for c in of("title")), "")
    tails = [first.rpartition(mark)[2] for mark in (" - ", " | ") if mark in first]
    site = page.meta.get("og:site_name", tails[0] if tails else None)
    for rank, selector in enumerate(CONTENT_SELECTORS):
        for c in of(rank):
            text = page.text(c)
            if len(text.strip(WS_CHARS).encode()) > MIN_MAIN_CONTENT_BYTES:
                return title, site, text, html[c["s0"]:c["s1"]], selector
    body = next(of("body"), None)
    if body is None:  # the body of a page without the tag is all that follows the head
        head = next(of("head"), None) or next(of("title"), None) or {"t1": 0, "s1": 0}
        body = {"t0": head["t1"], "t1": len(page.texts), "s0": head["s1"], "s1": page.size}
    return title, site, page.text(body), html[body["s0"]:body["s1"]], "body"


PAGE_PARTS = struct_of("title string, site_name string, text string, html string, selector string")


@F.pandas_udf(PAGE_PARTS)
def parse_pages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Page parts as a struct; all NULL where the input is NULL."""
    for pages in batches:
        yield pd.DataFrame([(None,) * 5 if h is None else read_page(h) for h in pages], columns=PAGE_PARTS.names, dtype="object")


@F.pandas_udf(T.StringType())
def sanitize_html(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Safe HTML with absolute links; arguments are the HTML and the base URL (NULL: leave links)."""
    for pages, bases in batches:
        yield pd.Series(
            [
                None if h is None else sanitize(h) if b is None else absolute_links(sanitize(h), b)
                for h, b in zip(pages, bases)
            ],
            dtype="object",
        )
