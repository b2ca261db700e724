import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagelake.functions.html import serialize_url
from pagelake.functions.urls import normalize_url, resolve_reference, url_host, valid_url

VALID = {
    "https://example.com": True, "http://a.b/c?d#e": True, "HTTPS://EXAMPLE.com:8443/": True, "mailto:x@y.z": True,
    "http://[::1]:80/": True, "": False, "not-a-url": False, "/relative": False, "http://": False, "http:///x": True, "http:/example.com": True, "http:example.com": True, "https:\\\\h": True,
    "http://h:65535/": True, "http://h:65536/": False, "http://h:99999/": False, "http://h:000080/": True,
    "http://a b/": False, "//host/x": False, "https://user:pw@host/": True,
}

NORMAL = {
    "HTTP://Example.COM:80": "http://example.com/",
    "https://example.com:443/a/../b/./c#frag": "https://example.com/b/c",
    "https://example.com:8443/?q=1#f": "https://example.com:8443/?q=1",
    "http://example.com/a/b/..": "http://example.com/a/",
    "http://example.com/für alle": "http://example.com/f%C3%BCr%20alle",
    "http://example.com/a%20b?x=é": "http://example.com/a%20b?x=%C3%A9",
    "http://example.com/../../x": "http://example.com/x",
    "http://User@Example.com/": "http://User@example.com/",
    "mailto:Joe@Example.com": "mailto:Joe@Example.com",
    "http:/example.com/x": "http://example.com/x",
    "http://example.com:99999/": None,
    "nonsense": None,
}

BASE = "https://example.com/article/one?x=1#top"
RESOLVED = {
    "/page": "https://example.com/page",
    "image.jpg": "https://example.com/article/image.jpg",
    "../up": "https://example.com/up",
    "?y=2": "https://example.com/article/one?y=2",
    "#frag": "https://example.com/article/one?x=1#frag",
    "//cdn.example.net/x": "https://cdn.example.net/x",
    "http://Other.com": "http://other.com/",
    "mailto:a@b.c": "mailto:a@b.c",
    "/für": "https://example.com/f%C3%BCr",
    "./a/./b/../c/": "https://example.com/article/a/c/",
    "http://": "http://",
}


def _column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "u string")


def test_valid(spark):
    got = {r.u: r.v for r in _column(spark, VALID).select("u", valid_url("u").alias("v")).collect()}
    assert got == VALID


def test_host(one):
    assert one(url_host("u"), u="https://u:p@Example.COM:80/x") == "example.com"


def test_normal_form_and_idempotence(spark):
    once = normalize_url(_column(spark, NORMAL), "u", "n")
    got = {r.u: (r.n, r.m) for r in normalize_url(once, "n", "m").collect()}
    assert {u: n for u, (n, _) in got.items()} == NORMAL
    assert all(n == m for n, m in got.values())


def test_resolve(spark):
    df = spark.createDataFrame([(BASE, r) for r in RESOLVED], "b string, r string")
    got = {x.r: x.a for x in resolve_reference(df, "b", "r", "a").collect()}
    assert got == RESOLVED


@pytest.mark.parametrize("ref", [r for r in RESOLVED if r not in ("http://",)])
def test_parser_side_agrees(ref):
    from urllib.parse import urljoin

    assert serialize_url(urljoin(BASE, ref)) == RESOLVED[ref]


URLS = st.builds(
    "{}://{}{}{}{}{}".format, st.sampled_from(["http", "HTTPS", "ftp"]), st.sampled_from(["a.b", "Ü.example", "u:p@H.org", "[::1]"]),
    st.sampled_from(["", ":80", ":443", ":8080", ":"]),
    st.lists(st.sampled_from(["/", "/.", "/..", "/a", "/%41", "/ü b", "/{x}", "/..."]), max_size=5).map("".join),
    st.sampled_from(["", "?", "?q=1&r=é", "?a b"]), st.sampled_from(["", "#", "#f/../g"]),
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(URLS, min_size=80, max_size=80))
def test_normal_form_is_idempotent(spark, urls):
    once = normalize_url(_column(spark, urls), "u", "n")
    for r in normalize_url(once, "n", "m").collect():
        assert r.n is not None and r.n == r.m, r.u
        assert "#" not in r.n and "/../" not in r.n and " " not in r.n
