from pyspark.sql import functions as F

from pagelake.operators.responses import (
    classify_fetch_error, decode_responses, gate_responses, map_transport_error, resolve_redirects,
)
from pagelake.schemas import RESPONSES
from pagelake.sources.tables import scan_responses

HTML = bytearray(b"<html><body>x</body></html>")
MIB = 1024 * 1024


def _rows(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], RESPONSES)


def test_gate(spark):
    rows = [
        ("https://a.example/ok", 200, {"Content-Type": "text/html; charset=utf-8"}, None, HTML),
        ("https://a.example/xhtml", 204, {"content-type": "application/xhtml+xml"}, None, HTML),
        ("https://a.example/none", 200, {}, None, HTML),
        ("https://a.example/404", 404, {"content-type": "text/html"}, None, HTML),
        ("https://a.example/500", 500, {"content-type": "image/png"}, None, HTML),
        ("https://a.example/jpeg", 200, {"content-type": "image/jpeg"}, None, HTML),
        ("https://a.example/upper", 200, {"content-type": "TEXT/HTML"}, None, HTML),
        ("not a url", 404, {}, None, HTML),
        ("https://a.example/declared", 404, {}, 6 * MIB, HTML),
        ("https://a.example/at-limit", 200, {}, 5 * MIB, bytearray(5 * MIB)),
        ("https://a.example/big", 200, {}, None, bytearray(6 * MIB)),
    ]
    accepted, rejected = gate_responses(_rows(spark, rows))
    assert {r.url.rpartition("/")[2] for r in accepted.select("url").collect()} == {"ok", "xhtml", "none", "at-limit"}
    got = {r.url.rpartition("/")[2]: tuple(r.error) for r in rejected.select("url", "error").collect()}
    assert got == {
        "404": ("Http", "404", False), "500": ("Http", "500", True), "jpeg": ("UnsupportedContentType", "image/jpeg", False),
        "upper": ("UnsupportedContentType", "TEXT/HTML", False), "not a url": ("InvalidUrl", "not a url", False),
        "declared": ("BodyTooLarge", str(6 * MIB), False), "big": ("BodyTooLarge", str(6 * MIB), False),
    }


def test_retry_table(spark):
    want = {
        ("InvalidUrl", None): False, ("BodyTooLarge", None): False, ("UnsupportedContentType", None): False,
        ("Charset", None): False, ("Http", 404): False, ("Http", 500): True, ("Http", 599): True, ("Dns", None): True,
        ("ConnectTimeout", None): True, ("RequestTimeout", None): True, ("RedirectLoop", None): True, ("Tls", None): True,
        ("Io", None): True, ("Unknown", None): True,
    }
    df = spark.createDataFrame(list(want), "code string, status int")
    assert {(r.code, r.status): r.retriable for r in classify_fetch_error(df).collect()} == want


def test_transport(spark):
    rows = [
        (True, True, True, 500, True, "ConnectTimeout"), (True, False, True, 500, True, "RequestTimeout"),
        (False, True, True, 500, True, "RedirectLoop"), (False, True, False, 503, True, "Http"),
        (False, False, False, None, True, "Dns"), (False, False, False, None, False, "Unknown"),
    ]
    df = spark.createDataFrame(rows, "is_timeout boolean, is_connect boolean, is_redirect boolean, status int, is_request boolean, want string")
    assert all(r.code == r.want for r in map_transport_error(df).collect())


def test_redirects(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(11)]
    edges = spark.createDataFrame([*chain, ("l0", "l1"), ("l1", "l0"), ("s", "/final")], "url string, location string")
    starts = spark.createDataFrame([("c0",), ("c1",), ("c7",), ("l0",), ("s",), ("plain",), ("s",)], "url string")
    got = [(r.url, r.final_url, r.hops, r.code) for r in resolve_redirects(starts, edges).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("c0", None, None, "RedirectLoop"), ("c1", "c11", 10, None), ("c7", "c11", 4, None),
            ("l0", None, None, "RedirectLoop"), ("s", "/final", 1, None), ("s", "/final", 1, None), ("plain", "plain", 0, None),
        ],
        key=str,
    )


def test_every_chain_length(spark):
    n = 15
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)], "url string, location string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(n + 1)], "url string")
    for r in resolve_redirects(starts, edges).collect():
        left = n - int(r.url[1:])
        assert (r.final_url, r.hops) == ((f"n{n}", left) if left <= 10 else (None, None)), r


def test_decode(spark):
    rows = [
        ("https://a.example/1", 200, {"content-type": "text/html; charset=utf-8"}, None, bytearray("世界".encode())),
        ("https://a.example/2", 200, {"content-type": "text/html; charset=utf-8"}, None, bytearray(b"\xff")),
    ]
    accepted, _ = gate_responses(_rows(spark, rows))
    good, bad = decode_responses(accepted)
    assert [(r.url[-1], r.charset, r.text) for r in good.collect()] == [("1", "Utf8", "世界")]
    assert [(r.url[-1], r.error.code, r.error.retriable) for r in bad.collect()] == [("2", "Charset", False)]


def test_scan_responses(spark, tmp_path):
    rows = _rows(spark, [("https://a.example/ok", 200, {}, None, HTML)])
    rows.write.parquet(str(tmp_path / "r"))
    assert scan_responses(spark, str(tmp_path / "r")).schema.names == RESPONSES.names
    stream = scan_responses(spark, str(tmp_path / "r"), streaming=True)
    assert stream.isStreaming
    query = stream.select(F.col("url")).writeStream.format("memory").queryName("scanned").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("scanned").count() == 1
