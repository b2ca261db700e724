import pytest
from pyspark.sql import functions as F

from pagelake.functions.charset import charset_label, decode_body, detect_charset

META = b'<html><head><meta charset="%s"><title>T</title></head></html>'
EQUIV = b'<html><head><meta http-equiv="Content-Type" content="text/html; charset=windows-1252"></head></html>'
FAR = b"<html>" + b" " * 5000 + b'<meta charset="gbk">'

DETECT = [
    ("text/html; charset=utf-8", b"<html></html>", "Utf8"),
    ("text/html", META % b"iso-8859-1", "Windows1252"),
    ("text/html", EQUIV, "Windows1252"),
    ("text/html; charset=bogus", META % b"gb18030", "Gb2312"),
    ('text/html; CHARSET = "Shift_JIS"', b"", "ShiftJis"),
    ("text/html; charset=big5", META % b"utf-8", "Big5"),
    ("text/html; charset=euc-kr", b"", "Other"),
    ("text/html; charset=iso-8859-19", META % b"gbk", "Gb2312"),
    ("text/html", FAR, "Utf8"),
    ("text/html", b"caf\xe9", "Windows1252"),
    (None, "é".encode(), "Utf8"),
]


def test_detect(spark):
    df = spark.createDataFrame([(i, t, bytearray(b)) for i, (t, b, _) in enumerate(DETECT)], "i int, t string, b binary")
    got = {r.i: r.c for r in df.select("i", detect_charset(F.col("t"), F.col("b")).alias("c")).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(DETECT)}


@pytest.mark.parametrize(
    "label,name",
    [("UTF8", "Utf8"), ("latin1", "Windows1252"), ("x-sjis", "ShiftJis"), ("GBK", "Gb2312"), ("x-x-big5", "Big5"),
     ("iso-8859-2", "Other"), ("windows-1251", "Other"), ("utf-16le", "Other"), ("nope", None), ("", None), ("iso-8859-19", None), ("cs866", None), ("cskoi", None), ("koi8-r", "Other")],
)
def test_labels(one, label, name):
    assert one(charset_label(F.col("x")), x=label) == name


BODIES = [
    ("Καλημέρα, 港!".encode(), "Utf8", "Καλημέρα, 港!"),
    (b"\xef\xbb\xbfcaf\xc3\xa9", "Windows1252", "café"),
    (b"\xef\xbb\xbfcaf\xc3\xa9", "ShiftJis", "café"),
    (b"\xef\xbb\xbfbom", "Utf8", "bom"),
    (b"ok \xff", "Utf8", None),
    (b"caf\xe9 \x81 \x93", "Windows1252", "café \x81 “"),
    ("日本".encode("cp932"), "ShiftJis", "日本"),
    ("中文".encode("gbk"), "Gb2312", "中文"),
    ("中文".encode("big5"), "Big5", "中文"),
    (b"\x81", "Gb2312", None),
    ("é".encode(), "Other", "é"),
    ("wide".encode("utf-16"), "Utf8", "wide"),
]


def test_decode(spark):
    df = spark.createDataFrame([(i, bytearray(b), c) for i, (b, c, _) in enumerate(BODIES)], "i int, b binary, c string")
    got = {r.i: r.t for r in df.select("i", decode_body(F.col("b"), F.col("c")).alias("t")).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(BODIES)}
