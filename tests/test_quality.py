import pytest

from pagelake.operators.quality import check_domains, reject_content, validate_emails, validate_urls

REJECT = [
    ("Harbour notes", "Fog.", "too_short"),
    ("Harbour notes", "the tide turned at noon and " * 40, None),
    ("", "six words are not a page", "too_short"),
    ("", "x" * 300, "untitled"),
    (" 　", "abcdefgh " * 49, "untitled"),
    ("", "abcdefgh " * 50, None),
    (None, "abcdefgh " * 40, "untitled"),
    ("Runes", "x" * 300, None),
    ("Settings", "login register password reset newsletter subscribe preferences browser " * 15, "boilerplate"),
    ("Field guide", "Herons stand in the shallows and wait for fish to come within reach of the bill. " * 8, None),
    # exactly 0.3 is not more than 0.3: 3 keywords in 10 words
    ("T", ("cookie cookie cookie " + "wordwordword " * 7) * 5, None),
    ("T", "x" * 249, "too_short"),
    ("T", "é" * 250, None),
]


@pytest.mark.parametrize("title,text,reason", REJECT)
def test_reject(spark, title, text, reason):
    df = spark.createDataFrame([(title, text)], "title string, text string")
    assert reject_content(df).first().reason == reason


def test_urls(spark):
    df = spark.createDataFrame([(1, "https://example.com"), (2, ""), (3, "a" * 2049), (4, "a" * 2048), (5, "é" * 1025)], "id int, url string")
    assert {(r.rule, r.key) for r in validate_urls(df, "url", "id").collect()} == {
        ("URL cannot be empty", "2"), ("URL too long", "3"), ("URL too long", "5"),
    }


def test_emails(spark):
    good = ["a@b.c", "first.last+tag@sub.example.org", "é@ü.de"]
    bad = ["", "plain", "a@b", "@b.c", "a@.c", "a b@c.d", "a@b c.d", "a@@b.c", "a@b.c\n", "a @b.c"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(good + bad)], "id int, email string")
    failed = {int(r.key) for r in validate_emails(df, "email", "id").collect()}
    assert failed == set(range(len(good), len(good) + len(bad)))


def test_domains(spark):
    df = spark.createDataFrame([(1, "pending", 0, "x"), (2, "gone", -1, "y"), (3, None, 2, None)], "id int, status string, attempts int, url string")
    rows = check_domains(df, "id", {"status": ("pending", "fetched")}, ["url", "status"], ["attempts"]).collect()
    assert {(r.rule, r.key) for r in rows} == {
        ("status domain", "2"), ("attempts >= 0", "2"), ("url not null", "3"), ("status not null", "3"),
    }
