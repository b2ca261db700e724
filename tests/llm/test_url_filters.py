import math

import pytest

from pagelake.llm.url_filters import best_split, url_filters

URLS = {
    1: ("http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    2: ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    3: ("https://a.www.example.com/en/?q#f", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    4: ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    5: ("https://example.com", "example.com", "", None, None),
    6: ("https://example.com?x=/en/", "example.com", "", None, None),
    7: ("https://a.net/es/1#/fr/", "a.net", "/es/1", "net/es/", "block"),
    8: ("https://net/fr/", "net", "/fr/", "net/fr/", "block"),
    9: ("https://a.net/ES/1", "a.net", "/ES/1", None, None),
    10: ("no scheme/en/", "", "", None, "allow"),
    11: (None, "", "", None, "allow"),
    12: ("", "", "", None, "allow"),
    13: ("x://ÄB.org/é/ü?x", "ÄB.org".replace("B", "b"), "/é/ü", None, None),
    14: ("http://h.org/a\nb/c", "h.org", "/a\nb/c", None, None),
    15: ("http://user@example.com:80/en/", "user@example.com:80", "/en/", None, None),
    16: ("://", "", "", None, "allow"),
    17: ("http://" + "q" * 2000 + ".org/", "q" * 2000 + ".org", "/", None, None),
    18: ("http://a.com//b://c", "a.com", "//b://c", "com/", "allow"),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, v[0], "<p>the river park</p>", 1.0, "x") for k, v in URLS.items()]
    rows += [(None, "http://a.com/", None, 2.0, "x"), (1, URLS[1][0], "", 2.0, None)]
    text = "casino win big online park river garden house tools the best"
    rows += [(100 + i, f"http://{n}.org/de/{i}", f"<b>{text}</b><p>{text}", 0.0, "") for i, n in enumerate(["rivergarden", "parkhouse", "gardentools"] * 30)]
    rows += [(300 + i, f"http://www.{n}.org/de/{i}", "", 0.0, "") for i, n in enumerate(["onlinecasino", "bigcasinowin", "casinopark"] * 5)]
    rows += [(400, "http://casinoriver.org/de/4", "", 0.0, ""), (401, "http://gardenriver.org/de/4", "", 0.0, "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, score double, rule string").repartition(3)


def test_rules_and_parts(pages):
    found = {}
    for r in url_filters(pages).collect():
        found.setdefault(r["page_id"], []).append(r)
    assert len(found[1]) == 2 and len({(r["host"], r["verdict"], r["score"]) for r in found[1]}) == 1
    assert len(found[None]) == 1
    for k, (_, host, path, rule, verdict) in URLS.items():
        r = found[k][0]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), k
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_model_learns_unwanted_names(pages):
    verdicts = {r["page_id"]: r["verdict"] for r in url_filters(pages).collect()}
    assert all(verdicts[300 + i] == "block" for i in range(15))
    assert all(verdicts[100 + i] == "allow" for i in range(90))
    assert verdicts[400] == "block" and verdicts[401] == "allow"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert [r["verdict"] for r in url_filters(nothing).collect()] == ["allow"]


def all_splits(name, words, unknown):
    """Best value over all ways to cut a name into words and single letters."""
    if not name:
        return 0.0
    best = unknown + all_splits(name[1:], words, unknown)
    for word, value in words.items():
        if name.startswith(word):
            best = max(best, value + all_splits(name[len(word) :], words, unknown))
    return best


@pytest.mark.parametrize("name", ["thecatsat", "catsatthe", "xxcatyy", "aaaa", "q", "thecathecat"])
def test_best_split(name):
    words = {"the": -2.0, "cat": -3.0, "cats": -4.0, "at": -2.5, "sat": -3.5, "aa": -4.0, "hec": -9.0}
    pieces = [(i, len(w), v) for w, v in words.items() for i in range(len(name)) if name.startswith(w, i)]
    found = best_split(name, pieces, -5.0)
    assert "".join(found) == name
    value = sum(words.get(w, -5.0 * len(w)) for w in found)
    assert math.isclose(value, all_splits(name, words, -5.0))
