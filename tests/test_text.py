import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelake.functions import text as X


def test_normalize_whitespace(one):
    assert one(X.normalize_whitespace("t"), t="  Hello    world  \n\n\n  Test  ") == "Hello world \n\n Test"
    assert one(X.normalize_whitespace("t"), t="a\tb \t c\n  \n\nd　") == "a b c\n\nd"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab \t\n\r  é"), max_size=30), min_size=50, max_size=50))
def test_normalize_is_stable_after_two_passes_and_trimmed(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize_whitespace("t").alias("n"))
    for t, n in rows.collect():
        # the order of the three steps, in plain Python
        ws = X.WS_CHARS
        import re

        want = re.sub(r"[ \t]+", " ", t.strip(ws))
        want = re.sub(rf"\n[{ws}]*\n+", "\n\n", want)
        assert n == want


def test_trim_is_unicode(one):
    assert one(X.utrim("t"), t="　  a b\u0085") == "a b"
    assert one(X.utrim("t"), t="​ a") == "​ a"  # zero width space is no white space


def test_word_count(one):
    assert one(X.word_count("t"), t=" a b c  d\n") == 4
    assert one(X.word_count("t"), t=" \n ") == 0


def test_lengths(one):
    assert one(X.char_count("t"), t="世界!") == 3
    assert one(X.byte_count("t"), t="世界!") == 7


def test_checksums(one):
    want = hashlib.md5("<p>é</p>é".encode()).hexdigest()
    assert one(X.content_checksum("h", "t"), h="<p>é</p>", t="é") == want
    assert one(X.raw_checksum("b"), b=bytearray(b"abc")) == hashlib.md5(b"abc").hexdigest()


def test_keywords_count_each_and_overlap(one):
    # "service" inside "services", "error" and "404" and "not found" are counted one by one
    assert one(X.keyword_count("t"), t="Services ERROR 404 not found") == 4
    assert one(X.keyword_count("t"), t="cookiecookie") == 2
    assert one(X.boilerplate_ratio("t"), t="cookie policy here") == 2 / 3
    assert one(X.boilerplate_ratio("t"), t="") is None


def test_overlapping_keywords_are_not_merged(one):
    # "re" + "set" + "service": reset and service share no letters, "sign up" spans words
    assert one(X.keyword_count("t", ("aba", "bab")), t="ababab") == 1 + 1
    assert one(X.keyword_count("t", ("ab", "ba")), t="abab") == 2 + 1


def test_tokens(one):
    assert one(X.tokenize_simple("t"), t="L'Été, 2nd-Hand!") == ["l", "été", "2nd", "hand"]


def test_compute_once_is_a_barrier(spark):
    df = X.compute_once(spark.range(3), {"a": F.md5(F.col("id").cast("string"))}).filter("a > 'c'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 1
