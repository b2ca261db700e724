import pytest

from pagelake.functions.fixed import LANGUAGE_CODES
from pagelake.operators.language import assign_language, language_code, language_profiles
from pagelake.sources.tables import read_fixture

EN = "The keeper of the lighthouse wrote down every ship that passed the island during the long winter nights."
ES = "La asociación de los vecinos prepara la celebración de la cosecha con canciones que todos recuerdan del año anterior."
SIGNS = " ".join(f"{n}:{n + 1};" for n in range(40)) + "<<>> +++ %% 3.14159 ~~ 2/3"


@pytest.fixture(scope="module")
def profiles(spark):
    return language_profiles(read_fixture(spark, "/root/testdata/sf0.01", "documents"))


def test_sentences(spark, profiles):
    texts = {EN: "en", ES: "es", "Too little": None, SIGNS: None, "": None, " " * 80: None}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.language for r in assign_language(df, profiles).collect()} == texts


def test_null_text(spark, profiles):
    row = assign_language(spark.createDataFrame([(None,)], "text string"), profiles).first()
    assert (row.language, row.confidence) == (None, 0.0)


def test_no_profiles(spark, profiles):
    rows = assign_language(spark.createDataFrame([(EN,), (None,)], "text string"), profiles.filter("false")).collect()
    assert [(r.language, r.confidence) for r in rows] == [(None, 0.0)] * 2


def test_accuracy(spark, profiles):
    docs = read_fixture(spark, "/root/testdata/sf0.01", "documents").filter("n_chars >= 200")
    out = assign_language(docs, profiles)
    right = out.filter("language = lang").count()
    assert right >= 0.98 * out.count()


def test_profiles_are_ranked(spark, profiles):
    rows = profiles.filter("lang = 'de'").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 301))


@pytest.mark.parametrize("three,two", [("eng", "en"), ("CMN", "zh"), ("vie", "vi"), ("Ukr", "ukr")])
def test_codes(one, three, two):
    assert one(language_code("x"), x=three) == two
    assert len(LANGUAGE_CODES) == 21
