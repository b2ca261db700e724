import public_tokenizers
import pytest

#: doc_id, text, lang, source: NULLs, empty and blank texts, ties, repeated rows, a very long word and a long text.
PROSE = "the cat sat on the mat and the dog ran after the ball in the wide green park near the old river"
EDGE = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n\x0b\x0c\r ", "en", None),
    (6, "one", "en", "b"),
    (7, "x" * 3000, None, None),
    (8, "Die Katze saß auf der Matte und der Hund lief hinter dem Ball her", "de", "a"),
    (8, "eine andere Zeile mit der gleichen Nummer und genug Wörtern darin", "de", "a"),
    (9, "line one has quite a few words in it today, really ten\nshort\n\nline one has quite a few words in it today, really ten", "en", "c"),
    (9, "line one has quite a few words in it today, really ten\nshort\n\nline one has quite a few words in it today, really ten", "en", "c"),
    (None, PROSE.upper(), "en", "a"),
    (None, None, None, None),
    (10, " ".join(f"word{i}" for i in range(4000)), "en", "c"),
    (11, "日本語 текст ½ ²\xa0x  don't <|endoftext|> 'LL\n\n\nend ", "zz", "c"),
    (-5, "12 34 56 ## $$ | && 78", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge cases with further columns whose names the operators use themselves."""
    names = ("n_chars", "size", "cell", "key", "ids", "score", "lang_pred", "n_tokens", "_size", "_keep_x", "unit", "n_lines", "kept", "_doc", "component_id")
    wide = SCHEMA + "".join(f", {n} long" for n in names)
    return spark.createDataFrame([(*row, *([-1] * len(names))) for row in EDGE], wide).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path
