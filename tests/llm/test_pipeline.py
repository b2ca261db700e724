import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from pagelake.llm.line_dedup import line_dedup
from pagelake.llm.mixing import mix_plan
from pagelake.llm.store import stored

from .test_ngram_join import brute as near_copies
from .test_line_dedup import brute as deduped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage got and made."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(9_000_001, "12 34 ## 56", "en", "src1", 11), (9_000_002, None, "en", "src1", None), (9_000_003, "", None, None, 0)]
    docs = stored(docs.unionByName(spark.createDataFrame(junk, docs.schema)), "pipeline-input")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, SF), f"made-{name}")
        found[name] = (docs, made)
        docs = made
    return found


def test_names_and_columns(steps):
    assert list(steps) == ["language_id", "line_dedup", "ngram_join", "mix_sources", "pack_sequences"]
    for name, (before, after) in steps.items():
        if name != "pack_sequences":
            assert after.schema.simpleString() == before.schema.simpleString()


def test_language_stage_drops_junk_only(steps):
    before, after = steps["language_id"]
    gone = {r["doc_id"] for r in before.join(after, "doc_id", "left_anti").collect()}
    assert gone == {9_000_001, 9_000_002, 9_000_003}
    assert after.exceptAll(before).count() == 0


def test_line_stage(steps):
    before, after = steps["line_dedup"]
    expected = deduped([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {d: v[0] for (d, _), v in expected.items()}
    assert line_dedup(after).agg({"removed_pieces": "sum"}).first()[0] == 0


def test_near_copy_stage(steps):
    before, after = steps["ngram_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {d for d, _, c in near_copies(rows) if c == d}
    assert after.exceptAll(before).count() == 0


def test_near_copy_stage_decides_by_row(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near, other, lone = text + " end", " ".join(f"other{i}" for i in range(60)), " ".join(f"lone{i}" for i in range(60))
    rows = [
        (5, text, "en", "a"), (5, text, "en", "a"),  # equal rows
        (-3, near, "en", "a"),  # the smallest doc_id of the group stays
        (5, other, "en", "a"),  # shares a doc_id with a near copy
        (None, near, "en", "a"), (None, lone, None, "a"), (None, lone, "a", None), (None, lone, None, "a"),
        (7, other, "en", "a"), (7, "", "en", "b"), (7, None, "en", "b"), (8, "", "en", "b"), (8, "", "en", "b"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    after = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert after.columns == docs.columns
    found = [tuple(r) for r in after.collect()]
    expected = [(-3, near), (5, other), (7, ""), (7, None), (8, "")]
    assert sorted(((d, t) for d, t, _, _ in found if d is not None), key=str) == sorted(expected, key=str)
    assert [t for d, t, _, _ in found if d is None] == [lone]


def test_mix_stage(steps):
    before, after = steps["mix_sources"]
    taken = {r["doc_id"]: r["taken"] for r in mix_plan(before).collect()}
    words = {}
    for r in after.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert words == {d: n for d, n in taken.items() if n}


def test_pack_stage(steps, vocabulary):
    before, after = steps["pack_sequences"]
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert after.agg({"length": "sum"}).first()[0] == total
    assert after.filter("offset = 0").count() == after.select("sequence_id").distinct().count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).filter("offset = 0").count() > 0


CLASHES = ("a.b", "_text", "_row", "score", "lang_pred", "component_id", "size", "_size", "n_lines", "unit", "c0", "passed_1")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_columns_of_any_name_and_type(spark, name):
    """Clashing names, a map, rows that repeat and NULL ids; what passes through comes back as it was."""
    texts = [" ".join(f"{w}{i}" for w in ("the", "green", "garden", "gate") for i in range(k, k + 12)) for k in range(4)]
    rows = [(i, texts[i % 4], "en", f"s{i % 2}") for i in range(8)] + [(3, texts[3], "en", "s1"), (None, texts[0] + " and more of it", "en", None), (9, None, None, "s0"), (10, "", "en", "s0")]
    schema = "doc_id long, text string, lang string, source string, meta map<string,int>" + "".join(f", `{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, {"k": i}, *[f"{c} {i}" for c in CLASHES]) for i, r in enumerate(rows)], schema).repartition(3)
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    if name == "pack_sequences":
        assert made.count() >= len(rows)
        return
    assert made.schema.simpleString() == docs.schema.simpleString()
    found = made.collect()
    assert found
    for r in found:
        i = r["meta"]["k"]
        assert [r[c] for c in CLASHES] == [f"{c} {i}" for c in CLASHES] and (r["doc_id"], r["lang"], r["source"]) == (rows[i][0], *rows[i][2:])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, no_docs, name):
    made = dict(corpus_pipeline.STAGES)[name](spark, no_docs, SF)
    assert made.count() == 0 and (name == "pack_sequences" or made.columns == no_docs.columns)
