import math

from pyspark.sql import functions as F

from pagelake.operators.search import (
    build_postings, doc_lengths, doc_postings, latest_items, match_all_terms, project_item_response, rank_bm25, search_document,
    search_incremental, snippets, tokens_of,
)
from pagelake.schemas import ITEMS

DOCS = {1: "The cat sat. The CAT ran!", 2: "A dog and a cat", 3: "dogs only here, été 2024", 4: None, 5: ""}


def _docs(spark, docs=DOCS):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def test_postings(spark):
    rows = build_postings(_docs(spark), "doc_id", "text").collect()
    got = {(r.term, r.doc_id): (r.tf, r.first_pos, r.positions) for r in rows}
    assert got[("the", 1)] == (2, 0, [0, 3]) and got[("cat", 1)] == (2, 1, [1, 4]) and got[("cat", 2)] == (1, 4, [4])
    assert ("été", 3) in got and ("2024", 3) in got and not any(d in (4, 5) for _, d in got)


def test_postings_are_made_without_a_shuffle(spark):
    plan = build_postings(_docs(spark), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_match_all(spark):
    postings = build_postings(_docs(spark), "doc_id", "text", positions=False)
    ids = lambda *terms: {r.doc_id for r in match_all_terms(postings, list(terms), "doc_id").collect()}
    assert ids("cat") == {1, 2} and ids("cat", "dog") == {2} and ids("cat", "cat") == {1, 2} and ids("cat", "none") == set()


def test_bm25(spark):
    docs = _docs(spark)
    ranked = rank_bm25(
        build_postings(docs, "doc_id", "text", positions=False), doc_lengths(docs, "doc_id", "text"),
        {"q": ["cat", "ran"], "none": ["zebra"]}, "doc_id", 2,
    ).collect()
    lengths = {1: 6, 2: 5, 3: 5, 5: 0}
    avg = sum(lengths.values()) / 4

    def score(tf, df, dl):
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert [(r.doc_id, r["rank"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    by_doc = {r.doc_id: r.score for r in ranked}
    assert by_doc[1] == round(score(2, 2, 6) + score(1, 1, 6), 6) and by_doc[2] == round(score(1, 2, 5), 6)


def test_snippets(spark):
    hits = spark.createDataFrame([(1, 4), (2, 0)], "doc_id long, first_pos long")
    got = {r.doc_id: r.snippet for r in snippets(hits, _docs(spark), "doc_id", "text", width=2).collect()}
    assert got == {1: "sat The CAT ran", 2: "A dog and"}


def test_incremental_equals_rebuild(spark):
    old = build_postings(_docs(spark), "doc_id", "text", positions=False)
    now = {**DOCS, 1: "new words", 2: None, 6: "added"}
    changed = _docs(spark, {k: now[k] for k in (1, 2, 6)})
    got = search_incremental(old, changed, "doc_id", "text").collect()
    want = build_postings(_docs(spark, now), "doc_id", "text", positions=False).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_tokens_of_agree(spark, one):
    from pagelake.functions.text import tokenize_simple

    phrase = "L'Été: 2nd_hand  Été"
    assert tokens_of(phrase) == ["l", "été", "2nd", "hand"]
    assert one(F.array_distinct(tokenize_simple("t")), t=phrase) == tokens_of(phrase)


def _items(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in (1, 2, 2, 3)]
    rows = [(f"i{n}", "u1" if n < 3 else "u2", "url", "T" if n else None, "s", "pending" if n != 2 else "fetched", t[n], t[n]) for n in range(4)]
    return spark.createDataFrame(rows, ITEMS)


def test_latest(spark):
    got = [(r.user_id, r.id) for r in latest_items(_items(spark), 2).orderBy("user_id", "rank").collect()]
    assert got == [("u1", "i1"), ("u1", "i2"), ("u2", "i3")]
    pending = latest_items(_items(spark), 2, F.lit("pending")).orderBy("user_id", "rank").collect()
    assert [r.id for r in pending] == ["i1", "i0", "i3"]
    assert project_item_response(_items(spark)).columns == ITEMS.names


def test_search_document(spark):
    tags = spark.createDataFrame([("t1", "u1", "red"), ("t2", "u1", "blue")], "id string, user_id string, name string")
    links = spark.createDataFrame([("i1", "t1"), ("i1", "t2"), ("i3", "t1")], "item_id string, tag_id string")
    contents = spark.createDataFrame([("i1", "body"), ("i2", None)], "item_id string, clean_text string")
    got = {r.id: r.document for r in search_document(_items(spark), links, tags, contents).collect()}
    assert got == {"i0": "s", "i1": "T\ns\nblue red\nbody", "i2": "T\ns", "i3": "T\ns\nred"}


def test_incremental_shuffles_documents_not_postings(spark):
    """Over rows of doc_postings the join comes before they are unpacked, with the same result."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (3, "c c"), (None, "a d")], "id int, text string")
    changed = spark.createDataFrame([(2, "d e"), (3, None), (4, "a")], "id int, text string")
    flat = search_incremental(build_postings(docs, "id", "text", positions=False), changed, "id", "text")
    grouped = search_incremental(doc_postings(docs, "id", "text").drop("positions"), changed, "id", "text")
    assert grouped.columns == flat.columns
    assert sorted(map(str, grouped.collect())) == sorted(map(str, flat.collect()))
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline(arrays_zip(") < plan.index("Join LeftAnti")
