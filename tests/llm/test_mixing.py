import duckdb
import pytest

from pagelake.llm.mixing import mix_plan, mixed
from pagelake.llm.queries import OP3_SQL

from .conftest import EDGE


def twin(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    return con.execute(OP3_SQL).fetchall()


def rows_of(df):
    names = ("doc_id", "size", "source_size", "target", "repeats", "extra_words", "taken")
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_skewed_sources(spark):
    # a hot source, capped ones, and repeated sizes
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), "hot" if i % 3 == 0 else f"s{i % 40}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = rows_of(mix_plan(docs))
    assert sorted(found) == sorted(twin(docs))
    by_source = {}
    for row, source in zip(sorted(found), [r[2] for r in sorted(rows)], strict=True):
        assert 0 <= row[6] <= 3 * row[1]
        taken, target = by_source.get(source, (0, row[3]))
        by_source[source] = (taken + row[6], target)
    assert all(abs(taken - target) <= 1 for taken, target in by_source.values())
    assert sum(t for _, t in by_source.values()) == pytest.approx(sum(r[1] for r in found))


def test_edge_documents(edge_docs):
    found = rows_of(mix_plan(edge_docs))
    assert len(found) == len(EDGE)
    assert all(row[1] == 0 and row[6] == 0 for row in found if row[0] in (3, 4, 5))
    assert sorted(map(str, found)) == sorted(map(str, rows_of(mix_plan(edge_docs.repartition(7)))))
    for row in found:
        assert row[6] == row[1] * row[4] + row[5] and 0 <= row[5] <= row[1] and row[6] <= 3 * row[1]


def test_mixed_documents_have_the_planned_words(edge_docs):
    plan = {}
    for row in rows_of(mix_plan(edge_docs)):
        plan[row[0]] = plan.get(row[0], 0) + row[6]
    result = mixed(edge_docs)
    assert result.columns == edge_docs.columns
    taken = {}
    for row in result.collect():
        taken[row["doc_id"]] = taken.get(row["doc_id"], 0) + len(row["text"].encode().split())
    assert taken == {k: v for k, v in plan.items() if v}


def test_empty_table(no_docs):
    assert mix_plan(no_docs).count() == 0 and mixed(no_docs).count() == 0


def test_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix_plan(docs).collect()] == [(0.0, 0), (0.0, 0)]


def test_no_text_is_shuffled(edge_docs):
    plan = mixed(edge_docs)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text" not in line
