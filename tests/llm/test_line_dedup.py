import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import line_dedup as line_dedup_module
from pagelake.llm.line_dedup import MIN_WORDS, bare_pieces_of, chunks_of_pieces, is_plain, line_dedup
from pagelake.llm.queries import OP10_SQL, op10_line_dedup

from .conftest import EDGE


def cut(text):
    """Pieces of a text, character by character: a new one begins at a word behind a line's end or a sentence's."""
    blank = " \t\n\x0b\x0c\r"
    pieces = [""]
    for i, c in enumerate(text):
        if i and c not in blank and (text[i - 1] == "\n" or (i > 1 and text[i - 1] == " " and text[i - 2] in ".!?")):
            pieces.append("")
        pieces[-1] += c
    return pieces


def brute(rows, min_words=10):
    """{(doc_id, text): (new text, pieces, removed)}: every stretch of pieces, by content."""
    documents = {(d, t): cut(t) for d, t in rows if t is not None}
    first, windows = {}, []
    for key in sorted(documents, key=lambda k: (k[0] is not None, k[0] or 0)):
        pieces = documents[key]
        full = [i for i, x in enumerate(pieces) if x.encode().split()]
        for a in range(len(full)):
            total = 0
            for b in range(a, len(full)):
                total += len(pieces[full[b]].encode().split())
                if total >= min_words:
                    content = tuple(pieces[i].encode().strip() for i in full[a : b + 1])
                    windows.append((content, key, full[a], full[b] + 1))
                    place = ((key[0] is not None, key[0] or 0), full[a])
                    first[content] = min(first.get(content, place), place)
    gone = {key: set() for key in documents}
    for content, key, start, end in windows:
        if ((key[0] is not None, key[0] or 0), start) > first[content]:
            gone[key] |= set(range(start, end))
    return {k: ("".join(x for i, x in enumerate(pieces) if i not in gone[k]), len(pieces), len(gone[k])) for k, pieces in documents.items()}


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    # the result has the new text only: join it back through the unique ids of these tests
    return {r["doc_id"]: (r["text"], r["n_pieces"], r["removed_pieces"], r["n_chars"]) for r in line_dedup(docs).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    ends = ["\n", ". ", "! ", "?\n", " ", ", ", "\n\n \n", ".  ", ". . ", "\n. ", "\t\n"]
    pool = [" ".join(f"v{seed}{i}{k}" for k in range(int(rng.integers(1, 14)))) + ends[int(rng.integers(0, len(ends)))] for i in range(25)] + ["\n", "  ", ""]
    shared = [[pool[i] for i in rng.integers(0, 28, int(rng.integers(1, 9)))] for _ in range(5)]
    rows = []
    for i in range(50):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            parts += shared[int(rng.integers(0, 5))] if rng.random() < 0.5 else [f"own {i} {x}. " for x in rng.integers(0, 999, 3)]
        rows.append((i - 5, "".join(parts)))
    found, expected = run(spark, rows), brute(rows)
    for doc_id, text in rows:
        new, n, removed = expected[doc_id, text]
        assert found[doc_id] == (new, n, removed, len(new)), doc_id


def test_chunks_meet(spark, monkeypatch):
    """Runs that cross the ends of chunks, at every place of a chunk."""
    monkeypatch.setattr(line_dedup_module, "CHUNK", 4)
    passage = "".join(f"part {i} has {'more ' * (i % 4)}words. " for i in range(9))
    rows = [(i, "".join(f"own{i}x{k}. " for k in range(i)) + passage + f"tail {i}") for i in range(12)]
    found, expected = run(spark, rows), brute(rows)
    assert {d: found[d][:3] for d, _ in rows} == {d: expected[d, t] for d, t in rows}
    assert all(passage not in found[d][0] for d in range(1, 12)) and found[0][0] == rows[0][1]


def test_first_copy_stays(spark):
    passage = "\n".join(f"line {i} of a passage with several words" for i in range(8))
    rows = [(3, f"own head here\n{passage}\nown tail"), (1, f"first\n{passage}"), (7, passage), (9, f"{passage}\n\n \nx\n{passage}"), (10, "a short line\nof no one else"), (11, "a short line")]
    found = run(spark, rows)
    assert found[1][0] == rows[1][1] and found[10][0] == rows[4][1] and found[11][0] == "a short line"
    assert found[3][0] == "own head here\nown tail" and found[7][0] == "" and found[9][0] == "x\n"


def test_passages_inside_longer_lines(spark):
    """A passage that begins and ends inside sentences loses its whole sentences wherever it stands."""
    sentences = [f"The {a} keeper of {a} wrote {b} letters to {b} before {c} rang." for a, b, c in zip("abcdef", "ghijkl", "mnopqr", strict=True)]
    passage = "half of one sentence. " + " ".join(sentences) + " and a part"
    rows = [(1, f"Some text with {passage} of more."), (2, f"Other words. Then {passage} that goes on.\nA line."), (3, f"New {passage}\nend"), (4, "Nothing of it. Not a word of that long passage stands in here, so all stays. Yes.")]
    found = run(spark, rows)
    assert found[1][0] == rows[0][1] and found[4][0] == rows[3][1]
    assert found[2][0] == "Other words. Then half of one sentence. and a part that goes on.\nA line."
    assert not any(s in found[3][0] for s in sentences)


def test_edge_documents(edge_docs, no_docs):
    rows = line_dedup(edge_docs).collect()
    assert len(rows) == len(EDGE)
    assert rows[0].asDict().keys() == set(edge_docs.columns) | {"n_pieces", "removed_pieces"}
    expected = brute([(d, t) for d, t, _, _ in EDGE])
    results = sorted(str((r["doc_id"], r["text"], r["n_pieces"], r["removed_pieces"])) for r in rows)
    wanted = sorted(str((d, None, 0, 0) if t is None else (d, *expected[d, t])) for d, t, _, _ in EDGE)
    assert results == wanted
    assert line_dedup(no_docs).count() == 0


def test_twin(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    found = [(r["doc_id"], r["n_pieces"], r["removed_pieces"], r["text_md5"]) for r in op10_line_dedup(spark, d).collect()]
    assert sorted(found) == sorted(con.execute(OP10_SQL).fetchall())


def test_dataframe_functions_only(edge_docs):
    plan = line_dedup(edge_docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapIn"))


def test_texts_are_cut_once(edge_docs):
    plan = chunks_of_pieces(edge_docs, MIN_WORDS)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("split(" in line or "transform(" in line for line in filters)


def test_plain_texts_have_the_same_pieces(spark):
    """Without a look at the blanks of each piece, wherever a text's blanks allow it."""
    plain = ["a", "one two. Three! four?\nfive", "a.\nb\nc. d", "e.g. f, g . h", "...\n! ? .", "\u3000x. \u00e9", "x\u00a0. y"]
    other = ["", " ", " a", "a ", "\na", "a\n", "a  b", "a.  b", "a\n\nb", "a\n b", "a \nb", "a\tb", "a. \tb", "a\r\nb", "a\x0bb", "a\x0cb", "a.\x0c"]
    docs = spark.createDataFrame([(t,) for t in plain + other], "text string").withColumn("plain", is_plain(F.col("text")))
    found = {r["text"]: (r["plain"], r["pieces"]) for r in docs.select("text", "plain", bare_pieces_of(F.col("text"), F.col("plain")).alias("pieces")).collect()}
    assert found == {t: (t in plain, [x.strip(" \t\n\x0b\x0c\r") for x in cut(t)]) for t in plain + other}


def test_shuffles_of_the_windows_are_deleted(spark):
    """When the windows are written, without a garbage collection of the driver."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_")}

    docs = spark.createDataFrame([(i, f"the same ten words stand in each of these few texts. own {i}") for i in range(20)], "doc_id long, text string").localCheckpoint()
    before, usual = shuffles(), spark.conf.get(setting)
    line_dedup_module.repeated_runs(docs)
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(setting) == usual
