import zlib

import numpy as np
import pytest

from pagelake.llm.language_id import UNDETERMINED, WORD_LETTERS, LanguageModel, Words, fit, fit_languages, forward, identify, vocabulary
from pagelake.llm.queries import op4_language_id

from .conftest import EDGE

WORDS = ["the", "cat", "katze", "straße", "x", "日本語", "abcdefghijklmnopqrstuvwxyzabcdef", "internationalization"]


def probability(word, pieces, column):
    word = "▁" + word
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for size in range(1, end + 1):
            piece = word[end - size : end]
            if piece in pieces:
                total[end] += total[end - size] * column[pieces[piece]]
            elif size == 1:
                total[end] += total[end - 1] * column[-1]
    return total[-1]


def test_forward_sums_all_segmentations(vocabulary_path):
    known = vocabulary(vocabulary_path)
    assert known.longest == max(map(len, known.pieces)) > 8
    pieces = {p: i for i, p in enumerate(known.pieces)}
    table = fit(WORDS, np.array([[3.0, 1], [2, 0], [0, 5], [1, 1], [1, 1], [1, 0], [0, 1], [2, 1]]), vocabulary_path)
    assert np.allclose(table.sum(axis=0), 1)
    points = np.array([ord(c) for w in WORDS for c in w], dtype=np.uint32)
    lengths = np.array([len(w) for w in WORDS])
    chart = Words(points, np.cumsum(lengths) - lengths, lengths)
    found = np.empty((len(WORDS), 2))
    found[chart.order] = forward(chart, known, table)[1]
    expected = [[probability(w, pieces, table[:, i]) for i in range(2)] for w in WORDS]
    assert np.allclose(np.log(found), np.log(expected))


@pytest.fixture(scope="module")
def vocabulary_path(vocabulary):
    return vocabulary("piece_bpe_32k.model")


def test_held_out_accuracy(spark):
    rows = op4_language_id(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(labels)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_edge_documents(edge_docs, vocabulary_path):
    model = fit_languages(edge_docs.filter("lang <> 'zz'"), vocabulary_path)
    assert model.languages == ["de", "en"]
    rows = identify(edge_docs, model).collect()
    assert len(rows) == len(EDGE)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {UNDETERMINED}
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == UNDETERMINED)
    assert {r["lang_pred"] for r in rows if r["doc_id"] == 8} == {"de"} and {r["lang_pred"] for r in rows if r["doc_id"] == 2} == {"en"}


def test_no_labels_and_no_rows(edge_docs, no_docs, vocabulary_path):
    model = fit_languages(no_docs, vocabulary_path)
    assert {r["lang_pred"] for r in identify(edge_docs, model).collect()} == {UNDETERMINED}
    assert identify(no_docs, model).count() == 0


def test_remembered_words_change_nothing(vocabulary_path, monkeypatch):
    import pyarrow as pa

    from pagelake.llm import language_id
    from pagelake.llm.textbatch import slices

    table = fit(WORDS, np.ones((len(WORDS), 2)) * [[1, 2]], vocabulary_path)
    column = pa.array([t for _, t, _, _ in EDGE])
    part = next(slices(column))
    model = LanguageModel(["a", "b"], table, vocabulary_path)
    first = model.score(part)[0]
    assert np.array_equal(first, model.score(part)[0])
    monkeypatch.setattr(language_id, "CACHED_WORDS", 5)
    assert np.array_equal(first, LanguageModel(["a", "b"], table, vocabulary_path).score(part)[0])
    assert WORD_LETTERS * 95 > 3000  # the long run of the edge documents is cut into stretches
