import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from pagelake.llm.fingerprints import (
    LEVELS, MOST_BITS, POPULARITY, RANKS, STRETCH, WINDOW, digest, edit_likeness, edited, features, filters, fingerprints, likeness, popularity,
    window_levels,
)

from .conftest import EDGE, PROSE


def chain(text):
    return filters(features(np.frombuffer(text.encode(), dtype=np.uint8)))


def test_levels_are_entropies():
    data = np.frombuffer((PROSE * 3).encode(), dtype=np.uint8)
    levels = window_levels(data)
    for i in range(0, len(levels), 7):
        counts = Counter(data[i : i + WINDOW].tolist()).values()
        bits = -sum(c / WINDOW * math.log2(c / WINDOW) for c in counts)
        assert abs(bits * LEVELS / MOST_BITS - levels[i]) <= 1.01


@pytest.mark.parametrize("block", [1 << 16, 100])
def test_features_are_the_leftmost_best_windows(monkeypatch, block):
    from pagelake.llm import fingerprints as module

    monkeypatch.setattr(module, "BLOCK", block)
    levels = window_levels(np.frombuffer((PROSE * 5).encode(), dtype=np.uint8))
    expected = np.zeros(len(levels), dtype=int)
    for at in range(len(levels) - STRETCH + 1):
        rank = RANKS[levels[at : at + STRETCH]]
        rank = np.where(rank < 0, LEVELS + 1, rank)
        expected[at + int(np.argmin(rank))] += 1
    assert popularity(levels).tolist() == expected.tolist()
    assert POPULARITY <= STRETCH


def test_equal_texts_and_edits(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(r["text"]) > 800]
    for a, b in zip(texts[:30], texts[1:31], strict=True):
        assert likeness(chain(a), chain(a)) == 1.0
        assert digest(chain(a)) == digest(chain(str(a)))
        near, far = likeness(chain(a), chain(edited(a, b))), likeness(chain(a), chain(b))
        assert near == likeness(chain(edited(a, b)), chain(a))
        assert 0 <= far <= 1 and 0 <= near <= 1
        assert a == b or near > 0.25
        assert a == b or near > far or far > 0.9


def test_likeness_limits():
    nothing = chain("")
    assert likeness(nothing, nothing) == 1.0 and likeness(nothing, chain("abc")) == 0.0
    assert likeness(chain("abc"), chain("abc")) == 1.0 and likeness(chain("abc"), chain("abd")) < 0.5
    assert likeness(chain("a" * 5000), chain("a" * 5000)) == 1.0
    rare = "".join(chr(33 + i % 90) for i in range(40_000))
    assert likeness(chain(rare), chain(rare)) == 1.0


def test_edge_documents(edge_docs, no_docs):
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    expected = []
    for i, (doc_id, text, _, _) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        expected.append((
            doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), digest(chain(text)), digest(chain(new)),
            likeness(chain(text), chain(new)), likeness(chain(text), chain(following)),
        ))
    found = [tuple(r) for r in edit_likeness(edge_docs).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    single = {str(r["doc_id"]) + r["fingerprint"] for r in fingerprints(edge_docs).collect()}
    assert single == {str(r[0]) + r[3] for r in expected}
    assert edit_likeness(no_docs).count() == 0 and fingerprints(no_docs).count() == 0


def test_one_row_is_its_own_neighbour(spark):
    row = edit_likeness(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
