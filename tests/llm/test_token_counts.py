import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm.token_counts import LongestMatch, read_pieces, token_counts


def greedy(word, pieces, longest):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 1)
        at, n = at + size, n + 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab ", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=8))
def test_automaton_equals_greedy(pieces, words):
    pieces = {p.encode() for p in pieces}
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    lengths = np.array([len(w) for w in words])
    found = LongestMatch(pieces).count(data, np.cumsum(lengths) - lengths, lengths)
    longest = max(map(len, pieces), default=1)
    assert found.tolist() == [greedy(b" " + w.encode(), pieces, longest) for w in words]


def test_edge_documents(edge_docs, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    pieces = set(read_pieces(path))
    longest = max(map(len, pieces))
    expected = []
    for row in edge_docs.collect():
        words = (row["text"] or "").encode().split()
        expected.append((row["doc_id"], len(words), sum(greedy(b" " + w, pieces, longest) for w in words)))
    found = [tuple(r) for r in token_counts(edge_docs, path).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_empty_table(no_docs, vocabulary):
    assert token_counts(no_docs, vocabulary("byte_bpe_50k.json")).count() == 0


def test_vocabulary_covers_all_bytes(vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    pieces = read_pieces(path)
    assert {p for p in pieces if len(p) == 1} >= {bytes([b]) for b in range(256) if b not in b"\t\n\v\f\r"}
    with open(path, encoding="utf-8") as file:
        assert len(pieces) < len(json.load(file)["model"]["vocab"])
