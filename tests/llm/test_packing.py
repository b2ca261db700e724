import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pagelake.llm import word_tokens as tokens
from pagelake.llm.packing import SEQUENCE_IDS, fill, hilbert_keys, pack, sequence_lengths
from pagelake.llm.word_tokens import word_tokens

from .conftest import EDGE


def test_hilbert_curve_is_a_path():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        axes = np.indices([1 << bits] * dimensions).reshape(dimensions, -1).T
        keys = hilbert_keys(axes, bits)
        assert sorted(keys.tolist()) == list(range(len(axes)))
        walk = axes[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_fill():
    row, start, length, sequence, offset = fill(np.array([3, 5000, 1, 7]))
    assert length.sum() == 5011
    sizes = np.bincount(sequence, weights=length)
    assert sizes.tolist() == [SEQUENCE_IDS, SEQUENCE_IDS, 512, 256, 128, 16, 2, 1]
    assert sequence_lengths(0) == [] and sequence_lengths(13) == [8, 4, 1]
    for r, s, n in zip(row, start, length, strict=True):
        assert 0 <= s and s + n <= [3, 5000, 1, 7][r]
    assert offset.min() == 0


def check_pieces(rows, documents):
    """Every id of every document in one piece; sequences without gaps."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    left = list(documents)
    for (doc_id, n), own in pieces.items():
        copies = [ids for d, ids in left if d == doc_id and len(ids) == n]
        assert copies
        expected = sorted(
            (r["start"], r["length"], zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())) for ids in copies for r in own
        )
        assert all((r["start"], r["length"], r["ids_crc32"]) in expected for r in own)
        assert sum(r["length"] for r in own) == n * len(copies)
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in documents)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at == SEQUENCE_IDS or at & (at - 1) == 0
        assert at <= SEQUENCE_IDS


def test_edge_documents(edge_docs, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    documents = [
        (d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")) for d, t, _, _ in EDGE
    ]
    rows = pack(edge_docs, path).collect()
    check_pieces(rows, documents)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    again = pack(edge_docs.repartition(5), path, with_ids=False).collect()
    columns = [c for c in again[0].asDict()]
    assert sorted(map(str, ([r[c] for c in columns] for r in rows))) == sorted(map(str, ([r[c] for c in columns] for r in again)))


def test_empty_table(no_docs, vocabulary):
    assert pack(no_docs, vocabulary("word_bpe_49k.json")).count() == 0


def test_word_tokens_are_the_library_s(vocabulary, spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [t for _, t, _, _ in EDGE] + ["  a  b \n\n c\t\td ", "it's we'll 'tis x<|endoftext|>y", "a\xa0\n b  c", "ΑΣ ς ﬁ é İ", "\n\n\nB  C\n", "x\x1cy \x85 z"]
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        tokenizer = Tokenizer.from_file(vocabulary(name))
        ids, counts = word_tokens(vocabulary(name), drops).encode(pa.array(texts))
        limits = np.concatenate([[0], np.cumsum(counts)])
        for i, text in enumerate(texts):
            assert ids[limits[i] : limits[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_usual_parts_are_found_without_a_search(vocabulary, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    texts = ["to be or not to be", "", None, "that is the question", "to be " * 50]
    tokenizer = Tokenizer.from_file(path)
    expected = [i for t in texts for i in tokenizer.encode(t or "", add_special_tokens=False).ids]
    encoder = tokens.WordTokens(path, False)
    assert encoder.encode(pa.array(texts))[0].tolist() == expected
    monkeypatch.setattr(encoder, "_search", None)  # all parts are in the table now
    assert encoder.encode(pa.array(texts))[0].tolist() == expected
    monkeypatch.setattr(tokens, "PLACE_BITS", 1)  # nearly all parts share a place
    crowded = tokens.WordTokens(path, False)
    for _ in range(3):
        assert crowded.encode(pa.array(texts))[0].tolist() == expected
    assert "TOKENIZERS_PARALLELISM" in os.environ  # without the library's threads, unless the user asks for them
