import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelake.llm import id_files, range_coder
from pagelake.llm.range_coder import BLOCK_IDS, read_blocks, write_blocks
from pagelake.session import work_path

from .conftest import EDGE

#: Length and CRC-32 of the blocks of a fixed list of ids.
WRITTEN = (2424, 1322228952)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=60), st.integers(1, 60), st.integers(0, 3))
def test_round_trip(ids, times, shift):
    ids = np.array((ids * times)[: 3 * BLOCK_IDS], dtype=np.uint32) >> np.uint32(4 * shift)
    assert read_blocks(write_blocks(ids)).tolist() == ids.tolist()


def test_repetition_is_small_and_blocks_stand_alone():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.tile(rng.integers(0, 50_000, 40), 100), rng.integers(0, 300, 3000)]).astype(np.uint32)
    blocks = write_blocks(ids)
    assert len(blocks) == -(-len(ids) // BLOCK_IDS)
    assert len(blocks[1][0]) < BLOCK_IDS // 4  # a repeated stretch takes less than two bits an id
    for i, block in enumerate(blocks):
        assert read_blocks([block]).tolist() == ids[i * BLOCK_IDS : (i + 1) * BLOCK_IDS].tolist()


def test_blocks_of_any_order_and_length_and_their_bytes():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 400, n).astype(np.uint32) for n in (0, 7, BLOCK_IDS, 1, 300)]
    blocks = [b for p in parts for b in write_blocks(p)]
    assert read_blocks(blocks).tolist() == np.concatenate(parts).tolist()
    # the bytes are those of the format as it was first written
    content = b"".join(b[0] for b in write_blocks(np.arange(3000, dtype=np.uint32) * 7 % 611))
    assert (len(content), zlib.crc32(content)) == WRITTEN


def test_no_step_gathers_the_intervals_of_all_blocks(monkeypatch):
    """The blocks of a step are the first ones, also where a frame's last block is short."""
    seen = []
    step = range_coder.Model.step
    monkeypatch.setattr(range_coder.Model, "step", lambda self, coder, last, *rest: seen.append(last) or step(self, coder, last, *rest))
    blocks = write_blocks(np.arange(2 * BLOCK_IDS + 5, dtype=np.uint32))
    assert [len(x) for x in seen] == [3] * 5 + [2] * (BLOCK_IDS - 5)
    seen.clear()
    read_blocks(blocks[::-1])
    assert [len(x) for x in seen] == [3] * 5 + [2] * (BLOCK_IDS - 5)


def test_damage_is_found():
    content, n, checksum = write_blocks(np.arange(500, dtype=np.uint32))[0]
    broken = bytes([content[0], content[1] ^ 64, *content[2:]])
    with pytest.raises(ValueError, match="damaged"):
        read_blocks([(broken, n, checksum)])
    with pytest.raises(ValueError, match="damaged"):
        read_blocks([(content[:40], n, checksum)])


def test_too_large_ids():
    with pytest.raises(ValueError, match="65536"):
        write_blocks(np.array([70_000], dtype=np.uint32))


@pytest.mark.parametrize("frame_ids", [4_000_000, 50])
def test_edge_documents(spark, edge_docs, vocabulary, monkeypatch, frame_ids):
    monkeypatch.setattr(id_files, "FRAME_IDS", frame_ids)
    path, file = vocabulary("byte_bpe_50k.json"), work_path(spark, "ids")
    tokenizer = Tokenizer.from_file(path)
    id_files.write_ids(edge_docs, file, path)
    documents = []
    for doc_id, text, _, _ in EDGE:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
        documents.append((doc_id is not None, doc_id or 0, ids.astype("<u2").tobytes(), doc_id, ids.astype("<u4")))
    start, expected = 0, []
    for _, _, _, doc_id, ids in sorted(documents, key=lambda d: d[:3]):
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    found = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in id_files.read_ids(spark, file).collect()]
    assert sorted(found, key=lambda r: r[1]) == expected


def test_empty_table(spark, no_docs, vocabulary):
    file = work_path(spark, "ids")
    id_files.write_ids(no_docs, file, vocabulary("byte_bpe_50k.json"))
    assert id_files.read_ids(spark, file).count() == 0
