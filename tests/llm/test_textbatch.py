import tracemalloc

import numpy as np
import pytest

from pagelake.llm import language_id, textbatch
from pagelake.llm.textbatch import BYTE_VALUES, U64, mix, span_hashes


def peak_mb(run):
    """Largest size of the arrays and objects that a call makes, in MB."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def plain_hash(data):
    value = sum(int(v) * pow(textbatch._BASE, i, 1 << 64) for i, v in enumerate(BYTE_VALUES[data])) % (1 << 64)
    return int(mix(np.array([value ^ len(data)], dtype=U64))[0])


@pytest.mark.parametrize("stretch", [1, 7, 1 << 17])
def test_hashes_do_not_depend_on_the_stretch(monkeypatch, stretch):
    monkeypatch.setattr(textbatch, "HASH_BYTES", stretch)
    textbatch._powers.cache_clear()
    data = np.random.default_rng(0).integers(0, 256, 400).astype(np.uint8)
    starts = np.array([0, 0, 5, 5, 9, 40, 300])
    ends = np.array([0, 5, 5, 9, 40, 300, 399])
    assert span_hashes(data, starts, ends).tolist() == [plain_hash(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert not len(span_hashes(data, starts[:0], ends[:0]))
    textbatch._powers.cache_clear()


def test_hashing_holds_a_stretch_at_a_time():
    """Two MB of words had work arrays and kept powers of 100 MB in each Python worker."""
    textbatch._powers.cache_clear()
    starts = np.arange(0, 2 << 20, 8)
    data = np.full(2 << 20, 97, dtype=np.uint8)
    assert peak_mb(lambda: span_hashes(data, starts, starts + 7)) < 20


def test_letters_are_found_without_a_list_of_all_characters():
    assert peak_mb(language_id.letters.__wrapped__) < 30
