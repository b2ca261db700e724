import numpy as np
import pytest

from pagelake.llm import minhash_dedup as module
from pagelake.llm.minhash_dedup import CHUNK, CHUNKS, LIMIT, SYMBOLS, chunk_keys, minhash_dedup, reach, signatures

from .conftest import EDGE
from .test_ngram_join import near_copies, roots


def brute(rows, percent=80):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) with every pair compared."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, text in rows:
        words = (text or "").encode().translate(lower).split()
        sets.append({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    found, smallest = roots(len(rows), links), {}
    for root, (doc_id, _) in zip(found, rows, strict=True):
        known = smallest.get(root)
        smallest[root] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return sorted(((d, len(s), smallest[r], d == smallest[r]) for (d, _), s, r in zip(rows, sets, found, strict=True)), key=str)


def rows_of(df):
    return sorted((tuple(r[n] for n in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_against_all_pairs(spark):
    rows = near_copies(np.random.default_rng(11), 40, 6)
    assert rows_of(minhash_dedup(frame(spark, rows))) == brute(rows)


def test_edge_rows(spark, edge_docs, no_docs):
    assert rows_of(minhash_dedup(edge_docs)) == brute([r[:2] for r in EDGE])
    empty = minhash_dedup(no_docs)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def chained(rng, n, words, step):
    """Texts of which each differs from the one before in some words, so that only neighbours link."""
    text, rows = [f"c{x}" for x in rng.integers(0, 10**6, words)], []
    for i in range(n):
        rows.append((i, " ".join(text)))
        at = int(rng.integers(0, words - step))
        text[at : at + step] = [f"d{rng.integers(0, 10**6)}" for _ in range(step)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_groups_of_any_shape(spark, monkeypatch, small):
    """Chains, a hub with far spokes, and a passage that many texts share, also with large buckets, groups and blocks."""
    rng = np.random.default_rng(12)
    rows = chained(rng, 40, 120, 8)
    hub = [f"h{x}" for x in rng.integers(0, 10**6, 150)]
    for i in range(60):
        own = list(hub)
        for at in rng.choice(150, 3, replace=False):
            own[at] = f"s{rng.integers(0, 10**6)}"
        rows.append((1000 + i, " ".join(own)))
    rows.append((999, " ".join(hub)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 10**6, 20))) for i in range(50)]
    if small:
        monkeypatch.setattr(module, "BUCKET", 4)
        monkeypatch.setattr(module, "BLOCK_SETS", 5)
        monkeypatch.setattr(module, "BLOCK_TOKENS", 1500)
    assert rows_of(minhash_dedup(frame(spark, rows))) == brute(rows)


def test_every_pair_within_the_limit_shares_two_keys():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 16, (400, SYMBOLS)).astype("<u2")
    other = base.copy()
    for row in other:
        at = rng.choice(SYMBOLS, LIMIT, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, LIMIT).astype("<u2")
    same = chunk_keys(base) == chunk_keys(other)
    chunks = same.reshape(len(base), CHUNKS, CHUNK).any(2).sum(1)
    assert chunks.min() >= 2


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(14)
    tokens = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    sets = [tokens[i * 10 : i * 10 + 450] for i in range(50)]
    sets = [np.sort(s) for s in sets] + [np.zeros(0, dtype=np.uint64)]
    found = signatures(np.repeat(np.arange(51), [len(s) for s in sets]), np.concatenate(sets), 51)
    # neighbours share 440 of 460
    differing = (found[:49] != found[1:50]).mean()
    assert abs(differing - 20 / 460) < 0.015
    assert not found[50].any()


def test_reach_compares_each_place_once_and_keeps_labels():
    seen = []

    def linked(i, others):
        seen.append(i)
        return abs(others - i) == 1

    assert reach(6, linked).tolist() == [0] * 6 and sorted(set(seen)) == sorted(seen)
    apart = reach(5, lambda i, others: np.zeros(len(others), dtype=bool), np.array([7, 8, 7, 9, 8]))
    assert apart.tolist() == [0, 1, 0, 3, 1]
