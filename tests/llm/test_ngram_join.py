import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from pagelake.llm import ngram_join as module
from pagelake.llm.components import connected_components
from pagelake.llm.ngram_join import ngram_join
from pagelake.llm.queries import OP9_SQL
from pagelake.llm.signature_tree import link_components

from .conftest import EDGE


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text), each row a document of its own."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, text in rows:
        words = (text or "").encode().translate(lower).split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    found = roots(len(rows), links)
    smallest = {}
    for root, (doc_id, _) in zip(found, rows, strict=True):
        known = smallest.get(root)
        smallest[root] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return sorted(((d, len(s), smallest[r]) for (d, _), s, r in zip(rows, sets, found, strict=True)), key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def near_copies(rng, families, members):
    rows = []
    for family in range(families):
        base = [f"w{x}" for x in rng.integers(0, 100_000, int(rng.integers(3, 90)))]
        for _ in range(members):
            words = list(base)
            for place in rng.integers(0, len(words), int(rng.integers(0, 3))):
                words[place] = f"e{rng.integers(0, 10**6)}"
            rows.append((" ".join(words)).title() if rng.random() < 0.3 else " ".join(words))
    order = rng.permutation(len(rows))
    return [(int(i) * 3 - 50, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("block", "members"), [(1_000_000, 8), (150, 40)])
def test_equals_brute_force(spark, monkeypatch, block, members):
    monkeypatch.setattr(module, "BLOCK_TOKENS", block)  # the small one cuts groups into many blocks
    rows = near_copies(np.random.default_rng(block), 12, members)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(ngram_join(docs)) == brute(rows)


def test_edge_documents(edge_docs, no_docs):
    assert rows_of(ngram_join(edge_docs)) == brute([(d, t) for d, t, _, _ in EDGE])
    assert ngram_join(no_docs).count() == 0


def test_exact_threshold(spark):
    def text(words):
        return " ".join(f"t{w}" for w in words)

    # 19 words have 15 shingles; a new last word of 20 words: 15 of 17 shared; exactly 75 percent: 6 of 8
    rows = [(1, text(range(11))), (2, text([*range(10), 99])), (3, text([*range(11), 50])), (4, text(range(200, 211))), (5, text([*range(200, 210), 300]))]
    rows.append((6, text(range(200, 209))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join(docs)) == brute(rows)


def test_twin_agrees_with_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    twin = sorted(con.execute(OP9_SQL).fetchall(), key=str)
    assert twin == brute([(r["doc_id"], r["text"]) for r in docs.collect()]) == rows_of(ngram_join(docs))


def test_a_part_of_the_tokens_is_held_few_times_over(spark, monkeypatch):
    """A task that looks for shared tokens had ten arrays of the size of its part."""
    names = f"{module._PACKED}, {module._HOME.format(kind='bigint')}"
    packed = spark.createDataFrame([], names)
    monkeypatch.setattr(module, "map_batches", lambda df, run, names: run)
    run = module._shared_tokens(packed, 4)
    rng, n = np.random.default_rng(0), 400_000
    tokens = np.unique(rng.integers(0, 1 << 46, n).astype(np.uint64))
    halves = [tokens[::2], np.union1d(tokens[1::2], tokens[:100:2])]
    often, times = tokens[-3:], np.array([2, 3, 2], dtype="<u4")
    rows = [
        {"part": 0, "unit": i, "home": False, "tokens": module.pack48(h), "docs": np.zeros(len(h), dtype="<u2").tobytes(),
         "often": module.pack48(often), "times": times.tobytes()}
        for i, h in enumerate(halves)
    ]
    schema = to_arrow_schema(packed.schema)
    batches = [pa.RecordBatch.from_pylist([row], schema=schema) for row in rows]
    tracemalloc.start()
    found = [batch.to_pylist()[0] for batch in run(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    singles = [set(module.unpack48(f["tokens"]).tolist()) - set(often.tolist()) for f in found]
    assert singles == [set(tokens[:100:2].tolist())] * 2
    # 4, 6 and 4 documents of the frequent tokens, and one more where one of the halves has the token alone
    assert all(np.frombuffer(f["times"], dtype=np.uint8)[-3:].tolist() == module.rarity(np.array([5, 7, 5])).tolist() for f in found)
    assert peak < 50 * len(tokens)


def test_signature_trees():
    rng = np.random.default_rng(3)
    for _ in range(10):
        sets, groups = [], []
        for group in range(int(rng.integers(1, 5))):
            base = rng.integers(0, 1 << 47, int(rng.integers(1, 100))).tolist()
            for _ in range(int(rng.integers(1, 70))):
                own = set(base[int(len(base) * rng.random() * 0.4) :]) | {int(x) for x in rng.integers(0, 1 << 47, int(rng.integers(0, 12)))}
                sets.append(sorted(own))
                groups.append(group)
        sizes = np.array([len(s) for s in sets])
        tokens = np.array([t for s in sets for t in s], dtype=np.uint64)
        found = link_components(np.array(groups), sizes, np.concatenate([[0], np.cumsum(sizes)]), tokens, 75)
        links = [
            (i, j) for i in range(len(sets)) for j in range(i)
            if groups[i] == groups[j] and 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))
        ]
        expected = roots(len(sets), links)
        assert len({(a, b) for a, b in zip(expected, found.tolist(), strict=True)}) == len(set(expected)) == len(set(found.tolist()))


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(900, 900)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots(1000, links)
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: expected[x] for x in ends}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
