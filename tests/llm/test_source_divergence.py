import re
from collections import Counter, defaultdict

import numpy as np

from pagelake.llm import source_divergence as module
from pagelake.llm.source_divergence import gallop, merge_pair, prices, source_divergence

from .conftest import EDGE

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top=50):
    """The audit of (text, lang, source) rows, every kept term with every group."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        sources = sorted(s for own, s in counts if own == lang)
        for s in sources:
            whole.update(counts[lang, s])

        def price(found):
            total = sum(found[t] for t in kept)
            return {t: 1 + 10**9 * (found[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = price(whole), {s: price(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(rng, n):
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(3)] + ["Ärger", "ÄRGER", "naïve", "ﬀ", "日本"]
    rows = []
    for _ in range(n):
        chosen = rng.choice(words, int(rng.integers(0, 30)))
        rows.append((", ".join(w.title() if rng.random() < 0.2 else w for w in chosen), rng.choice(["en", "fr", "", "rare"], p=[0.6, 0.2, 0.15, 0.05]), f"s{rng.integers(0, 7)}"))
    return [*rows, (None, None, None), ("", "en", "blank"), ("12 %", "xx", "a"), ("12 %", "xx", "b")]


def test_against_brute_force(spark, monkeypatch):
    rows = made(np.random.default_rng(3), 300)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert rows_of(source_divergence(docs, 6)) == brute(rows, 6)
    # several blocks of terms and tiles of groups, and ranks cut off
    monkeypatch.setattr(module, "TILE_ENTRIES", 10)
    assert rows_of(source_divergence(docs, 6, top=4, block_terms=7, tile_groups=2)) == brute(rows, 6, 4)


def test_edge_rows(edge_docs):
    rows = [r[1:4] for r in EDGE]
    assert rows_of(source_divergence(edge_docs, 2)) == brute(rows, 2)


def test_language_without_kept_terms_has_pairs_of_zero(spark):
    docs = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], "text string, lang string, source string")
    assert rows_of(source_divergence(docs)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_empty_table(no_docs):
    assert source_divergence(no_docs).collect() == []


def test_galloping_finds_what_sets_find():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 9000), (700, 20_000), (5000, 5000), (3, 0)):
        a, b = (np.unique(rng.integers(0, 30_000, size)) for size in (n, m))
        x, y = gallop(a, b)
        assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()


def test_prices_are_exact_at_large_counts():
    counts = [0, 1, 10**14, 123456789012345]
    total, terms = 9 * 10**14 + 7, 12_345
    expected = [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]
    assert prices(np.array(counts), total, terms).tolist() == expected
    assert prices(np.array([7]), 7, 1).tolist() == [1 + 10**9]


def test_merge_prices_one_sided_and_common_terms():
    a = (np.array([1, 3, 5]), np.array([10, 20, 30]), 2)
    b = (np.array([3, 4]), np.array([25, 7]), 1)
    assert merge_pair(a, b) == ((10 - 1) + abs(20 - 25) + (30 - 1) + abs(2 - 7), 4)
    assert merge_pair(b, a) == merge_pair(a, b)
