import re
from collections import Counter

import numpy as np

from pagelake.llm.quality_rules import COUNTS, base_statistics, chi_squared, quality_rules

from .conftest import EDGE


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(lines),
    )


def test_counts_equal_brute_force(spark, edge_docs):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for docs in (edge_docs, real):
        texts = docs.select("doc_id", "text").collect()
        found = [(r["doc_id"], *[r[c] for c in COUNTS], r["base_failed"]) for r in base_statistics(docs).collect()]
        expected = []
        for r in texts:
            n = counts_of(r["text"])
            expected.append((r["doc_id"], *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
        assert sorted(map(str, found)) == sorted(map(str, expected))


def test_outliers_go_and_usual_documents_stay(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for i in range(900):
        words = rng.choice(vocabulary, rng.integers(40, 400)).tolist()
        if i % 50 == 7:
            words = [w + "$$$$" for w in words]
        if i % 50 == 9:
            words = ["".join(rng.choice(list("abcdefghij"), 90)) for _ in words]
        rows.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), "en" if i % 2 else None, "hot" if i % 3 else f"s{i % 9}"))
    result = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in result.collect()}
    assert len(kept) == 900
    strange = {i for i in kept if i % 50 in (7, 9)}
    assert not any(kept[i] for i in strange)
    assert all(kept[i] for i in kept if i not in strange)


def test_edge_documents(edge_docs, no_docs):
    rows = quality_rules(edge_docs).collect()
    assert len(rows) == len(EDGE)
    assert all(r["base_failed"] and r["kept"] is False and r["distance"] is None for r in rows if r["n_words"] < 10)
    assert all(r["kept"] is not None for r in rows)
    assert quality_rules(no_docs).count() == 0


def test_good_labels_are_kept(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").filter("quality = 1 and not base_failed")
    row = found.selectExpr("count(*) as n", "count_if(kept) as kept").first()
    assert row["kept"] >= 0.99 * row["n"]


def test_quantile():
    assert abs(chi_squared(0.95, 5) - 11.07) < 0.05 and abs(chi_squared(0.75, 5) - 6.63) < 0.05


def new_lines(rng):
    """A function of (words, letters): lines of ten random words."""
    return lambda n, letters=6: [" ".join("".join(w) for w in rng.choice(list("abcdefgh"), (10, letters))) for _ in range(n // 10)]


def test_an_outlier_in_each_dimension_goes(spark):
    rng = np.random.default_rng(9)
    text = new_lines(rng)
    rows = [text(int(rng.integers(36, 45)) * 10) for _ in range(300)]
    short, again = [" ".join(line.split()[:2]) for line in text(150)], text(30)
    strange = {
        "many words": text(8000), "few words": text(20), "long words": text(400, 16), "short words": text(400, 2),
        "symbols": [line + " #" if i % 2 else line for i, line in enumerate(text(400))],
        # 15 lines of two words stand twice, each between others, so that no window of five words does
        "lines": [part for pair in zip(text(300), short + short) for part in pair],
        # 60 of 400 words stand twice, inside lines that differ
        "repeats": text(340) + [f"u{k} {line}" for k in range(2) for line in again],
    }
    cases = [*rows, *strange.values()]
    table = [(i, "\n".join(x), "en", "tight") for i, x in enumerate(cases)]
    found = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")).collect()}
    for i, name in enumerate(strange, len(rows)):
        assert not found[i]["base_failed"] and not found[i]["kept"], (name, found[i])
    assert sum(found[i]["kept"] for i in range(len(rows))) >= 0.99 * len(rows)
