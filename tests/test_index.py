"""The stored index gives what a fresh one gives, and an update touches little."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelake.operators.search import build_postings, doc_lengths, match_all_terms, rank_bm25
from pagelake.sources import index as module
from pagelake.sources.index import blocks_read, index_documents, match_index, open_index, rank_index, read_index

SCHEMA = "doc_id long, text string"
QUERIES = {"common": ["aa", "ab"], "rare": ["zz", "aa"], "none": ["nowhere"], "one": ["qq"]}


def made(seed, n, first=0):
    """Texts over few words; some are empty or missing, and rare words stand in few."""
    rnd, words = random.Random(seed), [a + b for a in "abc" for b in "abcdef"]
    docs = {}
    for i in range(first, first + n):
        found = [rnd.choice(words) for _ in range(rnd.randrange(0, 40))] + ["zz"] * (rnd.random() < 0.05) + ["qq"] * (i % 97 == 5)
        rnd.shuffle(found)
        docs[i] = None if rnd.random() < 0.05 else " ".join(found)
    return docs


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), SCHEMA).repartition(3)


def same(spark, base, docs):
    """Postings, matches and ranks of the index against those of the documents themselves."""
    index, rows = open_index(spark, base), frame(spark, docs)
    fresh = build_postings(rows, "doc_id", "text", positions=False)
    assert sorted(map(tuple, read_index(index).collect())) == sorted(map(tuple, fresh.collect()))
    for terms in (["aa"], ["aa", "zz", "bc"], ["aa", "nowhere"]):
        want = match_all_terms(fresh, terms, "doc_id").collect()
        assert sorted(map(tuple, match_index(index, terms).collect())) == sorted(map(tuple, want))
    want = rank_bm25(fresh, doc_lengths(rows, "doc_id", "text"), QUERIES, "doc_id", 5)
    assert sorted(map(tuple, rank_index(index, QUERIES, 5).collect())) == sorted(map(tuple, want.collect()))


def test_updates_and_merges_equal_a_fresh_index(spark, tmp_path):
    base, docs = str(tmp_path / "index"), made(1, 400)
    index_documents(frame(spark, docs), base, 0, "doc_id", "text", fanout=3)
    same(spark, base, docs)
    rnd = random.Random(2)
    for version in range(1, 6):
        changed = {i: text for i, text in made(10 + version, 500).items() if rnd.random() < 0.05}
        if version == 3:
            changed = {i: None for i in list(docs)[:40]}  # these leave the index
        index_documents(frame(spark, changed), base, version, "doc_id", "text", fanout=3)
        docs |= changed
        if version in (1, 3, 5):
            same(spark, base, docs)
    assert len(list((tmp_path / "index" / "blocks").iterdir())) <= 6


def test_a_version_written_again_replaces_itself(spark, tmp_path):
    base, docs = str(tmp_path / "index"), made(3, 60)
    index_documents(frame(spark, docs), base, 0, "doc_id", "text", fanout=2)
    index_documents(frame(spark, {1: "wrong words", 70: "more of them"}), base, 1, "doc_id", "text", fanout=2)
    index_documents(frame(spark, {1: "right aa words"}), base, 1, "doc_id", "text", fanout=2)
    same(spark, base, docs | {1: "right aa words"})


def test_one_changed_document_writes_one_small_segment(spark, tmp_path, monkeypatch):
    base, docs = str(tmp_path / "index"), made(4, 500)
    index_documents(frame(spark, docs), base, 0, "doc_id", "text")
    read, real = [], module._read
    monkeypatch.setattr(module, "_read", lambda spark, base, part, live: read.append(part) or real(spark, base, part, live))
    index_documents(frame(spark, {7: "aa new words aa"}), base, 1, "doc_id", "text")
    assert set(read) <= {"docs", "deleted"}  # no postings of other documents
    seg = spark.read.parquet(f"{base}/blocks/seg={1:012d}-{1:012d}")
    assert sorted(r.term for r in seg.collect()) == ["aa", "new", "words"]
    assert spark.read.parquet(f"{base}/deleted/seg={1:012d}-{1:012d}").count() == (docs[7] is not None)
    monkeypatch.undo()
    same(spark, base, docs | {7: "aa new words aa"})


def test_blocks_without_a_good_document_are_not_unpacked(spark, tmp_path):
    """Short texts full of a word stand in few ranges; long ones with one of it fill the others."""
    good = {i: "aa aa aa ab" for i in range(20)}
    rest = {100 + i: "aa " + " ".join(f"w{j}" for j in range(60)) for i in range(3000)}
    docs, base = good | rest, str(tmp_path / "index")
    index_documents(spark.createDataFrame(sorted(docs.items()), SCHEMA).coalesce(1), base, 0, "doc_id", "text")
    index = open_index(spark, base)
    counted = {r["query"]: (r["blocks"], r["unpacked"]) for r in blocks_read(index, {"q": ["aa", "ab"]}, 10, first=2).collect()}
    assert counted["q"][0] >= 20 and counted["q"][1] <= 4
    fresh = build_postings(frame(spark, docs), "doc_id", "text", positions=False)
    want = rank_bm25(fresh, doc_lengths(frame(spark, docs), "doc_id", "text"), {"q": ["aa", "ab"]}, "doc_id", 10)
    assert sorted(map(tuple, rank_index(index, {"q": ["aa", "ab"]}, 10, first=2).collect())) == sorted(map(tuple, want.collect()))


def test_ranks_among_some_documents(spark, tmp_path):
    docs, base = made(5, 300), str(tmp_path / "index")
    index_documents(frame(spark, docs), base, 0, "doc_id", "text")
    among = spark.createDataFrame([(q, i) for q in QUERIES for i in range(0, 300, 7)], "query string, doc_id long")
    fresh = build_postings(frame(spark, docs), "doc_id", "text", positions=False)
    whole = rank_bm25(fresh, doc_lengths(frame(spark, docs), "doc_id", "text"), QUERIES, "doc_id", 1000).collect()
    want = {}
    for r in sorted((r for r in whole if r.doc_id % 7 == 0), key=lambda r: r["rank"]):
        want.setdefault(r["query"], []).append((r.doc_id, r.score))
    got = {}
    for r in sorted(rank_index(open_index(spark, base), QUERIES, 4, among=among).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append((r.doc_id, r.score))
    assert got == {q: rows[:4] for q, rows in want.items()}


def test_searching_plans_without_a_job(spark, tmp_path):
    base = str(tmp_path / "index")
    index_documents(frame(spark, made(6, 50)), base, 0, "doc_id", "text")
    index = open_index(spark, base)
    spark.sparkContext.setJobGroup("planning", "no job may run in it")
    try:
        rank_index(index, QUERIES, 5)
        match_index(index, ["aa", "ab"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(ValueError, match="no index"):
        open_index(spark, str(tmp_path / "nothing"))


def test_empty_tables(spark, tmp_path):
    base = str(tmp_path / "index")
    index_documents(frame(spark, {}), base, 0, "doc_id", "text")
    index = open_index(spark, base)
    assert read_index(index).count() == 0 and rank_index(index, QUERIES, 3).count() == 0 and match_index(index, ["aa"]).count() == 0
    index_documents(frame(spark, {1: "", 2: None, 3: "aa"}), base, 1, "doc_id", "text")
    same(spark, base, {1: "", 2: None, 3: "aa"})


def test_segments_hold_no_positions(spark, tmp_path):
    """No reader of the index asks for all positions of a term, so none are written."""
    base = str(tmp_path / "index")
    index_documents(spark.createDataFrame([(1, "a b a"), (2, "b c")], "id int, text string"), base, 0, "id", "text")
    assert "positions" not in spark.read.parquet(f"{base}/forward").columns


def shuffled(spark):
    """Sizes of the shuffle files that lie on the disk now."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [Path(f.getPath()) for f in (files.apply(i) for i in range(files.size()))]
    return {p: p.stat().st_size for p in paths if p.name.startswith("shuffle_") and p.exists()}


def test_building_updating_and_merging_shuffle_no_postings(spark, tmp_path):
    rnd, base = random.Random(8), str(tmp_path / "index")
    texts = {i: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(200)) for i in range(400)}
    changes = [texts, {i: "aa" for i in range(0, 400, 4)}, {i: None for i in range(1, 400, 4)}]
    for version, docs in enumerate(changes):
        spark.createDataFrame(sorted(docs.items()), SCHEMA).write.parquet(str(tmp_path / f"docs-{version}"))
    before = shuffled(spark)
    for version in range(len(changes)):
        index_documents(spark.read.parquet(str(tmp_path / f"docs-{version}")), base, version, "doc_id", "text", fanout=3)
    assert (tmp_path / "index" / "blocks" / f"seg={0:012d}-{2:012d}").exists()
    new = sum(size for path, size in shuffled(spark).items() if path not in before)
    assert new < 100_000  # the 80,000 postings took a megabyte
    live = texts | changes[1] | changes[2]
    assert read_index(open_index(spark, base)).count() == sum(len(set(t.split())) for t in live.values() if t)


def test_blocks_hold_places_and_no_keys(spark, tmp_path):
    """Keys and lengths stand in ``docs`` once; a block repeats neither for its postings."""
    base = str(tmp_path / "index")
    index_documents(spark.createDataFrame([(1, "a b a"), (2, "b c")], "id int, text string").coalesce(1), base, 0, "id", "text")
    rows = spark.read.parquet(f"{base}/blocks").drop("seg")
    assert rows.columns == ["range", "term", "n", "max_tf", "min_dl", "offsets", "tfs"]
    assert sorted((r.term, r.n, r.max_tf, r.min_dl, r.offsets, r.tfs) for r in rows.collect()) == [("a", 1, 2, 3, [0], [2]), ("b", 2, 1, 2, [0, 1], [1, 1]), ("c", 1, 1, 2, [1], [1])]


def test_stretches_and_splits_that_cut_ranges(spark, tmp_path, monkeypatch):
    """Small stretches end between ranges; where splits of a file cut ranges, these have more blocks and the same results."""
    monkeypatch.setattr(module, "STRETCH", 3000)
    docs, settings = made(9, 900), {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "0", "parquet.block.size": "1000"}
    for name, conf in (("whole", {}), ("cut", settings)):
        base = str(tmp_path / name)
        for key, value in conf.items():
            spark.conf.set(key, value)
        try:
            index_documents(spark.createDataFrame(list(docs.items()), SCHEMA).coalesce(1), base, 0, "doc_id", "text")
        finally:
            for key in conf:
                spark.conf.unset(key)
        most = spark.read.parquet(f"{base}/blocks").groupBy("range", "term").count().agg(F.max("count")).first()[0]
        assert (most == 1) == (name == "whole")
        same(spark, base, docs)


def test_an_index_takes_less_than_twice_its_forward_rows(spark, tmp_path):
    """Blocks repeat the terms and counts of the forward rows and little else; no table of a build stays beside the segment."""
    rnd, base = random.Random(7), str(tmp_path / "index")
    docs = {i: " ".join(f"w{rnd.randrange(20_000)}" for _ in range(rnd.randrange(400))) for i in range(600)}
    work = Path(str(spark.sparkContext.getCheckpointDir() or tmp_path / "none").removeprefix("file:"))
    before = set(work.glob("*"))
    index_documents(spark.createDataFrame(sorted(docs.items()), SCHEMA).coalesce(1), base, 0, "doc_id", "text")
    size = {part: sum(f.stat().st_size for f in (tmp_path / "index" / part).rglob("*.parquet")) for part in module.PARTS}
    assert sum(size.values()) < 2 * size["forward"], size
    assert set(work.glob("*")) == before
    want = rank_bm25(build_postings(frame(spark, docs), "doc_id", "text", positions=False), doc_lengths(frame(spark, docs), "doc_id", "text"), {"q": ["w1", "w2"]}, "doc_id", 10)
    assert sorted(map(tuple, rank_index(open_index(spark, base), {"q": ["w1", "w2"]}, 10).collect())) == sorted(map(tuple, want.collect()))
