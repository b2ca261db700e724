"""Full-text postings, conjunctive match, BM25 ranking, snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions.text import compute_once, tokenize_simple, words
from pagelake.session import cut_lineage

# BM25 (Robertson and Zaragoza 2009).
K1 = 1.2
B = 0.75


def tokens_of(text: str) -> list[str]:
    """Query terms of a search phrase, the way documents are tokenised; distinct, in order."""
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W_]+", text)))


def token_rows(docs: DataFrame, key: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """(key, pos, term) of every token; with ``terms`` only of those."""
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(words(text)).alias("pos", "word"))
    rows = rows.select(key, F.col("pos").cast("bigint").alias("pos"), F.lower("word").alias("term"))
    return rows if terms is None else rows.filter(F.col("term").isin(*terms))


def doc_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, terms, tfs, firsts, positions) of each document with text: its distinct terms, in order, with counts,
    first positions and all positions.

    Grouped inside the row: the tokens are sorted with their positions, and each
    run of a term is cut out. Nothing is shuffled.
    """
    place = F.transform(tokenize_simple(text), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    rows = compute_once(docs.filter(F.col(text).isNotNull()).select(key, text), {"_s": F.sort_array(place)}).drop(text)
    rows = compute_once(rows, {"_n": F.size("_s"), "_terms": F.col("_s.term"), "_pos": F.col("_s.pos")}).drop("_s")
    places = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1)))
    rows = compute_once(rows, {"_begins": begins})
    rows = compute_once(rows, {"_ends": F.concat(F.slice("_begins", 2, F.greatest(F.size("_begins"), F.lit(1))), F.array("_n"))})
    runs = F.arrays_zip(F.col("_begins").alias("b"), F.slice("_ends", 1, F.size("_begins")).alias("e"))
    return rows.select(
        key, F.col("_n").cast("bigint").alias("dl"),
        F.transform("_begins", lambda b: F.get("_terms", b)).alias("terms"),
        F.transform(runs, lambda r: r["e"] - r["b"]).alias("tfs"),
        F.transform("_begins", lambda b: F.get("_pos", b)).alias("firsts"),
        F.transform(runs, lambda r: F.slice("_pos", r["b"] + 1, r["e"] - r["b"])).alias("positions"),
    )


def build_postings(docs: DataFrame, key: str, text: str, terms: list[str] | None = None, positions: bool = True) -> DataFrame:
    """(term, key, tf, first_pos[, positions]) for documents with text; each row is a document.

    All tokens of a document are in its row, so its postings are made there and
    nothing is shuffled. With ``terms`` only those of some terms are made.
    """
    return _unpacked(doc_postings(docs, key, text), key, terms, positions)


def _unpacked(grouped: DataFrame, key: str, terms: list[str] | None = None, positions: bool = True) -> DataFrame:
    """``build_postings`` from the rows of ``doc_postings``."""
    lists = ["terms", "tfs", "firsts", *(["positions"] if positions else [])]
    zipped = F.arrays_zip(*lists)
    if terms is not None:
        zipped = F.filter(zipped, lambda p: p["terms"].isin(*terms))
    rows = grouped.select(key, F.inline(zipped))
    named = [F.col("terms").alias("term"), key, F.col("tfs").cast("bigint").alias("tf"), F.col("firsts").cast("bigint").alias("first_pos")]
    return rows.select(*named, *([F.col("positions").cast("array<bigint>").alias("positions")] if positions else []))


def doc_lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl): number of tokens per document with text."""
    return docs.filter(F.col(text).isNotNull()).select(key, F.size(words(text)).cast("bigint").alias("dl"))


def match_all_terms(postings: DataFrame, terms: list[str], key: str) -> DataFrame:
    """Keys of documents that hold every term."""
    wanted = list(dict.fromkeys(terms))
    hits = postings.filter(F.col("term").isin(*wanted)).groupBy(key).agg(F.count_distinct("term").alias("n"))
    return hits.filter(F.col("n") == len(wanted)).select(key)


def rank_bm25(
    postings: DataFrame, lengths: DataFrame, queries: dict[str, list[str]], key: str, k: int, digits: int = 6
) -> DataFrame:
    """(query, key, score, rank): the k best documents per query, ties by key.

    ``queries`` maps a name to its terms; Spark broadcasts the (query, term)
    table where its size allows it. Only postings of these terms are read. The
    per-query limit is applied before the shuffle (Spark's window group limit).
    """
    spark = postings.sparkSession
    pairs = [(name, term) for name, terms in queries.items() for term in dict.fromkeys(terms)]
    asked = spark.createDataFrame(pairs, "query string, term string")
    terms = sorted({term for _, term in pairs})
    # read twice below: once for the document frequencies, once for the scores
    hits = cut_lineage(postings.filter(F.col("term").isin(*terms)).select("term", key, "tf"))
    n, avgdl = lengths.agg(F.count("*"), F.avg("dl")).first()
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row per query term
    idf = df.select("term", F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = hits.join(lengths.select(key, "dl", (F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avgdl))).alias("norm")), key)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))
    scored = weighted.join(idf, "term").withColumn("part", part).join(asked, "term")
    scores = scored.groupBy("query", key).agg(F.round(F.sum("part"), digits).alias("score"))
    return search_topk(scores, key, k)


def search_topk(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows per query by score, ties by key."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), key)
    ranked = scores.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)
    return ranked.select("query", key, "score", "rank")


def snippets(hits: DataFrame, docs: DataFrame, key: str, text: str, width: int = 8) -> DataFrame:
    """Words around the first hit; ``hits`` has the key and first_pos (smallest position of a query term)."""
    joined = hits.join(docs.select(key, text), key)
    start = F.greatest(F.col("first_pos") - width, F.lit(0))
    around = F.slice(words(text), (start + 1).cast("int"), (F.col("first_pos") - start + width + 1).cast("int"))
    return joined.withColumn("snippet", F.array_join(around, " ")).drop(text)


def search_incremental(postings: DataFrame, changed: DataFrame, key: str, text: str, positions: bool = False) -> DataFrame:
    """Postings after some documents changed (or lost their text): old rows out, new rows in.

    ``postings`` are those of ``build_postings``, or rows of ``doc_postings``: then whole documents go, and only what
    stays is unpacked. The shuffle has a row for each document and not for each posting.
    """
    old = postings.join(changed.select(key), key, "left_anti").select(*postings.columns)
    if "terms" in postings.columns:
        old = _unpacked(old, key, positions=positions)
    return old.unionByName(build_postings(changed, key, text, positions=positions).select(*old.columns))


def search_document(items: DataFrame, item_tags: DataFrame, tags: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, document): title, site, sorted tags and clean text of every item, joined by line feeds."""
    named = tags.select(F.col("id").alias("tag_id"), "name")
    # a set combines before the shuffle, so an item tagged many times over stays small
    by_item = item_tags.join(named, "tag_id").groupBy(F.col("item_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_set("name")), " ").alias("tag_text")
    )
    texts = contents.select(F.col("item_id").alias("id"), "clean_text")
    joined = items.select("id", "title", "site").join(by_item, "id", "left").join(texts, "id", "left")
    return joined.select("id", F.concat_ws("\n", "title", "site", "tag_text", "clean_text").alias("document"))


def latest_items(items: DataFrame, n: int, status: Column | None = None) -> DataFrame:
    """The n newest items per user (ties by id), with an optional status filter that runs first."""
    rows = items if status is None else items.filter(F.col("status") == status)
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    return rows.withColumn("rank", F.row_number().over(newest).cast("bigint")).filter(F.col("rank") <= n)


def project_item_response(items: DataFrame) -> DataFrame:
    return items.select("id", "user_id", "url", "title", "site", "status", "created_at", "updated_at")
