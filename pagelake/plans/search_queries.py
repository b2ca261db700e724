"""Registered queries over full-text postings of the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators.search import (
    build_postings, doc_lengths, doc_postings, match_all_terms, rank_bm25, search_incremental, search_topk, snippets, token_rows, tokens_of,
)
from pagelake.functions.text import tokenize_simple
from pagelake.session import cut_lineage, work_path
from pagelake.sources.index import index_documents, match_index, open_index, rank_index, read_index
from pagelake.sources.tables import read_texts

QUERIES = {}

# search phrases of the reports
PHRASES = {"q_en": "that the and", "q_de": "und der einung", "q_fr": "dans la rétion", "q_es": "ción para que"}
TOKENS_SQL = r"""tokens as (select doc_id, i - 1 as pos, lower(ws[i]) as term from
  (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') as ws from documents where text is not null), lateral unnest(range(1, len(ws) + 1)) as t(i))"""
POSTINGS_SQL = "postings as (select term, doc_id, count(*) as tf, min(pos) as first_pos from tokens group by term, doc_id)"
TERMS = sorted({t for p in PHRASES.values() for t in tokens_of(p)})


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


def _docs(spark, d):
    return read_texts(spark, d, "documents").select("doc_id", "text")


@query(
    "tokenize",
    f"with {TOKENS_SQL} select doc_id, count(*) as n_tokens, count(distinct term) as n_terms, sum(length(term))::bigint as n_chars from tokens group by doc_id",
)
def tokens(spark, d):
    docs = _docs(spark, d).withColumn("tokens", tokenize_simple("text"))
    return docs.filter(F.size("tokens") > 0).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("n_terms"),
        F.char_length(F.array_join("tokens", "")).cast("bigint").alias("n_chars"),
    )


@query(
    "build_postings",
    f"with {TOKENS_SQL} select term, doc_id, count(*) as tf, min(pos) as first_pos, string_agg(pos, ',' order by pos) as positions from tokens group by term, doc_id",
)
def postings(spark, d):
    return build_postings(_docs(spark, d), "doc_id", "text").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("document_frequency", f"with {TOKENS_SQL}, {POSTINGS_SQL} select term, count(*) as df, sum(tf)::bigint as cf from postings group by term")
def frequencies(spark, d):
    found = build_postings(_docs(spark, d), "doc_id", "text", positions=False)
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    "match_all_terms",
    f"with {TOKENS_SQL} select doc_id from tokens where term in ('that', 'the', 'and') group by doc_id having count(distinct term) = 3",
)
def conjunctive(spark, d):
    terms = tokens_of(PHRASES["q_en"])
    return match_all_terms(build_postings(_docs(spark, d), "doc_id", "text", terms, positions=False), terms, "doc_id")


ASKED_SQL = "asked(query, term) as (values " + ", ".join(
    f"('{q}', '{t}')" for q, p in PHRASES.items() for t in tokens_of(p)
) + ")"
BM25_SQL = f"""with {TOKENS_SQL}, {POSTINGS_SQL}, {ASKED_SQL},
lengths as (select doc_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) as dl from documents where text is not null),
stats as (select count(*) as n, avg(dl) as avgdl from lengths),
idf as (select term, ln(1.0::double + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from postings, stats where term in (select term from asked) group by term, n),
scores as (select a.query, p.doc_id, round(sum(idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
  from postings p join asked a using (term) join idf using (term) join lengths using (doc_id), stats group by 1, 2)"""


@query(
    "rank_bm25",
    BM25_SQL + " select query, doc_id, score, row_number() over (partition by query order by score desc, doc_id) as rank from scores qualify rank <= 10",
)
def ranked(spark, d):
    docs = _docs(spark, d)
    found = build_postings(docs, "doc_id", "text", TERMS, positions=False)
    lengths = cut_lineage(doc_lengths(docs, "doc_id", "text"))
    return rank_bm25(found, lengths, {q: tokens_of(p) for q, p in PHRASES.items()}, "doc_id", 10)


@query(
    "search_stored_postings",
    BM25_SQL + " select query, doc_id, score, row_number() over (partition by query order by score desc, doc_id) as rank from scores qualify rank <= 10",
)
def ranked_from_store(spark, d):
    """The same ranking from a stored index; only blocks that can hold one of the best documents are unpacked."""
    return rank_index(_index(spark, d), {q: tokens_of(p) for q, p in PHRASES.items()}, 10)


def _index(spark, d):
    base = work_path(spark, "index")
    index_documents(_docs(spark, d), base, 0, "doc_id", "text")
    return open_index(spark, base)


@query(
    "search_own_items",
    BM25_SQL + """ select query, doc_id, score, row_number() over (partition by query order by score desc, doc_id) as rank
    from scores join documents using (doc_id) where source = 'src' || length(query) qualify rank <= 10""",
)
def ranked_among(spark, d):
    """Each query over the documents of one owner, here a source."""
    owned = read_texts(spark, d, "documents").select("doc_id", "source")
    queries = {q: tokens_of(p) for q, p in PHRASES.items()}
    asked = spark.createDataFrame([(q, f"src{len(q)}") for q in queries], "query string, source string")
    return rank_index(_index(spark, d), queries, 10, among=owned.join(asked, "source"))


@query(
    "match_stored_index",
    f"with {TOKENS_SQL} select doc_id from tokens where term in ('that', 'the', 'and') group by doc_id having count(distinct term) = 3",
)
def conjunctive_from_store(spark, d):
    return match_index(_index(spark, d), tokens_of(PHRASES["q_en"]))


CHANGED_SQL = r"""with docs as (select doc_id, case when lang = 'fr' then source when lang = 'es' then null else text end as text from documents),
    tokens as (select doc_id, i - 1 as pos, lower(ws[i]) as term from (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') as ws from docs where text is not null),
      lateral unnest(range(1, len(ws) + 1)) as t(i))
    select term, doc_id, count(*) as tf, min(pos) as first_pos from tokens group by term, doc_id"""


@query("index_update", CHANGED_SQL)
def updated_index(spark, d):
    """French documents get a new text, Spanish ones lose theirs: one segment is added, and merged with the first."""
    docs, base = read_texts(spark, d, "documents"), work_path(spark, "index")
    index_documents(docs, base, 0, "doc_id", "text")
    changed = docs.filter(F.col("lang").isin("fr", "es")).select("doc_id", F.when(F.col("lang") == "fr", F.col("source")).alias("text"))
    index_documents(changed.filter("text is not null"), base, 1, "doc_id", "text")
    index_documents(changed.filter("text is null"), base, 2, "doc_id", "text", fanout=3)
    return read_index(open_index(spark, base))


@query(
    "search_topk",
    "select cast(source as varchar) as query, doc_id, n_chars::double as score, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents qualify rank <= 5",
)
def topk(spark, d):
    scores = read_texts(spark, d, "documents").select(F.col("source").alias("query"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    return search_topk(scores, "doc_id", 5)


@query(
    "snippets",
    f"""with {TOKENS_SQL}, hits as (select doc_id, min(pos) as first_pos from tokens where term in ('that', 'the', 'and') group by doc_id),
    w as (select doc_id, first_pos, greatest(first_pos - 8, 0) as start, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') as ws from hits join documents using (doc_id))
    select doc_id, first_pos, array_to_string(ws[start + 1 : first_pos + 9], ' ') as snippet from w""",
)
def snippet_rows(spark, d):
    docs = _docs(spark, d)
    hits = token_rows(docs, "doc_id", "text", tokens_of(PHRASES["q_en"])).groupBy("doc_id").agg(F.min("pos").alias("first_pos"))
    return snippets(hits, docs, "doc_id", "text")


@query(
    "search_incremental",
    CHANGED_SQL,
)
def incremental(spark, d):
    """French documents get a new text, Spanish ones lose theirs."""
    docs = read_texts(spark, d, "documents")
    old = doc_postings(docs, "doc_id", "text").drop("positions")
    changed = docs.filter(F.col("lang").isin("fr", "es")).select("doc_id", F.when(F.col("lang") == "fr", F.col("source")).alias("text"))
    return search_incremental(old, changed, "doc_id", "text")
