"""A corpus pipeline of five stages over the documents table.

Each stage gets the whole result of the one before it, written as Parquet and
read again, and its decisions take effect. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm import language_id, line_dedup, mixing, ngram_join, packing
from pagelake.llm.queries import held_out
from pagelake.llm.store import stored

#: Least share of the probability that the best language must have.
MIN_LANGUAGE_SCORE = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that stages read; all others only pass through.
READ = ("doc_id", "text", "lang", "source")


def with_plain_names(stage: Stage) -> Stage:
    """A stage that sees the columns which only pass through under names of its own, so that none can clash with its work.

    The documents come back under their own names, in their order.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in READ else f"passed_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*docs.columns)

    return run


@with_plain_names
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those without letters, without text or between languages go.

    The fit leaves out the same quarter of the ids as the operator's query. The
    document's own label stays as it is. Every row is judged by its text alone,
    so rows that repeat or share an id, also NULL, stay or go alike; texts of any
    length are read whole, and an empty table stays empty.
    """
    model = language_id.fit_languages(docs.filter(~held_out(docs)), public_tokenizers.path("piece_bpe_32k.model"))
    known = {c: F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "lang_pred", "score")}
    judged = language_id.identify(docs, model, known)
    kept = judged.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@with_plain_names
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted; all documents stay, some with less text.

    Rows that repeat are documents of their own, so the later one loses its
    lines; NULL ids come last. NULL and empty texts stay as they are.
    """
    return line_dedup.line_dedup(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def hashable(field: T.StructField) -> Column:
    """A column as a hash takes it: maps, also inside other types, as JSON."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column


def row_identity(docs: DataFrame) -> Column:
    """25 bytes that only rows equal in all columns share, in the order of doc_id, NULL last."""
    doc_id = F.col("doc_id").cast("long")
    order = F.when(doc_id.isNull(), F.lit("01" + 16 * "0")).otherwise(F.concat(F.lit("00"), F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    values = [x for f in docs.schema for x in (F.isnull(f"`{f.name}`"), hashable(f))]  # a hash passes over NULL
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *values)), 16, "0") for seed in (1, 2)]
    return F.unhex(F.concat(order, *hashes))


@with_plain_names
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, and one of rows that are equal in all columns.

    The decision is by row: the row of the smallest doc_id stays, NULL last, and
    of several with that doc_id the one of least hash. Rows that share a doc_id
    are documents of their own, as are rows without one. Documents without words
    link with nothing and stay.
    """
    marked = docs.withColumn("_row", row_identity(docs))
    found = ngram_join.ngram_join(marked.select(F.col("_row").alias("doc_id"), "text"))
    found = stored(found.select(F.col("doc_id").alias("_row"), "component_id"), "near-components")
    copies = found.filter("component_id <> _row").select("_row").distinct()
    again = found.filter("component_id = _row").groupBy("_row").count().filter("count > 1").select("_row")
    again = stored(again, "repeated-rows")
    others = marked.join(stored(copies.union(again), "near-copies"), "_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not again.limit(1).count():
        return others
    one = marked.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return others.union(one.select(*[F.col(f"`{c}`") for c in docs.columns]))


@with_plain_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for.

    NULL is a source like any other. Documents without words have no size and
    are taken whole as often as their source's whole repetitions; rows that
    repeat are documents of their own.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a NULL text is an empty one, with its end mark alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Neither the language model nor the tokens are SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between stages the documents lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
