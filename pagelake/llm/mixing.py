"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target is its weight's share of all words, but at most ``max_epochs``
times its own words; what a capped source cannot give is shared again by weight
among the others until none is above its cap. A source whose target is r times
its words is taken floor(r) times whole. For the rest its documents are put in a
seeded order and taken once more until the target is reached; the document at
the limit gives its leading words only. So a source misses its target by less
than one word for each row that stands at the limit, and no document is taken
more than ``max_epochs`` times.

The seeded order is never built for a whole source: words are summed in buckets
of the order, and only the bucket that holds the limit is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.store import stored
from pagelake.llm.textbatch import WORD_PATTERN

#: Hexadecimal digits of the seeded order that make a bucket: 65,536 buckets of a source. An even number.
BUCKET_DIGITS = 4


def word_total(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, seed: int) -> list[Column]:
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return [F.col("doc_id"), F.col("source").alias("_source"), word_total(F.col("text")).alias("_size"), order.alias("_u")]


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights in turn to the sources by code point, NULL last. One row a source stands in one task, not the documents."""
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    return sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """``sources`` (_source, _source_size, _weight) with the target of each.

    Each round is one small aggregate: the level that the sources below their
    cap share, until no further one is above its cap.
    """
    cap = (F.col("_source_size") * max_epochs).cast("double")
    total = float(sources.agg(F.coalesce(F.sum("_source_size"), F.lit(0))).first()[0]) * share
    level, capped = 0.0, F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(capped, F.col("_source_size") * max_epochs)).alias("taken"),
            F.sum(F.when(~capped, F.col("_weight"))).alias("weight"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if not row["weight"]:
            break
        level = (total - float(row["taken"] or 0)) / float(row["weight"])
        wider = capped | (F.col("_weight") * F.lit(level) > cap)
        if sources.filter(wider).count() == row["n"]:
            break
        # each level is at least the last one, so who was above stays above
        capped = wider
    return sources.withColumn("_target", F.when(capped, cap).otherwise(F.col("_weight") * F.lit(level)))


def _at_limit(rows: DataFrame) -> DataFrame:
    """Of each source the stretch in which the words before reach the need (_n): its _label as _limit, and _before."""
    order = Window.partitionBy("_source").orderBy("_label")
    before = F.col("_base") + F.sum("_words").over(order) - F.col("_words")
    found = rows.withColumn("_before", before).filter("_before < _n and _before + _words >= _n")
    return found.select("_source", "_s", "_n", F.col("_label").alias("_limit"), "_before")


def _limits(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """Per source: whole repetitions, and the bucket and place of the limit; and the groups of equal rows in that bucket."""
    sums = sized.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    sums = stored(sums, "mix-buckets")
    sources = sums.groupBy("_source").agg(F.sum("_words").alias("_source_size"))
    sources = water_fill(stored(cyclic_weights(sources, weights), "mix-sources"), share, max_epochs)
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("_whole", whole)
    sources = sources.withColumn("_need", F.round(F.col("_target") - F.col("_whole") * F.col("_source_size")).cast("long"))

    # the limit among the first digits, and then among the buckets that begin with those: short windows at any size
    needs = sources.select(F.col("_source").alias("_s"), F.col("_need").alias("_n"))
    coarse = F.substring("_bucket", 1, BUCKET_DIGITS // 2)
    top = sums.groupBy("_source", coarse.alias("_label")).agg(F.sum("_words").alias("_words"))
    top = _at_limit(top.join(needs, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_base", F.lit(0)))
    inside = F.col("_source").eqNullSafe(F.col("_s")) & (coarse == F.col("_limit"))
    fine = sums.join(top.drop("_source"), inside).select("_source", "_s", "_n", F.col("_bucket").alias("_label"), "_words", F.col("_before").alias("_base"))
    at_limit = _at_limit(fine).select("_s", "_limit", "_before")
    sources = sources.join(at_limit, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    sources = stored(sources, "mix-limits")

    edge = sized.withColumnRenamed("_source", "_s").join(
        sources, F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_limit"))
    )
    groups = edge.groupBy("_source", "_u", "doc_id", "_size").agg(
        F.count(F.lit(1)).alias("_k"), F.first("_before").alias("_before"), F.first("_need").alias("_need")
    )
    order = Window.partitionBy("_source").orderBy("_u", "doc_id", "_size")
    start = F.col("_before") + F.sum(F.col("_size") * F.col("_k")).over(order) - F.col("_size") * F.col("_k")
    extra = F.greatest(F.lit(0), F.least(F.col("_size") * F.col("_k"), F.col("_need") - start))
    groups = groups.select(
        F.col("_source").alias("_es"), F.col("doc_id").alias("_eid"), F.col("_size").alias("_esize"), F.floor(extra / F.col("_k")).cast("long").alias("_edge")
    )
    return sources, stored(groups, "mix-edge")


def _planned(
    docs: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, seed: int, keep: tuple[str, ...]
) -> DataFrame:
    """One row of ``docs`` each: _size, _source_size, _target, _whole, _extra, and ``keep`` with the prefix _keep_."""
    sized = stored(docs.select(*_sized(docs, seed)).withColumn("_bucket", F.substring("_u", 1, BUCKET_DIGITS)), "mix-sizes")
    sources, edge = _limits(sized, weights, share, max_epochs)
    # without further columns the sizes are there already
    rows = docs.select(*_sized(docs, seed), *[F.col(c).alias(f"_keep_{c}") for c in keep]) if keep else sized.drop("_bucket")
    rows = rows.withColumnRenamed("_source", "_s").join(sources, F.col("_s").eqNullSafe(F.col("_source")))
    at_edge = F.col("_s").eqNullSafe(F.col("_es")) & F.col("doc_id").eqNullSafe(F.col("_eid")) & (F.col("_size") == F.col("_esize"))
    rows = rows.join(edge, at_edge, "left")
    bucket = F.substring("_u", 1, BUCKET_DIGITS)
    extra = (
        F.when(F.col("_limit").isNull(), 0)  # whole repetitions reach the target
        .when(bucket < F.col("_limit"), F.col("_size"))
        .when(bucket > F.col("_limit"), 0)
        .otherwise(F.coalesce("_edge", F.lit(0)))
    )
    return rows.withColumn("_extra", extra.cast("long"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, repeats, extra_words, taken) of each row.

    ``docs`` has doc_id, text and source; other columns are not read, whatever
    their names. A document is taken ``repeats`` times whole and once more with
    its first ``extra_words`` words. NULL and empty texts have size 0 and are
    never taken. NULL is a source of its own, after all others. Rows of the same
    doc_id, source and size share what falls to them evenly, rounded down. An
    empty table gives an empty result. The same table and seed give the same
    plan, however the rows are dealt out.
    """
    rows = _planned(docs, weights, share, max_epochs, seed, ())
    return rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_whole").alias("repeats"), F.col("_extra").alias("extra_words"),
        (F.col("_size") * F.col("_whole") + F.col("_extra")).alias("taken"),
    )


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    found = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD_PATTERN}"), F.lit(0))
    return F.concat_ws("", F.slice(found, F.lit(1), n.cast("int")))


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3, seed: int = 42
) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: each document as often as the plan takes it, a partial repetition last.

    A partial repetition has the leading words of the text, and their length if
    ``docs`` has n_chars. Everything else is as ``mix_plan`` says.
    """
    rows = _planned(docs, weights, share, max_epochs, seed, tuple(docs.columns))
    copies = F.sequence(F.lit(1), (F.col("_whole") + F.when(F.col("_extra") > 0, 1).otherwise(0)).cast("int"))
    rows = rows.filter("_size * _whole + _extra > 0").withColumn("_copy", F.explode(copies))
    part = (F.col("_copy") > F.col("_whole")) & (F.col("_extra") < F.col("_size"))
    rows = rows.withColumn("_part", part)
    text = F.when(F.col("_part"), leading_words(F.col("_keep_text"), F.col("_extra"))).otherwise(F.col("_keep_text"))
    columns = {c: F.col(f"_keep_{c}") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("_part"), F.length(text).cast("long")).otherwise(columns["n_chars"])
    return rows.select(*[columns[c].alias(c) for c in docs.columns])
