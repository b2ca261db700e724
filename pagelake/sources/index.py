"""A stored full-text index: immutable segments of posting blocks, with lists of deleted documents.

A segment numbers its documents in ranges of ``RANGE`` and holds

* ``forward``: each document with its place, its terms, their counts and first positions,
* ``blocks``: for each term and range one row with the documents' offsets and counts, and the largest count and least
  length that bound a document's score,
* ``docs``: where each key stands, and its length,
* ``deleted``: the places in older segments whose documents it replaces.

Blocks are made from the forward rows where these lie, in stretches of ranges that are ordered by term, so no posting is
shuffled; a search looks into the pages of its terms in every file. Blocks hold places and not keys: the keys of the
documents found are those of ``docs``.

An update writes one segment with the changed documents; of older segments it reads keys only. Segments are merged from
their forward rows when a level is full, without the deleted documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelake.operators.search import K1, B, doc_postings, search_topk
from pagelake.sources.contents import FANOUT, Segment, _find, _remove, live_segments, run_to_merge

#: Documents of a range, a power of two, and 64-bit words of the bitmap of its deleted ones.
RANGE = 128
WORDS = RANGE // 64
#: Postings, and bytes of their documents, from which on a stretch of ranges is made into blocks; rows of one Arrow batch.
STRETCH = 1_000_000
STRETCH_BYTES = 32 << 20
BATCH = 16_384
#: Ranges with deleted documents that a merge sends to every executor, some 100 bytes each; more are joined by Spark's choice.
MOST_GONE = 500_000
#: Ranges that are scored for the threshold.
FIRST_RANGES = 4
#: Decimal places of a score.
DIGITS = 6
PARTS = ("forward", "blocks", "docs", "deleted", "stats")


@dataclass
class Index:
    """The rows of an index's live segments; ``gone`` has the deleted places by segment and range, where there can be any."""

    key: str
    forward: DataFrame
    blocks: DataFrame
    docs: DataFrame
    gone: DataFrame | None
    stats: DataFrame


def _name(seg: Segment) -> str:
    return f"seg={seg[0]:012d}-{seg[1]:012d}"


def _segments(spark: SparkSession, base: str) -> list[Segment]:
    """Segments that were written to their end; the statistics are written last."""
    marks = _find(spark, f"{base}/stats/seg=*/_SUCCESS")
    return sorted((int(a), int(b)) for a, b in (re.search(r"seg=(\d+)-(\d+)", m).groups() for m in marks))


def _drop(spark: SparkSession, base: str, seg: Segment) -> None:
    for part in reversed(PARTS):
        _remove(spark, f"{base}/{part}/{_name(seg)}")


def _read(spark: SparkSession, base: str, part: str, live: list[Segment]) -> DataFrame:
    """Rows of some segments with ``seg``, the segment's last version."""
    paths = [f"{base}/{part}/{_name(s)}" for s in live]
    rows = spark.read.option("basePath", f"{base}/{part}").parquet(*paths)
    return rows.withColumn("seg", F.substring_index(F.col("seg").cast("string"), "-", -1).cast("long"))


def _blocks(forward: DataFrame) -> DataFrame:
    """The blocks of forward rows, in stretches of whole ranges that are ordered by term and range.

    The rows of a range follow each other in one file. Where a file's splits cut a range, each part has blocks of its
    own, which no reader minds.
    """
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("range", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()),
        T.StructField("max_tf", T.IntegerType()), T.StructField("min_dl", T.LongType()), T.StructField("offsets", numbers), T.StructField("tfs", numbers),
    ])
    arrow = to_arrow_schema(schema)

    def lists(values: np.ndarray, limits: np.ndarray, name: str) -> pa.Array:
        field = arrow.field(name).type
        return pa.ListArray.from_arrays(pa.array(limits, type=pa.int32()), pa.array(values).cast(field.value_type)).cast(field)

    def block_rows(held: pa.Table) -> Iterator[pa.RecordBatch]:
        terms = held.column("terms").combine_chunks()
        owner = np.repeat(np.arange(held.num_rows), terms.value_lengths().fill_null(0).to_numpy())
        if not len(owner):
            return
        coded = terms.flatten().dictionary_encode()
        by_term = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by_term), dtype=np.int64)
        rank[by_term] = np.arange(len(by_term))
        ranges, own = np.unique(held.column("range").to_numpy(), return_inverse=True)
        place = rank[coded.indices.to_numpy()] * len(ranges) + own[owner]
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        begins = np.flatnonzero(np.diff(place, prepend=-1))
        limits = np.append(begins, len(place))
        tf, dl = held.column("tfs").combine_chunks().flatten().to_numpy()[order], held.column("dl").to_numpy()[owner]
        rows = {
            "range": pa.array(ranges[place[begins] % len(ranges)]), "term": coded.dictionary.take(pa.array(by_term[place[begins] // len(ranges)])),
            "n": pa.array(np.diff(limits).astype(np.int32)), "max_tf": pa.array(np.maximum.reduceat(tf, begins).astype(np.int32)),
            "min_dl": pa.array(np.minimum.reduceat(dl, begins)), "offsets": lists(held.column("offset").to_numpy()[owner], limits, "offsets"), "tfs": lists(tf, limits, "tfs"),
        }
        made = pa.RecordBatch.from_arrays([rows[f.name] for f in arrow], schema=arrow)
        for i in range(0, made.num_rows, BATCH):
            yield made.slice(i, BATCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            size += batch.nbytes
            if postings < STRETCH and size < STRETCH_BYTES:
                continue
            table = pa.Table.from_batches(held)
            ranges = table.column("range").to_numpy()
            whole = int(np.flatnonzero(ranges == ranges[-1])[0]) if len(ranges) else 0
            if whole:
                yield from block_rows(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                postings, size = sum(len(b.column("terms").flatten()) for b in held), sum(b.nbytes for b in held)
        if held:
            yield from block_rows(pa.Table.from_batches(held))

    return forward.select("range", "offset", "dl", "terms", "tfs").mapInArrow(run, schema)


def _write_segment(forward: DataFrame, deleted: DataFrame, base: str, seg: Segment, key: str) -> None:
    spark = forward.sparkSession
    _drop(spark, base, seg)
    paths = {part: f"{base}/{part}/{_name(seg)}" for part in PARTS}
    # a task's numbers follow each other and begin at a multiple of RANGE
    numbered = forward.withColumn("_n", F.monotonically_increasing_id())
    place = F.shiftright("_n", RANGE.bit_length() - 1).alias("range")
    numbered = numbered.select(key, place, F.col("_n").bitwiseAND(RANGE - 1).cast("int").alias("offset"), "dl", "terms", "tfs", "firsts")
    numbered.write.option("compression", "zstd").parquet(paths["forward"])
    rows = spark.read.schema(numbered.schema).parquet(paths["forward"])
    docs = rows.select(key, "range", "offset", "dl")
    docs.repartitionByRange(key).sortWithinPartitions(key).write.parquet(paths["docs"])
    _blocks(rows).write.option("compression", "zstd").parquet(paths["blocks"])
    deleted.write.parquet(paths["deleted"])
    docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).write.parquet(paths["stats"])


def _gone(deleted: DataFrame) -> DataFrame:
    """(seg, range, gone): a bitmap of the deleted offsets of each range that has any."""
    word, bit = F.shiftright("offset", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("offset", F.lit(64)))
    words = [F.bit_or(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    found = deleted.groupBy(F.col("old").alias("seg"), "range").agg(*words)
    return found.select("seg", "range", F.array(*[f"w{w}" for w in range(WORDS)]).alias("gone"))


def _bit(words: Column, offset: Column) -> Column:
    """Whether a bitmap holds an offset."""
    word = F.element_at(words, (F.shiftright(offset, 6) + 1).cast("int"))
    return F.call_function("shiftright", word, F.pmod(offset, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _marked(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows with ``gone``, the bitmap of their range's deleted offsets."""
    none = F.array(*[F.lit(0).cast("long")] * WORDS)
    if gone is None:
        return rows.withColumn("gone", none)
    return rows.join(gone, ["seg", "range"], "left").withColumn("gone", F.coalesce("gone", none))


def _without(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows of documents, with their offsets, less the deleted ones."""
    return rows if gone is None else _living(_marked(rows, gone))


def _living(marked: DataFrame) -> DataFrame:
    return marked.filter(~_bit(F.col("gone"), F.col("offset"))).drop("gone")


def _key_of(spark: SparkSession, base: str) -> str:
    found = _find(spark, f"{base}/key=*")
    if not found:
        raise ValueError(f"no index in {base}")
    return re.search(r"key=([^/]+)$", found[0]).group(1)


def _deleted_schema(key: str, kind: T.DataType) -> T.StructType:
    fields = [("old", T.LongType()), (key, kind), ("range", T.LongType()), ("offset", T.IntegerType()), ("dl", T.LongType())]
    return T.StructType([T.StructField(*f) for f in fields])


def index_documents(docs: DataFrame, base: str, version: int, key: str, text: str, fanout: int = FANOUT) -> None:
    """Add or replace documents (key, text), each key once; a document without text leaves the index.

    Writes one segment, and merges segments where a level is full. Of the
    segments before only the keys are read. Writing the newest version again
    replaces it and what was merged with it.
    """
    spark = docs.sparkSession
    held = _segments(spark, base)
    for old in held:
        if old[1] >= version:
            _drop(spark, base, old)
    live = live_segments(held, version)
    schema = _deleted_schema(key, docs.schema[key].dataType)
    deleted = spark.createDataFrame([], schema).coalesce(1)
    if live:
        places = _read(spark, base, "docs", live).select(F.col("seg").alias("old"), key, "range", "offset", "dl")
        places = places.join(docs.select(key).distinct(), key, "left_semi")
        known = _read(spark, base, "deleted", live).select("old", "range", "offset")
        deleted = places.join(known, ["old", "range", "offset"], "left_anti").select(*schema.names).coalesce(1)
    else:
        spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}").coalesce(1).write.mode("overwrite").parquet(f"{base}/key={key}")
    _write_segment(doc_postings(docs, key, text).drop("positions"), deleted, base, (version, version), key)
    merge_index(spark, base, version, fanout)


def merge_index(spark: SparkSession, base: str, version: int, fanout: int = FANOUT) -> None:
    """Merge the newest segments where a level is full, without their deleted documents.

    What a merge replaces stays until a later version is written, for a replay of this one.
    """
    held = _segments(spark, base)
    live = live_segments(held)
    for old in held:
        if any(old != s and s[0] <= old[0] and old[1] <= s[1] < version for s in live):
            _drop(spark, base, old)
    run = live[len(live) - run_to_merge(live, fanout) :]
    if len(run) < 2:
        return
    key = _key_of(spark, base)
    deleted = _read(spark, base, "deleted", run).drop("seg")
    inside = F.col("old").isin([s[1] for s in run])
    gone = _gone(deleted.filter(inside))
    if gone.count() <= MOST_GONE:
        gone = F.broadcast(gone)  # else the wide rows would be shuffled
    kept = _without(_read(spark, base, "forward", run), gone)
    seg = (run[0][0], run[-1][1])
    _write_segment(kept.select(key, "dl", "terms", "tfs", "firsts"), deleted.filter(~inside), base, seg, key)


def open_index(spark: SparkSession, base: str) -> Index:
    """The index as it stands; no row is read yet."""
    live, key = live_segments(_segments(spark, base)), _key_of(spark, base)
    docs, sizes = _read(spark, base, "docs", live), _read(spark, base, "stats", live).select("docs", "dl")
    gone = None
    if len(live) > 1:  # a segment replaces documents of others only
        deleted = _read(spark, base, "deleted", live).select("old", "range", "offset", "dl")
        gone = _gone(deleted)
        sizes = sizes.unionByName(deleted.select(F.lit(-1).cast("long").alias("docs"), (-F.col("dl")).alias("dl")))
    stats = sizes.agg(F.sum("docs").alias("docs"), F.sum("dl").alias("dl"))
    return Index(key, _read(spark, base, "forward", live), _read(spark, base, "blocks", live), docs, gone, stats)


# --------------------------------------------------------------------- reading


def _alive(index: Index, terms: Iterable[str]) -> DataFrame:
    """The blocks of some terms with ``gone``; the filter reaches the files, whose stretches are ordered by term."""
    return _marked(index.blocks, index.gone).filter(F.col("term").isin(sorted(set(terms))))


def _frequencies(heads: DataFrame, index: Index) -> DataFrame:
    """(term, df) over live documents, from block heads, and the offsets where documents were deleted."""
    dead = F.lit(0) if index.gone is None else F.size(F.filter("offsets", lambda o: _bit(F.col("gone"), o)))
    return heads.groupBy("term").agg(F.sum((F.col("n") - dead).cast("long")).alias("df"))


def read_index(index: Index) -> DataFrame:
    """(term, key, tf, first_pos) of every live posting, from the forward rows."""
    rows = _without(index.forward, index.gone).select(index.key, F.inline(F.arrays_zip("terms", "tfs", "firsts")))
    return rows.select(F.col("terms").alias("term"), index.key, F.col("tfs").cast("long").alias("tf"), F.col("firsts").cast("long").alias("first_pos"))


def match_index(index: Index, terms: list[str]) -> DataFrame:
    """Keys of live documents that hold every term.

    Terms are taken from the rarest on. Offsets meet by range, and a later
    term's are looked up only for ranges that still have a document.
    """
    wanted = list(dict.fromkeys(terms))
    heads = _alive(index, wanted)
    order = F.sort_array(F.collect_list(F.struct("df", "term")))
    ranked = _frequencies(heads, index).groupBy(F.lit(1).alias("all")).agg(order.alias("o")).select(F.posexplode("o").alias("place", "o")).select("place", "o.term")
    placed = heads.join(ranked, "term")
    found = placed.filter("place = 0").select("seg", "range", "offsets", "gone")
    for place in range(1, len(wanted)):
        after = placed.filter(F.col("place") == place).select("seg", "range", F.col("offsets").alias("more"))
        found = found.join(after, ["seg", "range"]).withColumn("offsets", F.array_intersect("offsets", "more")).drop("more").filter(F.size("offsets") > 0)
    rows = _living(found.select("seg", "range", "gone", F.explode("offsets").alias("offset")))
    return rows.join(index.docs.select("seg", "range", "offset", index.key), ["seg", "range", "offset"]).select(index.key)


def _bounds(index: Index, queries: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(blocks with the weight of their term in each query, upper bound of each query's scores by range)."""
    spark = index.blocks.sparkSession
    pairs = [(name, term) for name, terms in queries.items() for term in dict.fromkeys(terms)]
    asked = spark.createDataFrame(pairs, "query string, term string")
    heads = _alive(index, [term for _, term in pairs])
    one = F.lit(1).alias("one")
    sizes = index.stats.select(F.col("docs").alias("all_docs"), (F.col("dl") / F.col("docs")).alias("avgdl"), one)
    idf = F.log(F.lit(1.0) + (F.col("all_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = _frequencies(heads, index).select("term", "df", one).join(sizes, "one").select("term", idf.alias("idf"), "avgdl").join(asked, "term")
    weighted = heads.join(weights, "term")
    best = F.col("idf") * _part(F.col("max_tf"), F.col("min_dl"))
    return weighted, weighted.groupBy("query", "seg", "range").agg(F.sum(best).alias("bound"), F.count(F.lit(1)).alias("blocks"))


def _part(tf: Column, dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.col("avgdl")))


def _scores(weighted: DataFrame, chosen: DataFrame, index: Index, among: DataFrame | None) -> DataFrame:
    """(query, key, score) of the documents in the chosen ranges."""
    rows = weighted.join(chosen.select("query", "seg", "range"), ["query", "seg", "range"])
    rows = rows.select("query", "seg", "range", "idf", "avgdl", "gone", F.inline(F.arrays_zip(F.col("offsets").alias("offset"), F.col("tfs").alias("tf"))))
    rows = _living(rows).join(index.docs.select("seg", "range", "offset", "dl", index.key), ["seg", "range", "offset"])
    rows = rows.withColumn("part", F.col("idf") * _part(F.col("tf"), F.col("dl")))
    found = rows.groupBy("query", "seg", "range", "offset").agg(F.sum("part").alias("score"), F.first(index.key).alias(index.key))
    return found if among is None else found.join(among.select("query", index.key), ["query", index.key], "left_semi")


def candidate_ranges(index: Index, queries: dict[str, list[str]], k: int, among: DataFrame | None = None, first: int = FIRST_RANGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weighted blocks, bounds of all ranges, ranges that can hold one of the k best documents of a query).

    The ``first`` ranges of highest bound are scored, and their k-th best score
    is the threshold: a range whose bound is lower holds none of the k best.
    """
    weighted, bounds = _bounds(index, queries)
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "seg", "range")
    head = bounds.withColumn("_n", F.row_number().over(by_bound)).filter(F.col("_n") <= first)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"))
    reached = _scores(weighted, head, index, among).withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") == k)
    able = bounds.join(reached.select("query", F.col("score").alias("least")), "query", "left")
    # scores are rounded before they are ranked, so equal ones may differ by the last digit
    return weighted, bounds, able.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS))


def rank_index(index: Index, queries: dict[str, list[str]], k: int, among: DataFrame | None = None, first: int = FIRST_RANGES) -> DataFrame:
    """(query, key, score, rank): the k best documents per query by BM25, ties by key.

    ``among`` (query, key) restricts each query to some documents, such as the
    items of its user; document frequencies stay those of the whole index. No
    job runs before the result is asked for.
    """
    weighted, _, able = candidate_ranges(index, queries, k, among, first)
    scores = _scores(weighted, able, index, among).select("query", index.key, F.round("score", DIGITS).alias("score"))
    return search_topk(scores, index.key, k)


def blocks_read(index: Index, queries: dict[str, list[str]], k: int, first: int = FIRST_RANGES) -> DataFrame:
    """(query, blocks, unpacked): the blocks of each query's terms, and those whose postings are scored in the end."""
    _, bounds, able = candidate_ranges(index, queries, k, None, first)
    scored = able.groupBy("query").agg(F.sum("blocks").alias("unpacked"))
    return bounds.groupBy("query").agg(F.sum("blocks").alias("blocks")).join(scored, "query", "left").fillna(0, ["unpacked"])
