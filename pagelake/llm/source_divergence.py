"""Audit of how the sources of a language diverge in their words, by a sparse merge per pair of sources.

1. Every text is read once. A batch's terms are counted by (lang, source) before they move.
2. Terms in enough documents of a language are kept and numbered. A group's counts become arrays of (term id, count),
   sorted by id and cut into blocks of the language's ids.
3. Each unordered pair of a language's groups is one merge per block: a galloping intersection finds the common ids,
   which are priced by both counts; ids of one side only are priced against the other side's price of an absent term,
   and ids that neither has are a number times the gap of both absent prices.

A task holds the arrays of two tiles of groups and merges their pairs, so an array moves once for each tile and not
once for each partner, and no task holds more than two tiles' share of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.store import map_batches, stored, tuned
from pagelake.llm.textbatch import LOWER, slices, spans

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
#: Added to every count, and once for each kept term to the sum of counts.
SMOOTHING = 5
#: Kept terms of a block, so that an array has at most about as many entries.
BLOCK_TERMS = 1 << 16
#: Groups and entries of a tile of one block.
TILE_GROUPS = 64
TILE_ENTRIES = 1_000_000
#: Ids that are looked up together while the longer array is galloped through.
STRIDE = 512

IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[ord("A") : ord("Z") + 1] = IS_TERM[ord("a") : ord("z") + 1] = IS_TERM[0x80:] = True


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exact while the divisor is below 2**53.

    The quotient is found three decimal places at a time, so no product leaves 64 bits.
    """
    divisor = np.int64(total + SMOOTHING * terms)
    rest = counts.astype(np.int64) + SMOOTHING
    quotient = np.zeros(len(rest), dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // divisor
        rest %= divisor
    return quotient + 1


def price_sql(count: str, total: str, terms: str) -> str:
    """The same as ``prices`` in SQL over whole numbers."""
    divisor, rest, quotient = f"({total} + {SMOOTHING} * {terms})", f"({count} + {SMOOTHING})", "0L"
    for _ in range(3):
        quotient = f"({quotient} * 1000 + {rest} * 1000 div {divisor})"
        rest = f"({rest} * 1000 % {divisor})"
    return f"(1 + {quotient})"


def gallop(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common values of two ascending arrays without repeats.

    A stretch of the shorter array is looked for in a window of the longer one
    whose width doubles until it passes the stretch; the next stretch begins
    where the last one was found.
    """
    if len(few) > len(many):
        right, left = gallop(many, few)
        return left, right
    ours, theirs, at = [], [], 0
    for begin in range(0, len(few), STRIDE):
        wanted, step = few[begin : begin + STRIDE], STRIDE
        while at + step < len(many) and many[at + step] < wanted[-1]:
            step *= 2
        window = many[at : at + step + 1]
        found = np.searchsorted(window, wanted)
        inside = np.flatnonzero(found < len(window))
        same = inside[window[found[inside]] == wanted[inside]]
        ours.append(begin + same)
        theirs.append(at + found[same])
        at += int(found[-1])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *ours]), np.concatenate([none, *theirs])


def merge_pair(a: tuple, b: tuple) -> tuple[int, int]:
    """(value, union) of two groups' (ids, prices, price of an absent term): the sum of price gaps over terms that one has."""
    ours, theirs = gallop(a[0], b[0])
    both = int(np.abs(a[1][ours] - b[1][theirs]).sum())
    gap_a, gap_b = np.abs(a[1] - b[2]), np.abs(b[1] - a[2])
    one_sided = int(gap_a.sum()) - int(gap_a[ours].sum()) + int(gap_b.sum()) - int(gap_b[theirs].sum())
    return both + one_sided, len(a[0]) + len(b[0]) - len(ours)


def _batch_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) by slice of documents; each group of a batch also has a row with the term ''."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = pa.table([batch.column(1).fill_null(""), batch.column(2).fill_null(""), np.arange(batch.num_rows)], ["lang", "source", "row"])
            groups = named.group_by(["lang", "source"]).aggregate([("row", "list")]).combine_chunks()
            langs, sources = groups.column("lang").combine_chunks(), groups.column("source").combine_chunks()
            lists = groups.column("row_list").combine_chunks()
            group = np.empty(batch.num_rows, dtype=np.int64)
            group[lists.flatten().to_numpy()] = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            zeros = np.zeros(len(lists), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([langs, sources, pa.array([""] * len(lists)), pa.array(zeros), pa.array(zeros)], schema=schema)
            for part in slices(batch.column(0)):
                inside = IS_TERM[part.data]
                starts, ends = spans(inside, part.offsets)
                if not len(starts):
                    continue
                offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[part.data[inside]])])
                coded = words.dictionary_encode()
                document = np.searchsorted(part.offsets, starts, side="right") - 1
                # once per (document, term), then once per (group, term)
                pairs, times = np.unique(document << 32 | coded.indices.to_numpy().astype(np.int64), return_counts=True)
                keys = group[part.first + (pairs >> 32)] << 32 | pairs & 0xFFFFFFFF
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                owner, term = keys[begins] >> 32, keys[begins] & 0xFFFFFFFF
                columns = [
                    langs.take(pa.array(owner)), sources.take(pa.array(owner)), coded.dictionary.take(pa.array(term)),
                    pa.array(np.add.reduceat(times[order], begins)), pa.array(np.diff(np.append(begins, len(keys)))),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_batches(docs.select(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")), run, "lang string, source string, term string, n long, docs long")


def _merged_tiles(key: tuple, table: pa.Table) -> pa.Table:
    """(lang, a, b, value, shared, terms, gap) of the pairs of one block and two tiles, a before b."""
    low, high = key[2].as_py(), key[3].as_py()
    names, tiles = table.column("source").to_pylist(), table.column("tile").to_pylist()
    totals, terms = table.column("total").to_pylist(), table.column("terms").to_pylist()
    ids, counts = table.column("ids").combine_chunks(), table.column("counts").combine_chunks()
    vectors = []
    for i in range(len(names)):
        own = ids[i].values, counts[i].values
        own = [np.zeros(0, dtype=np.int64) if v is None else v.to_numpy(zero_copy_only=False) for v in own]
        absent = int(prices(np.zeros(1, dtype=np.int64), totals[i], terms[i])[0]) if terms[i] else 0
        vectors.append((own[0], prices(own[1], totals[i], terms[i]) if terms[i] else own[1], absent))
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = []
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if low == high or tiles[i] != tiles[j]:
                value, union = merge_pair(vectors[i], vectors[j])
                rows.append((names[i], names[j], value, union, terms[i], abs(vectors[i][2] - vectors[j][2])))
    a, b, value, union, size, gap = zip(*rows, strict=True) if rows else ((),) * 6
    longs = [pa.array(c, type=pa.int64()) for c in (value, union, size, gap)]
    lang = pa.array([key[0].as_py()] * len(rows), type=pa.string())
    return pa.Table.from_arrays([lang, pa.array(a, type=pa.string()), pa.array(b, type=pa.string()), *longs], ["lang", "a", "b", "value", "shared", "terms", "gap"])


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs`` (text, lang, source).

    Terms are runs of letters A to Z, in lower case, and of characters beyond
    ASCII. A language keeps the terms in at least ``min_docs`` of its documents.
    A count's price is 1 + floor(10**9 * (count + 5) / (sum of counts + 5 * number of
    kept terms)). Rows of part ``pair`` give for each other source of the
    language the sum of absolute price gaps over all kept terms; rows of part
    ``term`` the ``top`` terms whose price is above the language's. Ranks go by
    falling value, then by item.

    NULL text, lang and source count as ''. Empty texts make their group occur
    and hold no terms; a language without kept terms has pair values of 0.
    Rows that repeat are documents of their own. Texts of any length are read
    whole. Other columns are not read. An empty table gives no rows.
    """
    spark = tuned(docs.sparkSession)
    own = ["lang", "source"]
    counts = _batch_counts(docs).groupBy(*own, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "term-counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"))
    kept = kept.filter(F.col("docs") >= min_docs).select("lang", "term", "whole", F.monotonically_increasing_id().alias("id"))
    kept = stored(kept, "kept-terms")
    entries = stored(counts.filter("term <> ''").drop("docs").join(kept, ["lang", "term"]), "term-entries")

    # sizes: one row per group, with those of its language
    groups = counts.filter("term = ''").select(*own)
    sizes = groups.join(entries.groupBy(*own).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries")), own, "left").fillna(0, ["total", "entries"])
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("lang_total"))
    langs = sizes.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum("entries").alias("held")).join(whole, "lang", "left").fillna(0, ["terms", "lang_total"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("groups") / tile_groups), F.ceil(F.col("held") / F.col("blocks") / TILE_ENTRIES))
    langs = langs.withColumn("blocks", blocks.cast("int")).withColumn("tiles", tiles.cast("int"))
    sizes = stored(sizes.drop("entries").join(langs.drop("groups", "held"), "lang"), "group-sizes")

    above = entries.join(sizes.select(*own, "total", "terms", "lang_total"), own)
    above = above.withColumns({"p": F.expr(price_sql("n", "total", "terms")), "q": F.expr(price_sql("whole", "lang_total", "terms"))})
    above = above.filter("p > q").select(*own, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy(*own).orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    cut = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    arrays = entries.select(*own, "id", "n").join(sizes.select(*own, "blocks"), own).groupBy(*own, cut)
    arrays = arrays.agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("v"))  # at most one block's terms
    arrays = arrays.select(*own, "block", F.col("v.id").alias("ids"), F.col("v.n").alias("counts"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    places = sizes.select(*own, "total", "terms", "tiles", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = places.join(arrays, [*own, "block"], "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "lang", "source", "total", "terms", "tile", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("ids", "counts")],
    )
    merged = dealt.groupBy("lang", "block", "low", "high").applyInArrow(
        _merged_tiles, "lang string, a string, b string, value long, shared long, terms long, gap long"
    )
    pairs = merged.groupBy("lang", "a", "b").agg(
        (F.sum("value") + (F.max("terms") - F.sum("shared")) * F.max("gap")).alias("value")  # terms that neither has
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
