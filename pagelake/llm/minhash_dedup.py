"""Near-duplicates by b-bit minhash signatures and a multi-index Hamming join, confirmed on full sets.

A document's set is its distinct word shingles, its signature SYMBOLS minima of hashes of them, SYMBOL_BITS bits each.
Signatures differ in few symbols where sets are alike.

1. A signature is cut into chunks. With a limit of D differing symbols and ERRORS allowed in a chunk, at least two
   chunks of a pair hold no more than that: D // (ERRORS + 1) is two below their number. The allowed error is enumerated
   by leaving out each symbol of a chunk in turn, so each such pair shares a key. Keys that one set alone has go.
2. Sets that share a key are compared by signature. A bucket of any size is searched from set to set, and each set is
   compared only with those not yet reached; a large bucket is parted by the keys of a second chunk first, as a pair
   shares two. Sets that are linked, directly or in turn, are a group.
3. The full sets of a group meet and are confirmed exactly, again from set to set. A large group is cut into blocks, each
   alone and against the first one; after that only sets of different components that share a key meet, under that key.

Documents of equal sets are one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.components import connected_components
from pagelake.llm.ngram_join import document_sets, pack48, unpack48
from pagelake.llm.store import map_batches, partitions, stored, tuned
from pagelake.llm.textbatch import U64, mix, slices

SHINGLE_WORDS = 4
PERCENT = 80
SYMBOLS = 40
SYMBOL_BITS = 16
CHUNK = 4
CHUNKS = SYMBOLS // CHUNK
ERRORS = 1
#: Differing symbols up to which a pair surely shares keys of two chunks; one of 80 percent differs in 8 on average.
LIMIT = (CHUNKS - 1) * (ERRORS + 1) - 1
#: Differing symbols up to which sets that share a key are compared in full; one pair in 200,000 of 80 percent differs in more.
NEAR = LIMIT + 3
#: Sets of a bucket that is looked at whole; beyond it the keys of a second chunk part it.
BUCKET = 4096
#: Sets of a block of a bucket that is still larger then.
BLOCK_SETS = 50_000
#: Tokens of a block of full sets.
BLOCK_TOKENS = 1_000_000

#: Bits of the filter that keeps sets without partners in place.
FILTER_BITS = 1 << 25
#: Bytes of text whose sets are built at once.
SET_BYTES = 1 << 20

_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def signatures(document: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """(n, SYMBOLS) of sets given as (document, token), documents ascending; empty sets have zeros."""
    found = np.zeros((n, SYMBOLS), dtype="<u2")
    if len(tokens):
        first = np.flatnonzero(np.diff(document, prepend=-1))
        spread = mix(tokens)
        for i, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(spread * factor, first)
            found[document[first], i] = (mix(least) & U64((1 << SYMBOL_BITS) - 1)).astype("<u2")
    return found


def chunk_keys(found: np.ndarray) -> np.ndarray:
    """(n, CHUNKS * CHUNK) keys: each chunk with each of its symbols left out."""
    keys = np.empty((len(found), CHUNKS * CHUNK), dtype=U64)
    for chunk in range(CHUNKS):
        symbols = found[:, chunk * CHUNK : (chunk + 1) * CHUNK].astype(U64)
        for out in range(CHUNK):
            value = np.full(len(found), 1 + chunk * CHUNK + out, dtype=U64)
            for i in range(CHUNK):
                if i != out:
                    value = mix(value) + symbols[:, i]
            keys[:, chunk * CHUNK + out] = mix(value)
    return keys


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(rid, doc_id, n, da, db, sig, tokens) of each document; the digests are the same for equal sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch.column(1), SET_BYTES):
                n = len(part)
                document, tokens = document_sets(part, size)
                sizes = np.bincount(document, minlength=n)
                limits = np.concatenate([[0], np.cumsum(sizes)])
                digests = np.zeros((2, n), dtype=U64)
                if len(tokens):
                    first = np.flatnonzero(np.diff(document, prepend=-1))
                    digests[0, document[first]] = np.add.reduceat(mix(tokens), first)
                    digests[1, document[first]] = np.bitwise_xor.reduceat(mix(tokens ^ U64(0x5851F42D4C957F2D)), first)
                found, content = signatures(document, tokens, n), pack48(tokens)
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(n)), batch.column(0).slice(part.first, n), pa.array(sizes), *[pa.array(d.view(np.int64)) for d in digests],
                    pa.array([row.tobytes() for row in found], type=pa.binary()),
                    pa.array([content[6 * a : 6 * b] for a, b in zip(limits[:-1], limits[1:], strict=True)], type=pa.binary()),
                ], ["rid", "doc_id", "n", "da", "db", "sig", "tokens"])
                number += n

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), run, f"rid long, doc_id {kind}, n long, da long, db long, sig binary, tokens binary")


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, SYMBOLS)


def _keys(sets: DataFrame) -> DataFrame:
    """(key, rid) of sets (rid, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(_signature_rows(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["key", "rid"])

    return map_batches(sets.select("rid", "sig"), run, "key long, rid long")


def _shared(keys: DataFrame) -> DataFrame:
    """(key, rid, members) of keys that at least two sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key's rows follow each other; only the run at a batch's end is carried on
        last = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def runs(key: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.repeat(np.diff(np.append(begins, len(key))), np.diff(np.append(begins, len(key))))
            keep = times > 1
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, rid)], ["key", "rid"])

        for batch in batches:
            key, rid = (np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(last))
            if not len(key):
                continue
            if key[0] == key[-1]:
                # one key so far: its rows go on as soon as there are two
                if len(key) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(key[:-2]), pa.array(rid[:-2])], ["key", "rid"])
                    last = key[-2:], rid[-2:]
                else:
                    last = key, rid
                continue
            at = int(np.searchsorted(key, key[-1]))
            yield runs(key[:at], rid[:at])
            last = key[at:], rid[at:]
        if len(last[0]) > 1:
            yield runs(*last)

    spark = keys.sparkSession
    ordered = keys.repartition(partitions(spark), "key").sortWithinPartitions("key")
    return map_batches(ordered, run, "key long, rid long")


def reach(n: int, linked, labels: np.ndarray | None = None) -> np.ndarray:
    """Component (its first place) of ``n`` places; ``linked(i, others)`` tells which of ``others`` link with place i.

    Each place is compared once, with all places that no component has reached.
    Places of the same label are one from the start.
    """
    to = np.full(n, -1)
    rest = np.arange(n)
    same = {}
    if labels is not None:
        order = np.argsort(labels, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
            if len(own) > 1:
                same |= dict.fromkeys(own.tolist(), own)
    for start in range(n):
        if to[start] >= 0:
            continue
        to[start] = start
        queue = [start]
        while queue:
            i = queue.pop()
            rest = rest[to[rest] < 0]
            found = rest[linked(i, rest)] if len(rest) else rest
            if i in same:
                own = same[i]
                found = np.union1d(found, own[to[own] < 0])
            to[found] = start
            queue.extend(found.tolist())
    return to


def near(found: np.ndarray, sizes: np.ndarray, percent: int):
    """Test of signatures that are near and whose sizes allow a link."""

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
        at = np.flatnonzero(fits)
        fits[at] = (found[others[at]] != found[i]).sum(1) <= NEAR
        return fits

    return linked


def alike(found: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, limits: np.ndarray, percent: int):
    """Test of full sets, whose tokens ascend, among those that are near by signature."""
    first = near(found, sizes, percent)

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        fits = first(i, others)
        at = others[fits]
        if len(at):
            own = tokens[limits[i] : limits[i + 1]]
            lengths = limits[at + 1] - limits[at]
            before = np.cumsum(lengths) - lengths
            theirs = tokens[np.repeat(limits[at] - before, lengths) + np.arange(lengths.sum())]
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            shared = np.add.reduceat((own[place] == theirs).astype(np.int64), before)
            fits[fits] = 100 * shared >= percent * (sizes[i] + sizes[at] - shared)
        return fits

    return linked


def _met(dealt: DataFrame, percent: int, exact: bool) -> DataFrame:
    """(a, b): each set and the first one of its component, among the sets of a place.

    ``dealt`` has place (long), rid, n, sig, and for exact tests tokens and label.
    """
    columns = ["place", "rid", "n", "sig", *(("tokens", "label") if exact else ())]

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rid, first = np.unique(table.column(1).to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        sizes, found = table.column(2).to_numpy(), _signature_rows(table.column(3))
        if exact:
            contents = table.column(4).to_pylist()
            tokens = unpack48(b"".join(contents))
            limits = np.concatenate([[0], np.cumsum([len(c) // 6 for c in contents])])
            to = reach(len(rid), alike(found, sizes, tokens, limits, percent), table.column(5).to_numpy())
        else:
            to = reach(len(rid), near(found, sizes, percent))
        moved = to != np.arange(len(rid))
        return pa.RecordBatch.from_arrays([pa.array(rid[moved]), pa.array(rid[to[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(0).to_numpy()
            begins = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for low, high in zip(begins[:-1], begins[1:], strict=True):
                if held and places[low] != last:
                    yield solve(held)
                    held = []
                last = places[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield solve(held)

    rows = dealt.select(*columns).repartition(partitions(dealt.sparkSession), "place").sortWithinPartitions("place")
    return map_batches(rows, run, "a long, b long")


def _blocks(block: str, blocks: str, first_only: bool):
    """Pairs of blocks (i, j) at which a row of ``block`` is needed: all that hold it, or its own and those with block 0."""
    own = F.struct(F.col(block).alias("i"), F.col(block).alias("j"))
    others = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda o: F.struct(F.least(o, F.col(block)).alias("i"), F.greatest(o, F.col(block)).alias("j")))
    if first_only:
        first = F.struct(F.lit(0).alias("i"), F.col(block).alias("j"))
        return F.when(F.col(blocks) == 1, F.array(own)).when(F.col(block) > 0, F.array(own, first)).otherwise(others)
    return others


def _signature_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links by signature of sets that share a key, as stars inside each bucket."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    large = stored(sizes.filter(F.col("members") > BUCKET).select(F.col("key").alias("large")), "large-buckets")
    usual = members.join(large, F.col("key") == F.col("large"), "left_anti").withColumn("place", F.col("key"))
    # a large bucket is parted by the other shared keys of its sets: a pair within the limit has one of another chunk
    hot = members.join(large, F.col("key") == F.col("large")).select("rid", F.col("large"))
    parted = hot.join(members, "rid").filter("key <> large").withColumn("place", F.xxhash64(F.least("key", "large"), F.greatest("key", "large")))
    parted = parted.select("place", "rid").distinct()
    blocks = parted.groupBy("place").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = blocks.select("place", F.ceil(F.col("members") / BLOCK_SETS).cast("int").alias("blocks"))
    parted = parted.join(blocks, "place").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    parted = parted.withColumn("p", F.explode(_blocks("block", "blocks", False))).select(F.xxhash64("place", "p.i", "p.j").alias("place"), "rid")
    found = _met(usual.select("place", "rid").hint("merge").join(sets, "rid"), percent, False)
    if large.limit(1).count():
        found = found.union(_met(parted.join(sets, "rid"), percent, False))
    return found


def _only(full: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``full`` whose rid may be in ``wanted``: a bitmap of fixed size keeps most others from being moved.

    The bitmap has at most FILTER_BITS bits whatever the input. Where it fills up, it lets more rows pass; the join that
    follows is exact either way.
    """
    place = F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS))
    words = wanted.select(F.shiftright(place, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bitmap[[row["w"] for row in found]] = [row["b"] for row in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            held = bitmap[at >> 6] >> (at & 63) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(held.astype(bool)))

    return map_batches(full.select("*", place.alias("_place")), run, full.schema)


def _links(heads: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets ``heads`` (rid, n, sig) that link with another one; ``full`` also has the tokens.

    Tokens are read for the sets that meet others, not for all.
    """
    members = stored(_shared(_keys(heads)), "shared-keys")
    links = stored(_signature_links(members, heads, percent), "signature-links")
    groups = connected_components(links).withColumnRenamed("component", "grp")

    placed = stored(heads.select("rid", "n").join(groups, F.col("rid") == F.col("node")).select("rid", "n", "grp"), "group-members")
    blocks = placed.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    placed = placed.drop("n").join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    placed = stored(placed, "group-blocks")
    dealt = placed.withColumn("p", F.explode(_blocks("block", "blocks", True)))
    dealt = dealt.select(F.xxhash64("grp", "p.i", "p.j").alias("place"), "rid", F.col("rid").alias("label"))
    links = stored(_met(_only(full, placed).join(dealt.hint("merge"), "rid"), percent, True), "set-links")
    found = stored(connected_components(links), "set-components")
    cut = placed.filter("blocks > 2").select("rid", "grp")
    if not cut.limit(1).count():
        return found

    # sets of two blocks other than the first: those of different components meet under their shared keys
    cut = cut.join(found, F.col("rid") == F.col("node"), "left").select("rid", "grp", F.coalesce("component", "rid").alias("label"))
    met = members.join(cut, "rid")
    open_ = met.groupBy("key", "grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    met = stored(met.join(open_.select("key", "grp"), ["key", "grp"]), "open-members")
    sizes = met.join(heads.select("rid", "n"), "rid").groupBy("key", "grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    met = met.join(sizes, ["key", "grp"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = met.withColumn("p", F.explode(_blocks("block", "blocks", False)))
    met = stored(met.select(F.xxhash64("key", "grp", "p.i", "p.j").alias("place"), "rid", "label"), "open-places")
    return connected_components(links.union(_met(_only(full, met).join(met.hint("merge"), "rid"), percent, True)))


def minhash_dedup(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space, A to Z in lower case. A text with
    fewer than ``size`` words is a single shingle; NULL texts and texts without
    words are empty sets and link with nothing. Documents link when
    100 * intersection >= percent * union; links are confirmed on full sets, of
    48-bit hashes. Every pair whose signatures differ in at most ``LIMIT``
    symbols is tested. ``component_id`` is the smallest doc_id of the component,
    NULL only if all are NULL; ``kept`` tells whether it is the row's own. Rows
    that repeat a doc_id are documents of their own, so equal rows of the
    smallest doc_id are all kept. Texts of any length are read whole. Other
    columns are not read. An empty table gives no rows.
    """
    tuned(docs.sparkSession)
    sets = stored(_sets(docs, size), "signed-sets")
    full = sets.filter("n > 0")
    classes = full.groupBy("da", "db", "n").agg(F.min("doc_id").alias("head_id"), F.min("rid").alias("head"))
    classes = stored(classes, "set-classes")
    heads = full.select("rid", "n", "sig").join(classes.select("head"), F.col("rid") == F.col("head"), "left_semi")
    found = stored(_links(stored(heads, "class-heads"), full.select("rid", "n", "sig", "tokens"), percent), "components")

    parts = classes.join(found, F.col("head") == F.col("node"), "left").withColumn("component", F.coalesce("component", "head"))
    smallest = parts.groupBy("component").agg(F.min("head_id").alias("smallest"))
    parts = parts.join(smallest, "component").select(F.col("da").alias("a"), F.col("db").alias("b"), F.col("n").alias("m"), "smallest")
    same = (F.col("da") == F.col("a")) & (F.col("db") == F.col("b")) & (F.col("n") == F.col("m"))
    result = sets.select("doc_id", "n", "da", "db").join(parts, same, "left")
    component = F.when(F.col("m").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
