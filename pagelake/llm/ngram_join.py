"""N-gram Jaccard join of documents, to the components of its links.

A document's set is its distinct word shingles. Two documents link when the
shared part of their union reaches the threshold; the join is exact.

1. Shingle hashes go to parts of their range, packed by stretch of documents
   (a shingle that repeats inside a stretch goes once), and come back if a
   second document has them. Others can be in no intersection, and a document
   that keeps too few has no partner: few documents but copies remain.
2. Documents with equal sets are one. Of the others, those that could link share
   one of the first tokens of their sets, rarest first. Documents that share
   such a token, directly or in turn, are a group.
3. Groups meet in signature trees (``signature_tree``), where the links are found.
   A large group is cut into blocks, all against the first one to begin with;
   afterwards only pairs of blocks that aren't one component already meet.

A token is 48 bits of a hash. Two different shingles of a pair of documents of
500 words are taken for one with a probability of 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagelake.llm.components import connected_components
from pagelake.llm.signature_tree import link_components
from pagelake.llm.store import map_batches, partitions, stored, tuned
from pagelake.llm.textbatch import LOWER, U64, mix, slices, span_hashes, windows

SHINGLE_WORDS = 5
PERCENT = 75
TOKEN_BITS = 48
_TOKEN = U64((1 << TOKEN_BITS) - 1)
#: Bits of a stretch's number inside its task; a document's number has 16 bits more.
UNIT_BITS = 20
#: Tokens of a block of a large group; a group up to this size is one block.
BLOCK_TOKENS = 1_000_000
#: Tokens of groups that a task looks at together.
FOREST_TOKENS = 500_000


def pack48(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(content: bytes) -> np.ndarray:
    raw = np.frombuffer(content, dtype=np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, :6] = raw
    return full.view("<u8").ravel()


def document_sets(part, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of a slice, both ascending, without repeats."""
    data = LOWER[part.data]
    starts, ends, document = part.words()
    words = span_hashes(data, starts, ends)
    found, at = windows(words, document, size)
    documents, tokens = [document[at]], [found]
    n_words = np.bincount(document, minlength=len(part))
    for short in range(1, size):  # the whole sequence is one shingle
        found, at = windows(words, document, short)
        whole = n_words[document[at]] == short
        documents.append(document[at][whole])
        tokens.append(mix(found[whole] + U64(short)))
    keys = np.concatenate(documents).astype(U64) << U64(TOKEN_BITS) | np.concatenate(tokens) & _TOKEN
    keys = np.unique(keys)
    return (keys >> U64(TOKEN_BITS)).astype(np.int64), keys & _TOKEN


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Part of the tokens' range, 0 to parts - 1."""
    return ((tokens >> U64(16)) * U64(parts) >> U64(TOKEN_BITS - 16)).astype(np.int64)


def _digests(document: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each document's set, whatever the order."""
    a, b = np.zeros(n, dtype=U64), np.zeros(n, dtype=U64)
    if len(tokens):
        first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
        a[document[first]] = np.add.reduceat(mix(tokens), first)
        b[document[first]] = np.bitwise_xor.reduceat(mix(tokens ^ U64(0xA5A5A5A5A5A5A5A5)), first)
    return a.view(np.int64), b.view(np.int64)


_PACKED = "part int, unit long, home boolean, tokens binary, docs binary, often binary, times binary"
_HOME = "doc_ids array<{kind}>, sizes array<int>, da array<long>, db array<long>, members binary"


def _packed_sets(docs: DataFrame, parts: int, size: int) -> DataFrame:
    """Tokens by part of their range, and a home row for each stretch of documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = f"{_PACKED}, {_HOME.format(kind=kind)}"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for part in slices(batch.column(1)):
                unit = TaskContext.get().partitionId() << UNIT_BITS | number
                number += 1
                n = len(part)
                document, tokens = document_sets(part, size)
                da, db = _digests(document, tokens, n)
                order = np.argsort(tokens, kind="stable")
                ranked = tokens[order]
                begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.append(begins, len(ranked)))
                # tokens of several documents of the stretch go once; their documents stay at home
                often, often_times = ranked[begins[times > 1]], times[times > 1]
                members = document[order][np.repeat(times > 1, times)]

                home = {
                    "part": (TaskContext.get().partitionId() + number) % parts, "unit": unit, "home": True, "often": often.astype("<u8").tobytes(), "times": often_times.astype("<u4").tobytes(),
                    "doc_ids": batch.column(0).slice(part.first, n).to_pylist(), "sizes": np.bincount(document, minlength=n).tolist(),
                    "da": da.tolist(), "db": db.tolist(), "members": members.astype("<u2").tobytes(),
                }
                rows = [home]
                # ascending, and so by part
                single, owner = ranked[begins[times == 1]], document[order[begins[times == 1]]]
                limits = np.searchsorted(part_of(single, parts), np.arange(parts + 1))
                often_limits = np.searchsorted(part_of(often, parts), np.arange(parts + 1))
                for p in np.flatnonzero((np.diff(limits) > 0) | (np.diff(often_limits) > 0)).tolist():
                    own, own_often = slice(limits[p], limits[p + 1]), slice(often_limits[p], often_limits[p + 1])
                    rows.append({
                        "part": p, "unit": unit, "home": False, "tokens": pack48(single[own]), "docs": owner[own].astype("<u2").tobytes(),
                        "often": pack48(often[own_often]), "times": often_times[own_often].astype("<u4").tobytes(),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return map_batches(docs.select("doc_id", "text"), run, names)


def rarity(documents: np.ndarray) -> np.ndarray:
    """One byte that grows with the number of documents of a token."""
    return np.minimum(np.floor(8 * np.log2(documents)), 255).astype(np.uint8)


def _known_twice(singles: list[bytes], often: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a part that two documents or more have, ascending, and their rarity.

    ``singles`` count one document each, ``often`` as many as ``times``. Of the part's tokens one
    array is made and sorted in place; all else is of the size of what repeats.
    """
    everything = np.empty(sum(map(len, singles)) // 6, dtype=U64)
    at = 0
    for content in singles:
        everything[at : at + len(content) // 6] = unpack48(content)
        at += len(content) // 6
    everything.sort()
    repeated = unpack48(b"".join(often))
    known = np.union1d(everything[1:][everything[1:] == everything[:-1]], repeated)
    total = np.searchsorted(everything, known, side="right") - np.searchsorted(everything, known)
    np.add.at(total, np.searchsorted(known, repeated), np.frombuffer(b"".join(times), dtype="<u4").astype(np.int64))
    return known, np.maximum(rarity(total), 1)


def _shared_tokens(packed: DataFrame, parts: int) -> DataFrame:
    """The tokens that two documents or more have, back by stretch, with their rarity; home rows pass."""
    names = packed.schema
    schema = to_arrow_schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # one part of the tokens' range
        for batch in batches:
            home = batch.filter(batch.column(2))
            if home.num_rows:
                yield home
            rest = batch.filter(pa.compute.invert(batch.column(2)))
            held += zip(*[rest.column(i).to_pylist() for i in (1, 3, 4, 5, 6)], strict=True)
        if not held:
            return
        known, rare = _known_twice([h[1] for h in held], [h[3] for h in held], [h[4] for h in held])
        for unit, own, docs, own_often, _ in held:
            own, often_rare = unpack48(own), rare[np.searchsorted(known, unpack48(own_often))]
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0  # beyond the last one
            keep = known[at] == own if len(known) else np.zeros(len(own), dtype=bool)
            own_rare = rare[at[keep]]
            if keep.any() or len(own_often):
                row = {
                    "part": 0, "unit": unit, "home": False, "tokens": pack48(own[keep]), "docs": np.frombuffer(docs, dtype="<u2")[keep].tobytes(),
                    "often": own_often, "times": np.concatenate([own_rare, often_rare]).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return map_batches(packed.repartitionById(parts, F.col("part")), run, names)


def _ordered_sets(replies: DataFrame, percent: int) -> DataFrame:
    """(rid, doc_id, n, da, db, shared, tokens) of each document; tokens, rarest first, only where they suffice for a link."""
    kind = replies.schema["doc_ids"].dataType.elementType.simpleString()
    names = f"rid long, doc_id {kind}, n long, da long, db long, shared long, tokens binary"
    schema = to_arrow_schema(replies.sparkSession.createDataFrame([], names).schema)

    def finish(home: dict, parts: list[dict]) -> pa.RecordBatch:
        n = len(home["doc_ids"])
        owners, tokens, rares = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.uint8)]
        often = np.frombuffer(home["often"], dtype="<u8")
        often_rare = np.zeros(len(often), dtype=np.uint8)
        for row in parts:
            single, own_often, rare = unpack48(row["tokens"]), unpack48(row["often"]), np.frombuffer(row["times"], dtype=np.uint8)
            owners.append(np.frombuffer(row["docs"], dtype="<u2").astype(np.int64))
            tokens.append(single)
            rares.append(rare[: len(single)])
            often_rare[np.searchsorted(often, own_often)] = rare[len(single) :]
        times = np.frombuffer(home["times"], dtype="<u4")
        owners.append(np.frombuffer(home["members"], dtype="<u2").astype(np.int64))
        tokens.append(np.repeat(often, times))
        rares.append(np.repeat(often_rare, times))
        owner, token, rare = np.concatenate(owners), np.concatenate(tokens), np.concatenate(rares)
        order = np.argsort(rare.astype(U64) << U64(TOKEN_BITS) | token, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        limits = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        token = token[order]
        sizes = np.array(home["sizes"], dtype=np.int64)
        enough = (100 * np.diff(limits) >= percent * sizes) & (sizes > 0)
        packed = pack48(token)
        contents = [packed[6 * limits[i] : 6 * limits[i + 1]] if enough[i] else None for i in range(n)]
        columns = [
            pa.array((home["unit"] << 16) + np.arange(n)), pa.array(home["doc_ids"], type=schema.field("doc_id").type), pa.array(sizes),
            pa.array(home["da"], type=pa.int64()), pa.array(home["db"], type=pa.int64()), pa.array(np.diff(limits)), pa.array(contents, type=pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["home"]:
                    if home is not None:
                        yield finish(home, parts)
                    home, parts = row, []
                else:
                    parts.append(row)
        if home is not None:
            yield finish(home, parts)

    dealt = replies.repartition(partitions(replies.sparkSession), "unit").sortWithinPartitions("unit", F.col("home").desc())
    return map_batches(dealt, run, names)


def _prefixes(sizes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's shared tokens, rarest first, must be looked at: tokens of its own come before them."""
    required = -(-(percent * sizes) // 100)
    return np.clip(sizes - required + 1 - (sizes - counts), 0, counts)


def _set_batch(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rid, n, limits and tokens from the columns ``first`` on."""
    contents = batch.column(first + 2).to_pylist()
    counts = np.array([len(c) // 6 for c in contents], dtype=np.int64)
    tokens = unpack48(b"".join(contents))
    return batch.column(first).to_numpy(), batch.column(first + 1).to_numpy(), np.concatenate([[0], np.cumsum(counts)]), tokens


def _group_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents that share a prefix token, as stars: inside a batch first, then across batches by token."""
    parts = partitions(sets.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, sizes, limits, tokens = _set_batch(batch, 0)
            counts = np.diff(limits)
            front = _prefixes(sizes, counts, percent)
            places = np.repeat(limits[:-1] - (np.cumsum(front) - front), front) + np.arange(front.sum())
            token, owner = tokens[places], np.repeat(rid, front)
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            begin = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, dtype=bool)
            star = owner[np.maximum.accumulate(np.where(begin, np.arange(len(token)), 0))] if len(token) else owner
            pairs = np.unique(np.stack([owner, star], axis=1)[owner != star], axis=0)
            once, center = token[begin], owner[begin]
            columns = [
                np.concatenate([part_of(once, parts), pairs[:, 0] % parts]), np.concatenate([once.view(np.int64), np.full(len(pairs), -1)]),
                np.concatenate([center, pairs[:, 0]]), np.concatenate([center, pairs[:, 1]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]]
        for batch in batches:
            token, a, b = (batch.column(i).to_numpy() for i in (1, 2, 3))
            link = token < 0
            if link.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[link]), pa.array(b[link])], ["a", "b"])
            held[0].append(token[~link])
            held[1].append(a[~link])
        token, owner = np.concatenate(held[0]), np.concatenate(held[1])
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        if len(token):
            begin = np.concatenate([[True], token[1:] != token[:-1]])
            star = owner[np.maximum.accumulate(np.where(begin, np.arange(len(token)), 0))]
            pairs = np.unique(np.stack([owner, star], axis=1)[owner != star], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    stars = map_batches(sets.select("rid", "n", "tokens"), local, "part int, token long, a long, b long")
    return map_batches(stars.repartitionById(parts, F.col("part")), across, "a long, b long")


def _tree_links(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document and the one that stands for its component, of all documents with the same (grp, i, j)."""
    parts = partitions(dealt.sparkSession)

    def solve(held: list[tuple]) -> pa.RecordBatch:
        rid, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        counts = np.concatenate([np.diff(h[3]) for h in held])
        groups = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        tokens = np.concatenate([h[4] for h in held])
        to = link_components(groups, sizes, np.concatenate([[0], np.cumsum(counts)]), tokens, percent)
        moved = to != np.arange(len(rid))
        return pa.RecordBatch.from_arrays([pa.array(rid[moved]), pa.array(rid[to[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0  # groups that are complete
        key, own = None, []  # the group that still grows

        def merge() -> tuple:
            limits = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o[2]) for o in own]))])
            return key, np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own]), limits, np.concatenate([o[3] for o in own])

        for batch in batches:
            if not batch.num_rows:
                continue
            rid, sizes, limits, tokens = _set_batch(batch, 3)
            names = list(zip(*[batch.column(i).to_numpy().tolist() for i in range(3)], strict=True))
            begins = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for low, high in zip(begins[:-1], begins[1:], strict=True):
                if names[low] != key:
                    if own:
                        done.append(merge())
                        size += len(done[-1][4])
                        if size >= FOREST_TOKENS:
                            yield solve(done)
                            done, size = [], 0
                    key, own = names[low], []
                own.append((rid[low:high], sizes[low:high], limits[low : high + 1] - limits[low], tokens[limits[low] : limits[high]]))
        if own:
            done.append(merge())
        if done:
            yield solve(done)

    columns = dealt.select("grp", "i", "j", "rid", "n", "tokens")
    return map_batches(columns.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rid"), run, "a long, b long")


def _links(full: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(node, component) of those of the documents ``heads`` (head) that link; ``full`` has their sets.

    Who meets whom is decided on numbers alone; the tokens move to their
    document's row once, and once to the place where the document meets others.
    """
    groups = connected_components(_group_links(full, percent)).withColumnRenamed("component", "grp")
    counts = full.select("rid", "shared").join(heads, F.col("rid") == F.col("head")).select("rid", "shared")
    members = stored(counts.join(groups, F.col("rid") == F.col("node")).select("rid", "shared", "grp"), "group-members")
    blocks = members.groupBy("grp").agg(F.ceil(F.sum("shared") / BLOCK_TOKENS).alias("blocks"), F.count(F.lit(1)).alias("members"))
    blocks = blocks.filter("members > 1").select("grp", F.least("blocks", "members").cast("int").alias("blocks"))
    members = members.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    members = stored(members.drop("shared"), "group-blocks")

    own = F.struct(F.col("block").alias("i"), F.col("block").alias("j"))
    first = F.struct(F.lit(0).alias("i"), F.col("block").alias("j"))
    others = F.transform(F.sequence(F.lit(1), F.col("blocks") - 1), lambda j: F.struct(F.lit(0).alias("i"), j.cast("int").alias("j")))
    pairs = F.when(F.col("blocks") == 1, F.array(own)).when(F.col("block") > 0, F.array(own, first)).otherwise(F.concat(F.array(own), others))
    sets = full.select("rid", "n", "tokens")
    links = stored(_tree_links(sets.join(members.select("rid", "grp", F.explode(pairs).alias("p")).select("rid", "grp", "p.i", "p.j"), "rid"), percent), "tree-links")
    found = connected_components(links)
    if not members.filter("blocks > 2").limit(1).count():
        return found
    # pairs of other blocks, where not all documents of both are in one component by now
    found = stored(found, "components")
    parted = members.filter("blocks > 2").join(found, F.col("rid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rid"))
    ranges = stored(parted.groupBy("grp", "block").agg(F.min("label").alias("low"), F.max("label").alias("high")), "block-ranges")
    other = ranges.select(F.col("grp").alias("g"), F.col("block").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    open_ = ranges.filter("block > 0").join(other, (F.col("grp") == F.col("g")) & (F.col("block") < F.col("j")))
    open_ = open_.filter("not (low = high and low2 = high2 and low = low2)").select(F.col("grp").alias("g"), F.col("block").alias("i"), "j")
    meet = open_.withColumn("side", F.explode(F.array("i", "j")))
    meet = parted.join(meet, (F.col("grp") == F.col("g")) & (F.col("block") == F.col("side"))).select("rid", "grp", "i", "j")
    return connected_components(links.union(_tree_links(sets.join(meet, "rid"), percent)))


def ngram_join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space, A to Z in lower case. A text with
    fewer than ``size`` words is a single shingle; NULL texts and texts without
    words are empty sets and link with nothing. Documents link when
    100 * intersection >= percent * union. ``component_id`` is the smallest
    doc_id of the component, NULL only if all are NULL. Rows that repeat a
    doc_id are documents of their own. Other columns are not read. An empty
    table gives no rows.

    Every text is read once. Tokens of hot shingles are counted by stretch before
    they move, equal sets are one, and no group is held whole by a task.
    """
    spark = tuned(docs.sparkSession)
    parts = partitions(spark)
    sets = stored(_ordered_sets(_shared_tokens(_packed_sets(docs, parts, size), parts), percent), "shingle-sets")

    # the smallest doc_id stands for documents of equal sets
    full = sets.filter("tokens is not null")
    classes = full.groupBy("da", "db", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("m"))
    classes = stored(classes.select("da", "db", "n", F.col("m.rid").alias("head"), F.col("m.doc_id").alias("head_id")), "set-classes")
    found = stored(_links(full, classes.select("head"), percent), "set-components")

    members = classes.join(found, F.col("head") == F.col("node"), "left").withColumn("component", F.coalesce("component", "head"))
    smallest = members.groupBy("component").agg(F.min("head_id").alias("smallest"))
    members = members.join(smallest, "component").select(F.col("da").alias("a"), F.col("db").alias("b"), F.col("n").alias("m"), "smallest")
    narrow = sets.select("doc_id", "n", "da", "db", F.col("tokens").isNotNull().alias("full"))
    same = F.col("full") & (F.col("da") == F.col("a")) & (F.col("db") == F.col("b")) & (F.col("n") == F.col("m"))
    result = narrow.join(members, same, "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))
