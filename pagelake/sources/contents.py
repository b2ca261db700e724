"""Stored contents: versions of column families in bucketed segments.

Below ``base/buckets=N`` each family has its own folder: ``head`` (time, checksum and which families a version carried),
``raw``, ``clean``, and ``bloom``, a filter of the ids by bucket. A version is written as one segment
``seg=first-last`` of each family it carries, in N bucket files at most: buckets that it does not touch get no file.

Which version of an item is current is decided on ids and version numbers alone. The wide columns of a family are then
fetched by a join whose wide side is read bucket by bucket: it is neither shuffled nor sorted, aggregated or held in
memory. Only a reader of both families joins wide rows with wide rows, again bucket by bucket.

Every ``FANOUT`` segments of a level are merged into one of the next level, so the live segments grow with the logarithm
of the versions.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.schemas import CONTENTS

FAMILIES = {"raw": ("raw_html", "raw_text"), "clean": ("clean_html", "clean_text", "lang")}
HEAD = ("extracted_at", "checksum")
#: Files of a family and version at most. On a cluster: so many that the clean columns of one bucket fit in a task.
BUCKETS = 16
#: Segments of a level that are merged into one of the next.
FANOUT = 8
BLOOM_BITS = 10
BLOOM_HASHES = 4

Segment = tuple[int, int]


def _schema(family: str) -> T.StructType:
    item, flag = CONTENTS["item_id"], T.BooleanType()
    if family == "head":
        return T.StructType([item, *[CONTENTS[c] for c in HEAD], *[T.StructField(f"has_{f}", flag) for f in FAMILIES]])
    return T.StructType([item, *[CONTENTS[c] for c in FAMILIES[family]]])


def _find(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or ()]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _buckets(spark: SparkSession, base: str) -> int | None:
    found = {int(m.group(1)) for p in _find(spark, f"{base}/buckets=*") if (m := re.search(r"buckets=(\d+)$", p))}
    if len(found) > 1:
        raise ValueError(f"{base} holds more than one number of buckets: {sorted(found)}")
    return next(iter(found), None)


def _folder(base: str, buckets: int, family: str, seg: Segment) -> str:
    return f"{base}/buckets={buckets}/{family}/seg={seg[0]:012d}-{seg[1]:012d}"


def _segments(spark: SparkSession, base: str, buckets: int) -> list[Segment]:
    """Segments that were written to their end; the head is written last."""
    marks = _find(spark, f"{base}/buckets={buckets}/head/seg=*/_SUCCESS")
    return sorted((int(a), int(b)) for a, b in (re.search(r"seg=(\d+)-(\d+)", m).groups() for m in marks))


def live_segments(segments: Iterable[Segment], before: int | None = None) -> list[Segment]:
    """The widest segments that cover the versions (below ``before``) without overlap, oldest first."""
    live: list[Segment] = []
    for first, last in sorted(segments, key=lambda s: (s[0], -s[1])):
        if (before is None or last < before) and (not live or first > live[-1][1]):
            live.append((first, last))
    return live


def run_to_merge(live: list[Segment], fanout: int = FANOUT) -> int:
    """How many of the newest live segments are to be merged: a full level, with all fuller levels that this completes."""

    def level(size: int) -> int:
        found = 0
        while size >= fanout:
            size, found = size // fanout, found + 1
        return found

    sizes = [last - first + 1 for first, last in live]
    merged = 0
    while len(sizes) >= fanout and len({level(s) for s in sizes[-fanout:]}) == 1:
        merged += fanout if not merged else fanout - 1
        sizes[-fanout:] = [sum(sizes[-fanout:])]
    return merged


def _write_segment(rows: DataFrame, base: str, buckets: int, family: str, seg: Segment) -> None:
    """Rows that are dealt by bucket already, one file for each; without a sort by bucket, as a task holds one."""
    spark, path = rows.sparkSession, _folder(base, buckets, family, seg)
    _remove(spark, path)
    name, setting = f"contents_write_{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(setting, "0")
    spark.conf.set(setting, "2")
    try:
        rows.write.format("parquet").bucketBy(buckets, "item_id").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(setting, old)
        spark.sql(f"drop table if exists {name}")  # its files stay: the table is external


def _write_bloom(ids: DataFrame, base: str, buckets: int, seg: Segment) -> None:
    """(bucket, bits) over the ids of a segment, dealt by bucket."""

    def build(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            bucket, hashed = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(bucket).tolist():
                held.setdefault(b, []).append(hashed[bucket == b])
        for b, parts in held.items():
            hashes = np.concatenate(parts)
            bits = np.zeros(-(-max(64, BLOOM_BITS * len(hashes)) // 8) * 8, dtype=bool)
            bits[_places(hashes, len(bits))] = True
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], type=pa.int32()), "bits": [np.packbits(bits).tobytes()]})

    marked = ids.select(_bucket(F.col("item_id"), buckets).alias("bucket"), F.xxhash64("item_id").alias("h"))
    marked.mapInArrow(build, "bucket int, bits binary").write.mode("overwrite").parquet(_folder(base, buckets, "bloom", seg))


def _bucket(item_id: Column, buckets: int) -> Column:
    return F.pmod(F.hash(item_id), F.lit(buckets)).cast("int")


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    low, high = hashes.view(np.uint64) & np.uint64(0xFFFFFFFF), hashes.view(np.uint64) >> np.uint64(32) | np.uint64(1)
    return (low[None, :] + np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None] * high[None, :]) % np.uint64(size)


def _rows(spark: SparkSession, base: str, buckets: int, family: str, segments: list[Segment]) -> DataFrame:
    """A family's rows in some segments with ``version``, the segment's last one, read bucket by bucket."""
    schema = _schema(family)
    key = hashlib.md5(f"{base}|{buckets}|{family}|{segments}".encode()).hexdigest()
    name = f"contents_{key}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"create table {name} ({columns}, version bigint) using parquet partitioned by (version) "
            f"clustered by (item_id) into {buckets} buckets location '{base}/buckets={buckets}/{family}'"
        )
        for seg in segments:
            spark.sql(f"alter table {name} add partition (version={seg[1]}) location '{_folder(base, buckets, family, seg)}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def write_contents(rows: DataFrame, base: str, version: int, part: str = "all", buckets: int = BUCKETS) -> None:
    """Store content rows, one for each item, as one version; rows without an item_id belong to no item and are left out.

    ``part`` tells which columns the rows carry: ``raw``, ``clean`` or ``all``;
    the other columns keep their stored values, which are not read for it. The
    first write to ``base`` fixes the number of buckets. Nothing that a reader
    may have open is touched. Writing the newest version again replaces it
    whole, and what was merged with it, so a replayed batch leaves no second copy.
    ``rows`` is evaluated once for each family that it carries, by its columns.
    """
    spark = rows.sparkSession
    buckets = _buckets(spark, base) or buckets
    seg = (version, version)
    for old in _segments(spark, base, buckets):
        if old[1] >= version:
            _remove(spark, f"{_folder(base, buckets, 'head', old)}/_SUCCESS")
            for family in ("head", "bloom", *FAMILIES):
                _remove(spark, _folder(base, buckets, family, old))
    given = rows.select(*[c if c in rows.columns else F.lit(None).cast(CONTENTS[c].dataType).alias(c) for c in CONTENTS.names])
    given = given.filter("item_id is not null").select(*[F.col(f.name).cast(f.dataType) for f in CONTENTS])
    carried = [f for f in FAMILIES if part in ("all", f)]
    dealt = {f: given.select("item_id", *FAMILIES[f]) for f in carried}
    dealt["head"] = given.select("item_id", *HEAD, *[F.lit(f in carried).alias(f"has_{f}") for f in FAMILIES])
    _write_bloom(given.select("item_id").repartition(buckets, "item_id"), base, buckets, seg)
    for family, columns in dealt.items():
        _write_segment(columns.repartition(buckets, "item_id"), base, buckets, family, seg)


def _newest(heads: DataFrame) -> DataFrame:
    """(item_id, any_v, raw_v, clean_v): the versions that hold an item's current head and families."""
    last = [F.max(F.when(F.col(f"has_{f}"), F.col("version"))).alias(f"{f}_v") for f in FAMILIES]
    return heads.groupBy("item_id").agg(F.max("version").alias("any_v"), *last)


def _fetch(rows: DataFrame, newest: DataFrame, version: str) -> DataFrame:
    """The rows of a family whose version is the item's newest; versions are compared outside the join's keys, which
    stay those of the buckets, so that the wide side is not dealt again."""
    picked = newest.filter(F.col(version).isNotNull()).select(F.col("item_id").alias("_id"), F.col(version).alias("_v"))
    same = (F.col("item_id") == F.col("_id")) & (F.col("version") - F.col("_v") == 0)
    return rows.join(picked.hint("shuffle_hash"), same).drop("_id", "_v", "version")


def read_contents(spark: SparkSession, base: str, before: int | None = None, columns: Iterable[str] = CONTENTS.names) -> DataFrame:
    """The current row per item over all versions (or those before one version), with some or all columns.

    Raw and clean columns each come from the newest version that carried them,
    time and checksum from the newest of all. A family is read only if one of
    its columns is asked for.
    """
    buckets, columns = _buckets(spark, base), [c for c in CONTENTS.names if c in set(columns) | {"item_id"}]
    live = live_segments(_segments(spark, base, buckets), before) if buckets else []
    if not live:
        return spark.createDataFrame([], T.StructType([CONTENTS[c] for c in columns]))
    heads = _rows(spark, base, buckets, "head", live)
    newest = _newest(heads)
    asked = [f for f in FAMILIES if set(FAMILIES[f]) & set(columns)]
    out = _fetch(heads, newest, "any_v").drop(*[f"has_{f}" for f in FAMILIES])
    for family in asked:
        # segments that do not carry the family have no folder of it
        carrying = {m.group(0) for p in _find(spark, f"{base}/buckets={buckets}/{family}/seg=*") if (m := re.search(r"seg=[\d-]+", p))}
        own = [s for s in live if f"seg={s[0]:012d}-{s[1]:012d}" in carrying]
        wide = _fetch(_rows(spark, base, buckets, family, own), newest, f"{family}_v").withColumnRenamed("item_id", "_item")
        same = F.col("item_id") == F.col("_item")
        # the narrow side is built; the second family's join builds that family, bucket by bucket
        out = (out.hint("shuffle_hash").join(wide, same, "left") if family == asked[0] else out.join(wide.hint("shuffle_hash"), same, "left")).drop("_item")
    return out.select(*columns)


def segments_with(spark: SparkSession, base: str, ids: DataFrame, before: int | None = None) -> list[Segment]:
    """Live segments that may hold one of the ids, by their Bloom filters; none that holds one is left out."""
    buckets = _buckets(spark, base)
    live = live_segments(_segments(spark, base, buckets), before) if buckets else []
    if not live:
        return []
    blooms = None
    for seg in live:
        own = spark.read.schema("bucket int, bits binary").parquet(_folder(base, buckets, "bloom", seg)).withColumn("version", F.lit(seg[1]).cast("long"))
        blooms = own if blooms is None else blooms.unionByName(own)
    asked = ids.select(_bucket(F.col("item_id"), buckets).alias("bucket"), F.xxhash64("item_id").alias("h"))

    def probe(hashes: pa.Table, filters: pa.Table) -> pa.Table:
        wanted = np.unique(hashes.column("h").to_numpy())
        found = []
        for bits, version in zip(filters.column("bits").to_pylist(), filters.column("version").to_pylist(), strict=True):
            held = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
            if len(wanted) and held[_places(wanted, len(held))].all(0).any():
                found.append(version)
        return pa.table({"version": pa.array(found, type=pa.int64())})

    hit = asked.groupBy("bucket").cogroup(blooms.groupBy("bucket")).applyInArrow(probe, "version long")
    versions = {row[0] for row in hit.distinct().collect()}  # at most one for each live segment
    return [s for s in live if s[1] in versions]


def read_checksums(spark: SparkSession, base: str, ids: DataFrame, before: int | None = None) -> DataFrame:
    """(item_id, checksum) of the items in ``ids``, from the heads of the segments that may hold them."""
    found = segments_with(spark, base, ids, before)
    if not found:
        return spark.createDataFrame([], T.StructType([CONTENTS["item_id"], CONTENTS["checksum"]]))
    wanted = ids.select(F.col("item_id").alias("_id")).distinct().hint("shuffle_hash")
    heads = _rows(spark, base, _buckets(spark, base), "head", found).select("item_id", "version", "checksum")
    heads = heads.join(wanted, F.col("item_id") == F.col("_id"), "left_semi")
    newest = heads.groupBy("item_id").agg(F.max("version").alias("any_v"))
    return _fetch(heads, newest, "any_v")


def merge_segments(spark: SparkSession, base: str, version: int | None = None, fanout: int = FANOUT) -> None:
    """Merge the newest segments where a level is full, after ``version`` was written (default: the newest).

    What a merge replaces stays until a later version is written, so that a
    replay of this one finds it.
    """
    buckets = _buckets(spark, base)
    segments = _segments(spark, base, buckets) if buckets else []
    live = live_segments(segments)
    if not live:
        return
    version = live[-1][1] if version is None else version
    for old in segments:
        if any(old != s and s[0] <= old[0] and old[1] <= s[1] < version for s in live):
            for family in ("head", "bloom", *FAMILIES):
                _remove(spark, _folder(base, buckets, family, old))
    run = live[len(live) - run_to_merge(live, fanout) :]
    if len(run) > 1:
        _merge(spark, base, base, buckets, run, (run[0][0], run[-1][1]))


def _merge(spark: SparkSession, base: str, into: str, buckets: int, run: list[Segment], seg: Segment) -> None:
    heads = _rows(spark, base, buckets, "head", run)
    newest = _newest(heads)
    for family in FAMILIES:
        own = [s for s in run if _find(spark, _folder(base, buckets, family, s))]
        if own:
            _write_segment(_fetch(_rows(spark, base, buckets, family, own), newest, f"{family}_v"), into, buckets, family, seg)
    _write_bloom(newest.select("item_id"), into, buckets, seg)
    carried = newest.select(F.col("item_id").alias("_item"), *[F.col(f"{f}_v").isNotNull().alias(f"any_{f}") for f in FAMILIES])
    merged = _fetch(heads, newest, "any_v").join(carried.hint("shuffle_hash"), F.col("item_id") == F.col("_item"))
    _write_segment(merged.select("item_id", *HEAD, *[F.col(f"any_{f}").alias(f"has_{f}") for f in FAMILIES]), into, buckets, "head", seg)


def compact_contents(spark: SparkSession, base: str, into: str) -> None:
    """Write the current rows as one segment of a new folder."""
    buckets = _buckets(spark, base)
    live = live_segments(_segments(spark, base, buckets))
    _merge(spark, base, into, buckets, live, (live[0][0], live[-1][1]))
