"""Writes as table-to-table operators: upserts, patches, deletes, enqueue, migration.

Spark's file tables are immutable, so every write is a function from the old
snapshot and the incoming rows to the new snapshot. ``sources.contents`` stores
either the snapshot or only the changed rows as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import content_checksum
from pagelake.schemas import DEFAULT_MAX_ATTEMPTS
from pagelake.session import cut_lineage

CLEAN = ("clean_html", "clean_text", "lang", "extracted_at", "checksum")
RAW = ("raw_html", "extracted_at", "checksum")


def packed_order(time: Column, checksum: Column) -> Column:
    """One number that orders rows by time and then by the first 60 bits of a hex checksum, so that a maximum of it is a
    hash aggregate."""
    micros = F.unix_micros(time.cast("timestamp")).cast("decimal(19,0)")
    low = F.coalesce(F.conv(F.substring(checksum, 1, 15), 16, 10).cast("decimal(19,0)"), F.lit(0))
    return (micros * F.lit(1 << 60).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a number ``_row``, which names them once they are written."""
    return rows.withColumn("_row", F.monotonically_increasing_id())


def _held(rows: DataFrame) -> DataFrame:
    """Rows written once, with a number that names them in both reads of an upsert: the choice and the fetch."""
    return rows if "_row" in rows.columns else cut_lineage(numbered(rows))


def _chosen(rows: DataFrame, key: str) -> DataFrame:
    """(_key, _best, _sum): each key's newest row and its checksum; reads narrow columns only, in hash aggregates by key."""
    order = F.coalesce(packed_order(F.col("extracted_at"), F.col("checksum")), F.lit(-1).cast("decimal(38,0)"))
    narrow = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), order.alias("_n"), "_row", F.col("checksum").alias("_sum"))
    newest = narrow.groupBy(F.col("_key").alias("_k")).agg(F.max("_n").alias("_most")).hint("shuffle_hash")
    # rows that agree in time and checksum: the first one. Only the key is a join key, so that all steps keep its partitions
    best = narrow.join(newest, (F.col("_key") == F.col("_k")) & (F.col("_n") - F.col("_most") == 0)).groupBy("_k").agg(F.min("_row").alias("_best"))
    return narrow.join(best.hint("shuffle_hash"), (F.col("_key") == F.col("_k")) & (F.col("_row") - F.col("_best") == 0)).select("_key", "_best", "_sum")


def _fetched(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The chosen rows with all columns, by a join that builds the narrow side and sorts neither."""
    same = (F.col(key) == F.col("_key")) & (F.col("_row") - F.col("_best") == 0)
    return rows.join(chosen.select("_key", "_best").hint("shuffle_hash"), same).drop("_key", "_best")


def newest_rows(rows: DataFrame, key: str) -> DataFrame:
    """The newest row per key (not NULL) by extracted_at, then checksum; wide columns are fetched for the winners alone."""
    held = _held(rows)
    return _fetched(held, _chosen(held, key), key).select(*rows.columns)


def with_checksum(incoming: DataFrame) -> DataFrame:
    """Clean rows (item_id, clean_html, clean_text, lang, extracted_at) with their checksum, one per item."""
    return newest_rows(incoming.withColumn("checksum", content_checksum("clean_html", "clean_text")), "item_id")


def detect_changed(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Incoming rows that differ from the stored checksum; a missing or NULL checksum counts as different."""
    same = current.select(F.col("item_id").alias("_key"), F.col("checksum").alias("_stored"))
    equal = (F.col("item_id") == F.col("_key")) & (F.col("checksum") == F.col("_stored"))
    return incoming.join(same.hint("shuffle_hash"), equal, "left_anti")


def _upsert(current: DataFrame, incoming: DataFrame, columns: tuple[str, ...], unless_same: bool) -> DataFrame:
    """``current`` with the newest incoming row of each item.

    Which rows are replaced, added or left is decided on ids, times and
    checksums; incoming rows without an id belong to no item and are left out. Only rows that change something are fetched with their wide
    columns, and the stored rows stream past them: neither is sorted, aggregated
    or joined in full.
    """
    held = _held(incoming)
    chosen = _chosen(held, "item_id")
    known = current.select(F.col("item_id").alias("_id"), F.col("checksum").alias("_stored"), F.lit(True).alias("_there"))
    chosen = chosen.join(known.hint("shuffle_hash"), F.col("_key") == F.col("_id"), "left")
    if unless_same:
        chosen = chosen.filter(~F.coalesce(F.col("_sum") == F.col("_stored"), F.lit(False)))
    chosen = chosen.select("_key", "_best", F.col("_there").isNotNull().alias("_there"))
    kinds = {c: current.schema[c].dataType for c in columns}

    replacing = _fetched(held, chosen.filter("_there"), "item_id")
    replacing = replacing.select(F.col("item_id").alias("_id"), F.lit(True).alias("_hit"), *[F.col(c).cast(k).alias(f"_new_{c}") for c, k in kinds.items()])
    merged = current.join(replacing.hint("shuffle_hash"), F.col("item_id") == F.col("_id"), "left")
    kept = merged.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])
    added = _fetched(held, chosen.filter("not _there"), "item_id")
    given = {"item_id": current.schema["item_id"].dataType, **kinds}
    added = added.select(*[F.col(c).cast(given[c]).alias(c) if c in given else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    return kept.unionByName(added)


def upsert_clean(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Contents after clean rows arrive.

    The same checksum keeps the stored row as it is, extracted_at included.
    Otherwise the clean columns are replaced and the raw columns stay. The
    checksum column is shared with ``upsert_raw``, where it means something
    else, so a clean row after a raw write always counts as changed.
    """
    rows = incoming.withColumn("checksum", content_checksum("clean_html", "clean_text"))
    return _upsert(current, rows, CLEAN, unless_same=True)


def upsert_raw(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Contents after fetched rows (item_id, raw_html, extracted_at, checksum) arrive; always replaces.

    Rows that are ``numbered`` and written already are not written again.
    """
    return _upsert(current, incoming.select("item_id", *RAW, *(["_row"] if "_row" in incoming.columns else [])), RAW, unless_same=False)


def touch_updated_at(df: DataFrame, touched: Column, as_of: Column) -> DataFrame:
    """Set updated_at on the touched rows."""
    return df.withColumn("updated_at", F.when(touched, as_of).otherwise(F.col("updated_at")))


def mark_fetched(items: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Items after their content (column ``item_id``) was stored: status fetched, updated_at set."""
    done = stored.select(F.col("item_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    hit = F.col("_done").isNotNull()
    marked = items.join(done, "id", "left").withColumn("status", F.when(hit, "fetched").otherwise(F.col("status")))
    return touch_updated_at(marked, hit, as_of).select(*items.columns)


def partial_patch(items: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Items after patches (id, title, status): NULL means keep; every patched row is touched."""
    new = patches.select("id", F.col("title").alias("_t"), F.col("status").alias("_s"), F.lit(True).alias("_hit"))
    patched = items.join(new, "id", "left").withColumns(
        {"title": F.coalesce("_t", "title"), "status": F.coalesce("_s", "status")}
    )
    return touch_updated_at(patched, F.col("_hit").isNotNull(), as_of).select(*items.columns)


def delete_rows(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, keys with a flag that tells whether a row existed)."""
    present = df.select(on).distinct().withColumn("_there", F.lit(True))
    report = keys.select(on).distinct().join(present, on, "left")
    report = report.select(on, F.col("_there").isNotNull().alias("deleted"))
    return df.join(keys.select(on), on, "left_anti"), report


def enqueue_rows(requests: DataFrame, as_of: Column, jobs: DataFrame | None = None, dedupe_on: list[str] | None = None) -> DataFrame:
    """New queued job rows with the column defaults.

    ``requests`` has id, kind and optional payload, run_at, max_attempts. With
    ``dedupe_on`` a request whose key is already in ``jobs``, or that is not the
    first of its batch by id, adds nothing, so that a replay is harmless.
    """
    if dedupe_on:
        first = requests.groupBy(*dedupe_on).agg(F.min("id").alias("id"))
        if jobs is not None:
            first = first.join(jobs.select(*dedupe_on), dedupe_on, "left_anti")
        requests = requests.join(first.select("id"), "id", "left_semi")

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in requests.columns else default

    null = F.lit(None)
    return requests.select(
        "id",
        "kind",
        F.lit("queued").alias("status"),
        given("run_at", as_of).alias("run_at"),
        F.lit(0).alias("attempts"),
        given("max_attempts", F.lit(DEFAULT_MAX_ATTEMPTS)).alias("max_attempts"),
        F.lit(0).alias("backoff_seconds"),
        given("payload", F.lit("{}")).alias("payload"),
        null.cast("timestamp").alias("visibility_till"),
        null.cast("string").alias("reserved_by"),
        null.cast("string").alias("last_error"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def migrate_table(
    df: DataFrame,
    rename: dict[str, str] | None = None,
    recode: dict[str, dict[str, str]] | None = None,
    add: dict[str, Column] | None = None,
    drop: list[str] | None = None,
) -> DataFrame:
    """One schema version step: rename columns, recode values, add columns with a default, drop columns."""
    out = df.withColumnsRenamed(rename or {})
    for column, codes in (recode or {}).items():
        value = F.col(column)
        for old, new in codes.items():
            value = F.when(F.col(column) == old, F.lit(new)).otherwise(value)
        out = out.withColumn(column, value)
    return out.withColumns(add or {}).drop(*(drop or []))


def jobs_forward(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Job table, first version to second: lease, payload and retry columns; done becomes succeeded."""
    return migrate_table(
        jobs,
        recode={"status": {"done": "succeeded"}},
        add={
            "payload": F.lit("{}"),
            "max_attempts": F.lit(DEFAULT_MAX_ATTEMPTS),
            "backoff_seconds": F.lit(0),
            "visibility_till": F.lit(None).cast("timestamp"),
            "reserved_by": F.lit(None).cast("string"),
            "created_at": as_of,
            "updated_at": as_of,
        },
    )


def jobs_backward(jobs: DataFrame) -> DataFrame:
    """Job table, second version back to first."""
    added = ["payload", "max_attempts", "backoff_seconds", "visibility_till", "reserved_by", "created_at", "updated_at"]
    return migrate_table(jobs, recode={"status": {"succeeded": "done"}}, drop=added)


def contents_forward(contents: DataFrame) -> DataFrame:
    """Contents, first version to second: html and text become raw_*, clean_* are added."""
    empty = F.lit(None).cast("string")
    return migrate_table(
        contents, rename={"html": "raw_html", "text": "raw_text"}, add={"clean_html": empty, "clean_text": empty}
    )


def contents_backward(contents: DataFrame) -> DataFrame:
    """Contents, second version back to first."""
    return migrate_table(
        contents.drop("clean_html", "clean_text"), rename={"raw_html": "html", "raw_text": "text"}
    )
