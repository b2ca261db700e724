"""Relational rules over the lake tables: keys, references, cascades, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.schemas import FOREIGN_KEYS
from pagelake.session import cut_lineage


def lookup_by_key(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``keys``. Spark broadcasts the key side only when its measured size allows it."""
    return df.join(keys, on, "left_semi")


def find_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count; keys with a NULL part never collide."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return df.filter(present).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def find_orphans(tables: dict[str, DataFrame], fks: tuple = FOREIGN_KEYS) -> DataFrame:
    """(rule, key) for every reference of ``fks`` whose parent row is missing; a table that a rule names must be given.

    A rule's references and parent keys meet in one aggregate, which holds a
    value's two numbers and sorts nothing; references are summed before the
    shuffle, so a value that a third of all rows share is one row of each task.
    Columns of different types are compared as a join compares them.
    """
    found = []
    if absent := {name for child, _, parent, _, _ in fks for name in (child, parent)} - set(tables):
        raise ValueError(f"tables without which rules cannot be checked: {', '.join(sorted(absent))}")
    for child, column, parent, parent_key, _ in fks:
        refs = tables[child].filter(F.col(column).isNotNull()).select(F.col(column).alias("key"))
        parents = tables[parent].select(F.col(parent_key).alias("key"))
        if refs.schema["key"].dataType == parents.schema["key"].dataType:
            both = refs.withColumn("one", F.lit(1)).unionByName(parents.withColumn("one", F.lit(0)))
            lost = both.groupBy("key").agg(F.sum("one").alias("n"), F.min("one").alias("least")).filter("least = 1")
        else:
            lost = refs.groupBy("key").agg(F.count("*").alias("n")).join(parents, "key", "left_anti")
        found.append(lost.select(F.lit(f"{child}.{column}").alias("rule"), F.col("key").cast("string").alias("key"), "n"))
    return reduce(DataFrame.unionByName, found)


def cascade_delete(
    tables: dict[str, DataFrame], deleted: DataFrame, root: str = "users", fks: tuple[tuple, ...] = FOREIGN_KEYS
) -> dict[str, DataFrame]:
    """Tables after the rows of ``root`` with these ids (column ``id``) are deleted, by the actions of the rules.

    ``cascade`` deletes the rows that refer to a deleted one, ``set null`` keeps
    them without the reference, ``restrict`` refuses the whole deletion with an
    error while a row that stays refers to a deleted one. Tables are worked on
    with parents before children, so each is read once; tables that refer to
    each other, or to themselves, in rounds until nothing more goes. Rules of
    tables that aren't given are skipped.
    """
    known = {"cascade", "set null", "restrict"}
    rules = [r for r in fks if r[0] in tables and r[2] in tables]
    if odd := {r[4] for r in rules} - known:
        raise ValueError(f"unknown actions: {', '.join(sorted(odd))}")
    cascades = [r for r in rules if r[4] == "cascade"]
    #: deleted values of the parent columns that rules refer to
    gone: dict[tuple[str, str], DataFrame] = {}

    def causes(table: str) -> list[tuple[str, DataFrame]]:
        """(column, deleted values): a row of the table goes if its column has one of the values."""
        own = [("id", deleted.select("id").distinct())] if table == root else []
        return own + [(c, gone[p, k]) for child, c, p, k, _ in cascades if child == table and (p, k) in gone]

    def keys(table: str) -> dict[tuple[str, str], DataFrame]:
        """Deleted values of each column of the table that a rule refers to."""
        found = {}
        for column in {r[3] for r in rules if r[2] == table}:
            lost = [tables[table].join(values.toDF("_value"), F.col(c) == F.col("_value"), "left_semi").select(column) for c, values in causes(table)]
            if lost:
                found[table, column] = reduce(DataFrame.union, lost).distinct()
        return found

    for group in _parents_first(list(tables), [(child, p) for child, _, p, _, _ in cascades]):
        inside = [r for r in cascades if r[0] in group and r[2] in group]
        if not inside:
            gone |= keys(group[0])
            continue
        size = -1
        while True:
            found = {name: cut_lineage(df) for table in group for name, df in keys(table).items()}
            now = sum(df.count() for df in found.values())
            if now == size:
                break
            size, gone = now, gone | found

    out = {}
    for table, rows in tables.items():
        for column, values in causes(table):
            rows = rows.join(values.toDF("_value"), F.col(column) == F.col("_value"), "left_anti")
        for child, column, parent, key, action in rules:
            if child != table or action == "cascade" or (parent, key) not in gone:
                continue
            values = gone[parent, key].toDF("_value")
            if action == "restrict":
                held = rows.join(values, F.col(column) == F.col("_value"), "left_semi").select(column).limit(1).collect()
                if held:
                    raise ValueError(f"{child}.{column} still refers to {parent}.{key} {held[0][0]}")
                continue
            joined = rows.join(values, F.col(column) == F.col("_value"), "left")
            rows = joined.select(*[F.when(F.col("_value").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])
        out[table] = rows
    return out


def _parents_first(names: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Groups of tables that refer to each other, parents before children; ``edges`` are (child, parent)."""
    above = {n: {n} for n in names}
    for _ in names:
        above = {n: set().union(above[n], *(above[p] for child, p in edges if child == n)) for n in names}
    groups = {tuple(sorted(m for m in names if m in above[n] and n in above[m])) for n in names}
    return [list(g) for g in sorted(groups, key=lambda g: (len(above[g[0]]), g))]


def insert_if_absent(
    base: DataFrame, incoming: DataFrame, key: str, order: str
) -> tuple[DataFrame, DataFrame]:
    """(inserted, conflicts) for rows that need a unique ``key``.

    A row conflicts when its key is in ``base`` or belongs to an earlier row of
    the batch (by the unique ``order`` column).
    """
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    winners = first.join(base.select(key), key, "left_anti").select(order)
    return incoming.join(winners, order, "left_semi"), incoming.join(winners, order, "left_anti")


def tag_items(items: DataFrame, item_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(item_id, tag) for every tag of every item."""
    named = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    mine = items.select(F.col("id").alias("item_id"))
    return item_tags.join(named, "tag_id").join(mine, "item_id", "left_semi").select("item_id", "tag")


def items_by_tag(items: DataFrame, item_tags: DataFrame, tags: DataFrame, name: str, user_id: Column | None = None) -> DataFrame:
    """Items that carry a tag; the tag filter runs before the joins."""
    wanted = tags.filter(F.col("name") == name)
    if user_id is not None:
        wanted = wanted.filter(F.col("user_id") == user_id)
    ids = item_tags.join(wanted.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return items.join(ids.select(F.col("item_id").alias("id")), "id", "left_semi")
