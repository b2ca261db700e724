import pytest

from pyspark.sql import functions as F

from pagelake.schemas import FOREIGN_KEYS
from pagelake.operators.integrity import (
    cascade_delete, find_duplicates, find_orphans, insert_if_absent, items_by_tag, lookup_by_key, tag_items,
)


def _lake(spark):
    return {
        "users": spark.createDataFrame([("u1", "a@x.y"), ("u2", "b@x.y")], "id string, email string"),
        "items": spark.createDataFrame([("i1", "u1"), ("i2", "u2"), ("i3", "u2")], "id string, user_id string"),
        "contents": spark.createDataFrame([("i1", "c"), ("i3", "c")], "item_id string, checksum string"),
        "tags": spark.createDataFrame([("t1", "u1", "red"), ("t2", "u2", "red"), ("t3", "u2", "blue")], "id string, user_id string, name string"),
        "item_tags": spark.createDataFrame([("i1", "t1"), ("i2", "t2"), ("i2", "t3"), ("i3", "t3")], "item_id string, tag_id string"),
        "jobs": spark.createDataFrame([("j1", "i1"), ("j2", "i2"), ("j3", None)], "id string, item_id string"),
    }


def _set(df):
    return {tuple(r) for r in df.collect()}


def test_cascade(spark):
    out = cascade_delete(_lake(spark), spark.createDataFrame([("u1",), ("missing",)], "id string"))
    assert _set(out["users"]) == {("u2", "b@x.y")}
    assert _set(out["items"].select("id")) == {("i2",), ("i3",)}
    assert _set(out["contents"].select("item_id")) == {("i3",)}
    assert _set(out["tags"].select("id")) == {("t2",), ("t3",)}
    assert _set(out["item_tags"].select("item_id", "tag_id")) == {("i2", "t2"), ("i2", "t3"), ("i3", "t3")}
    assert _set(out["jobs"].select("id", "item_id")) == {("j1", None), ("j2", "i2"), ("j3", None)}


def test_orphans(spark):
    lake = _lake(spark)
    assert find_orphans(lake).count() == 0
    lake["users"] = lake["users"].filter("id = 'u1'")
    lake["items"] = lake["items"].filter("id <> 'i1'")
    assert _set(find_orphans(lake)) == {
        ("items.user_id", "u2", 2), ("contents.item_id", "i1", 1), ("tags.user_id", "u2", 2),
        ("item_tags.item_id", "i1", 1), ("jobs.item_id", "i1", 1),
    }


def test_orphans_need_their_tables(spark):
    lake = _lake(spark)
    del lake["contents"]
    with pytest.raises(ValueError, match="contents"):
        find_orphans(lake)


def test_orphans_are_found_in_one_aggregate(spark):
    """No table is sorted to meet its parents; keys that repeat or are NULL on either side count as before."""
    rule = (("notes", "part", "parts", "id", "cascade"),)
    notes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "part string")
    parts = spark.createDataFrame([("a",), ("a",), (None,), ("d",)], "id string")
    found = find_orphans({"notes": notes, "parts": parts}, rule)
    assert _set(found) == {("notes.part", "b", 2), ("notes.part", "c", 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan
    numbers = spark.createDataFrame([(1,), (2,)], "id int")
    texts = spark.createDataFrame([("1",), ("01",), ("3",)], "part string")
    assert _set(find_orphans({"notes": texts, "parts": numbers}, rule)) == {("notes.part", "3", 1)}


def test_duplicates(spark):
    df = spark.createDataFrame([("i", "c"), ("i", "c"), ("i", None), ("i", None), ("j", "c")], "item_id string, checksum string")
    assert _set(find_duplicates(df, ["item_id", "checksum"])) == {("i", "c", 2)}


def test_insert_if_absent(spark):
    base = spark.createDataFrame([("a@x.y",)], "email string")
    incoming = spark.createDataFrame([(1, "a@x.y"), (2, "b@x.y"), (3, "b@x.y"), (4, "B@x.y"), (5, None)], "seq int, email string")
    inserted, conflicts = insert_if_absent(base, incoming, "email", "seq")
    assert _set(inserted.select("seq")) == {(2,), (4,)}
    assert _set(conflicts.select("seq")) == {(1,), (3,), (5,)}


def test_tags_both_ways(spark):
    lake = _lake(spark)
    assert _set(tag_items(lake["items"], lake["item_tags"], lake["tags"])) == {("i1", "red"), ("i2", "red"), ("i2", "blue"), ("i3", "blue")}
    assert _set(items_by_tag(lake["items"], lake["item_tags"], lake["tags"], "red").select("id")) == {("i1",), ("i2",)}
    mine = items_by_tag(lake["items"], lake["item_tags"], lake["tags"], "red", F.lit("u2"))
    assert _set(mine.select("id")) == {("i2",)}


def test_lookup(spark):
    lake = _lake(spark)
    keys = spark.createDataFrame([("u2",), ("u2",), ("u9",)], "user_id string")
    assert _set(lookup_by_key(lake["items"], keys, "user_id").select("id")) == {("i2",), ("i3",)}


def test_cascade_reads_its_actions_from_the_rules(spark):
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id string")
    parts = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "x"), ("x", "d"), ("e", "d")], "id string, above string")
    notes = spark.createDataFrame([("n1", "c"), ("n2", "e"), ("n3", None)], "id string, part string")
    own = ("parts", "above", "parts", "id", "cascade")

    def run(gone, action):
        out = cascade_delete({"parts": parts, "notes": notes}, ids(*gone), "parts", (own, ("notes", "part", "parts", "id", action)))
        return {name: sorted((tuple(r) for r in df.collect()), key=str) for name, df in out.items()}

    # a table that refers to itself goes down all levels, and around a ring
    assert run(["a"], "cascade") == {"parts": [("d", "x"), ("e", "d"), ("x", "d")], "notes": [("n2", "e"), ("n3", None)]}
    assert run(["x"], "set null") == {"parts": [("a", None), ("b", "a"), ("c", "b")], "notes": [("n1", "c"), ("n2", None), ("n3", None)]}
    with pytest.raises(ValueError, match="notes.part still refers to parts.id"):
        run(["b"], "restrict")
    assert run(["missing"], "restrict")["notes"] == [("n1", "c"), ("n2", "e"), ("n3", None)]
    with pytest.raises(ValueError, match="unknown actions: ignore"):
        run(["a"], "ignore")


def test_cascade_around_two_tables(spark):
    """A seventh rule that closes a circle: an item goes with the tag that it was made from."""
    users = spark.createDataFrame([("u",), ("v",)], "id string")
    items = spark.createDataFrame([("i1", "u", None), ("i2", "v", "t1"), ("i3", "v", None)], "id string, user_id string, tag_id string")
    tags = spark.createDataFrame([("t1", "v", "i1"), ("t2", "v", "i2"), ("t3", "v", "i3")], "id string, user_id string, item_id string")
    rules = (*[r for r in FOREIGN_KEYS if r[0] in ("items", "tags")], ("items", "tag_id", "tags", "id", "cascade"), ("tags", "item_id", "items", "id", "cascade"))
    out = cascade_delete({"users": users, "items": items, "tags": tags}, spark.createDataFrame([("u",)], "id string"), fks=rules)
    assert {name: [r.id for r in df.collect()] for name, df in out.items()} == {"users": ["v"], "items": ["i3"], "tags": ["t3"]}
