import datetime as dt
import hashlib

from pyspark.sql import functions as F

from pagelake.operators.store import (
    contents_backward, contents_forward, delete_rows, detect_changed, enqueue_rows, jobs_backward, jobs_forward,
    mark_fetched, partial_patch, touch_updated_at, upsert_clean, upsert_raw, with_checksum,
)
from pagelake.schemas import CONTENTS, ITEMS
from pagelake.sources.contents import (
    compact_contents, live_segments, merge_segments, read_checksums, read_contents, run_to_merge, segments_with, write_contents,
)

T0, T1, T2 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
NEW = "item_id string, clean_html string, clean_text string, lang string, extracted_at timestamp"


def _md5(*parts):
    return hashlib.md5("".join(parts).encode()).hexdigest()


def _incoming(spark, *rows):
    return spark.createDataFrame(list(rows), NEW)


def _now(day=3):
    return F.lit(dt.datetime(2024, 1, day))


def test_clean_upsert_inserts_updates_and_skips(spark):
    empty = spark.createDataFrame([], CONTENTS)
    first = upsert_clean(empty, _incoming(spark, ("a", "<p>x</p>", "x", "en", T0)))
    row = first.first()
    assert (row.checksum, row.extracted_at, row.raw_html) == (_md5("<p>x</p>", "x"), T0, None)

    again = upsert_clean(first, _incoming(spark, ("a", "<p>x</p>", "x", "fr", T1))).first()
    assert (again.extracted_at, again.lang) == (T0, "en")  # nothing touched, language included

    changed = upsert_clean(first, _incoming(spark, ("a", "<p>y</p>", "y", None, T1), ("b", "h", "t", "de", T1)))
    got = {r.item_id: r for r in changed.collect()}
    assert (got["a"].clean_text, got["a"].lang, got["a"].extracted_at) == ("y", None, T1)
    assert got["b"].checksum == _md5("h", "t")


def test_newest_incoming_row_wins(spark):
    out = upsert_clean(spark.createDataFrame([], CONTENTS), _incoming(spark, ("a", "2", "2", "en", T2), ("a", "1", "1", "en", T1)))
    assert out.first().clean_text == "2" and out.count() == 1


def test_raw_and_clean_share_one_checksum(spark):
    clean = upsert_clean(spark.createDataFrame([], CONTENTS), _incoming(spark, ("a", "<p>x</p>", "x", "en", T0)))
    raw = spark.createDataFrame([("a", "<html>", T1, _md5("<html>")), ("n", "<b>", T1, _md5("<b>"))], "item_id string, raw_html string, extracted_at timestamp, checksum string")
    both = upsert_raw(clean, raw)
    got = {r.item_id: r for r in both.collect()}
    assert (got["a"].raw_html, got["a"].clean_text, got["a"].lang, got["a"].checksum) == ("<html>", "x", "en", _md5("<html>"))
    assert (got["n"].clean_html, got["n"].raw_text, got["n"].lang) == (None, None, None)
    # the same clean text now counts as changed, and the raw part survives the write
    same = _incoming(spark, ("a", "<p>x</p>", "x", "en", T2))
    assert detect_changed(with_checksum(same), both).count() == 1
    after = upsert_clean(both, same).filter("item_id = 'a'").first()
    assert (after.raw_html, after.extracted_at, after.checksum) == ("<html>", T2, _md5("<p>x</p>", "x"))


def test_null_checksum_counts_as_changed(spark):
    current = spark.createDataFrame([("a", None, None, None, None, None, None, None)], CONTENTS)
    assert detect_changed(with_checksum(_incoming(spark, ("a", "h", "t", None, T0))), current).count() == 1


def test_delete(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "item_id string, v int")
    keys = spark.createDataFrame([("a",), ("z",)], "item_id string")
    kept, report = delete_rows(df, keys, "item_id")
    assert [r.item_id for r in kept.collect()] == ["b"]
    assert {r.item_id: r.deleted for r in report.collect()} == {"a": True, "z": False}
    assert {r.item_id: r.deleted for r in delete_rows(kept, keys, "item_id")[1].collect()} == {"a": False, "z": False}


def _items(spark):
    rows = [("i1", "u", "url", "old", None, "pending", T0, T0), ("i2", "u", "url", None, None, "fetched", T0, T0)]
    return spark.createDataFrame(rows, ITEMS)


def test_item_updates(spark):
    patches = spark.createDataFrame([("i1", None, "archived"), ("i2", "new", None)], "id string, title string, status string")
    got = {r.id: (r.title, r.status, r.updated_at) for r in partial_patch(_items(spark), patches, _now()).collect()}
    assert got == {"i1": ("old", "archived", T2), "i2": ("new", "fetched", T2)}
    stored = spark.createDataFrame([("i1",), ("i1",), ("zz",)], "item_id string")
    got = {r.id: (r.status, r.updated_at) for r in mark_fetched(_items(spark), stored, _now()).collect()}
    assert got == {"i1": ("fetched", T2), "i2": ("fetched", T0)}
    touched = touch_updated_at(_items(spark), F.col("id") == "i2", _now()).collect()
    assert {r.id: r.updated_at for r in touched} == {"i1": T0, "i2": T2}


def test_enqueue(spark):
    requests = spark.createDataFrame([("1", "fetch_page", None, None), ("2", "fetch_page", T0, 3)], "id string, kind string, run_at timestamp, max_attempts int")
    got = {r.id: r for r in enqueue_rows(requests, _now()).collect()}
    assert (got["1"].run_at, got["1"].max_attempts, got["1"].payload, got["1"].attempts, got["1"].status) == (T2, 25, "{}", 0, "queued")
    assert (got["2"].run_at, got["2"].max_attempts, got["2"].backoff_seconds) == (T0, 3, 0)


def test_enqueue_once(spark):
    requests = spark.createDataFrame([("1", "k", "p"), ("2", "k", "p"), ("3", "k", "q")], "id string, kind string, payload string")
    first = enqueue_rows(requests, _now(), dedupe_on=["kind", "payload"])
    assert {r.id for r in first.collect()} == {"1", "3"}
    assert enqueue_rows(requests, _now(), first, ["kind", "payload"]).count() == 0


def test_migrations_round_trip(spark):
    old = spark.createDataFrame([("1", "done", T0), ("2", "queued", T0)], "id string, status string, run_at timestamp")
    new = jobs_forward(old, _now())
    assert {r.id: (r.status, r.max_attempts, r.payload) for r in new.collect()} == {"1": ("succeeded", 25, "{}"), "2": ("queued", 25, "{}")}
    assert sorted(map(tuple, jobs_backward(new).collect())) == sorted(map(tuple, old.collect()))
    contents = spark.createDataFrame([("1", "h", "t")], "item_id string, html string, text string")
    up = contents_forward(contents)
    assert up.columns == ["item_id", "raw_html", "raw_text", "clean_html", "clean_text"]
    assert contents_backward(up).collect() == contents.collect()


def test_versions(spark, tmp_path):
    base = str(tmp_path / "contents")
    v0 = upsert_clean(spark.createDataFrame([], CONTENTS), _incoming(spark, ("a", "1", "1", "en", T0), ("b", "1", "1", "en", T0)))
    write_contents(v0, base, 0)
    changed = upsert_clean(spark.createDataFrame([], CONTENTS), _incoming(spark, ("a", "2", "2", "en", T1)))
    for _ in range(2):  # a replay replaces its own version
        write_contents(changed, base, 1)
    assert {r.item_id: r.clean_text for r in read_contents(spark, base).collect()} == {"a": "2", "b": "1"}
    assert {r.item_id: r.clean_text for r in read_contents(spark, base, before=1).collect()} == {"a": "1", "b": "1"}
    compact_contents(spark, base, str(tmp_path / "next"))
    assert read_contents(spark, str(tmp_path / "next")).count() == 2


def test_scan_table_reads_the_declared_columns(spark, tmp_path):
    from pagelake.schemas import TABLES
    from pagelake.sources.tables import scan_table

    path = str(tmp_path / "items")
    _items(spark).withColumn("extra", F.lit(1)).write.parquet(path)
    back = scan_table(spark, "items", path)
    assert back.columns == ITEMS.names and back.count() == 2
    assert set(TABLES) == {"users", "items", "contents", "tags", "item_tags", "jobs"}


def test_scan_body_files(spark, tmp_path):
    from pagelake.operators.responses import decode_responses, gate_responses
    from pagelake.sources.tables import scan_body_files

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.html").write_bytes("<p>é</p>".encode())
    (tmp_path / "b.txt").write_text("no page")
    accepted, rejected = gate_responses(scan_body_files(spark, str(tmp_path)))
    assert rejected.count() == 0
    assert [r.text for r in decode_responses(accepted)[0].collect()] == ["<p>é</p>"]


def test_store_responses(spark):
    from pagelake.plans.extract import store_responses
    from pagelake.schemas import RESPONSES

    rows = [
        ("https://a.example/1", 200, {"content-type": "text/html"}, None, bytearray(b"<p>one</p>"), T1),
        ("https://a.example/2", 404, {}, None, bytearray(b""), T1),
        ("https://a.example/3", 200, {"content-type": "text/html; charset=utf-8"}, None, bytearray(b"\xff"), T1),
        ("https://a.example/4", 200, {}, None, bytearray(b"<p>of no item</p>"), T1),
        ("https://a.example/5", 200, {}, None, bytearray(b"<p>of no item</p>"), T1),
    ]
    responses = spark.createDataFrame(rows, RESPONSES)
    ids = F.element_at(F.array(F.lit("i1"), F.lit("i2"), F.lit("i9"), F.lit("gone"), F.lit(None)), F.substring("url", -1, 1).cast("int"))
    out = store_responses(_items(spark), spark.createDataFrame([], CONTENTS), responses.withColumn("item_id", ids), _now())
    stored = out["contents"].collect()
    assert [(r.item_id, r.raw_html, r.checksum, r.clean_html) for r in stored] == [("i1", "<p>one</p>", _md5("<p>one</p>"), None)]
    assert {r.id: r.status for r in out["items"].collect()} == {"i1": "fetched", "i2": "fetched"}
    errors = {r.item_id: (r.error.code, r.error.detail) for r in out["errors"].collect()}
    assert errors == {
        "i2": ("Http", "404"), "i9": ("Charset", "Failed to decode content with encoding: UTF-8"),
        "gone": ("ItemNotFound", "Item gone not found"), None: ("ItemNotFound", "Item  not found"),
    }


def test_parts_merge_like_the_upserts(spark, tmp_path):
    """Raw and clean versions that carry only their own columns read back as the chain of upserts."""
    base = str(tmp_path / "parts")
    raw = spark.createDataFrame([("a", "<html>", T1, _md5("<html>")), ("n", "<b>", T1, _md5("<b>"))], "item_id string, raw_html string, extracted_at timestamp, checksum string")
    clean0, clean2 = _incoming(spark, ("a", "<p>x</p>", "x", "en", T0)), _incoming(spark, ("a", "<p>y</p>", "y", None, T2), ("m", "h", "t", "de", T2))
    write_contents(with_checksum(clean0), base, 0, part="clean")
    write_contents(raw, base, 1, part="raw")
    write_contents(with_checksum(clean2), base, 2, part="clean")
    want = upsert_clean(upsert_raw(upsert_clean(spark.createDataFrame([], CONTENTS), clean0), raw), clean2)
    got = read_contents(spark, base)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    sums = read_checksums(spark, base, spark.createDataFrame([("a",), ("zz",)], "item_id string"), before=2)
    assert [tuple(r) for r in sums.collect()] == [("a", _md5("<html>"))]
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "clean_html" not in plan and "raw_html" not in plan


def test_live_segments_and_levels():
    assert live_segments([(0, 0), (1, 1), (0, 1), (2, 2)]) == [(0, 1), (2, 2)]
    assert live_segments([(0, 7), (0, 0), (8, 8), (8, 9)], before=9) == [(0, 7), (8, 8)]
    # what remains after many versions, each merged as the levels fill
    live, most = [], 0
    for version in range(1000):
        live.append((version, version))
        run = run_to_merge(live, 4)
        if run:
            live[-run:] = [(live[-run][0], version)]
        assert live == live_segments(live) and live[0][0] == 0
        most = max(most, len(live))
    assert most <= 3 * 5 + 3  # three segments of each of five levels
    assert run_to_merge([(0, 3), (4, 7), (8, 11), (12, 12), (13, 13), (14, 14), (15, 15)], 4) == 7


def test_many_versions_stay_few_files(spark, tmp_path):
    """50 batches: the last one looks into few segments, and the contents are those of one upsert after the other."""
    base, want = str(tmp_path / "contents"), {}
    reads = []
    for version in range(50):
        # three items of their own, and one that every seventh batch writes again
        ids = [f"i{version * 3 + i}" for i in range(3)] + (["again"] if version % 7 == 0 else [])
        rows = [(i, f"<p>{version}</p>", f"{i} {version}", "en", T0 + dt.timedelta(days=version)) for i in ids]
        incoming = with_checksum(_incoming(spark, *rows))
        if version:
            reads.append(segments_with(spark, base, incoming.select("item_id")))
        write_contents(incoming, base, version, part="clean", buckets=2)
        merge_segments(spark, base, version, fanout=4)
        want |= {i: text for i, _, text, _, _ in rows}
    folders = sorted(p.name for p in (tmp_path / "contents" / "buckets=2" / "head").iterdir() if p.name.startswith("seg="))
    files = list((tmp_path / "contents").glob("buckets=*/*/seg=*/part-*"))
    assert len(folders) <= 14 and len(files) <= 14 * 2 * 3
    # new items are in no segment; a Bloom filter errs rarely
    assert sum(map(len, reads)) <= 40 and all(len(reads[v - 1]) >= 1 for v in (7, 14, 49))
    assert {r.item_id: r.clean_text for r in read_contents(spark, base, columns=["clean_text"]).collect()} == want


def test_rewritten_version_undoes_its_merge(spark, tmp_path):
    base = str(tmp_path / "contents")
    for version in range(4):
        write_contents(with_checksum(_incoming(spark, ("a", str(version), "x", "en", T0), (f"b{version}", "1", "x", "en", T0))), base, version, part="clean", buckets=2)
    merge_segments(spark, base, 3, fanout=4)
    again = with_checksum(_incoming(spark, ("a", "new", "x", "en", T1)))
    write_contents(again, base, 3, part="clean")
    got = {r.item_id: r.clean_html for r in read_contents(spark, base).collect()}
    assert got == {"a": "new", "b0": "1", "b1": "1", "b2": "1"}
    merge_segments(spark, base, 3, fanout=4)
    assert {r.item_id: r.clean_html for r in read_contents(spark, base).collect()} == got
    assert read_contents(spark, base, before=2).count() == 0 or read_contents(spark, base, before=2).count() == 3


def test_rows_without_an_item_are_left_out(spark, tmp_path):
    rows = _incoming(spark, (None, "1", "1", "en", T0), ("a", "1", "1", "en", None))
    assert [r.item_id for r in upsert_clean(spark.createDataFrame([], CONTENTS), rows).collect()] == ["a"]
    write_contents(with_checksum(rows), str(tmp_path / "c"), 0, part="clean")
    assert [r.item_id for r in read_contents(spark, str(tmp_path / "c")).collect()] == ["a"]
    assert read_contents(spark, str(tmp_path / "nothing")).count() == 0
