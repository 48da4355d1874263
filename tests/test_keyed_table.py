"""Versioned tables by ranges of the key, and the stored manifest over them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reelcat.sources import objects as SO
from reelcat.sources.keyed_table import ConcurrentChange, KeyedTable, place_among
from reelcat.streaming.jobs import scratch


@pytest.fixture(autouse=True)
def small_parts(spark):
    """A range for each shuffle partition; otherwise adaptive execution joins small ones into parts of its advisory size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


COLS = "key string, size long, last_modified long, file_type string"


def manifest(spark, ids, files=3):
    rows = [(f"videos/{i}/{f}.mp4", 10, 1, "video") for i in ids for f in range(files)] + [("stray", 1, 1, None)]
    table = SO.stored_manifest(spark, scratch(spark, "manifest-test"))
    table.create(spark.createDataFrame(rows, COLS).repartition(5))
    return table, rows


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def files_of(table, parts):
    """Name, size and time of every file of some parts."""
    out = {}
    for p in parts:
        folder = f"{table.path}/{p.folder}".removeprefix("file:")
        for f in os.listdir(folder):
            st = os.stat(f"{folder}/{f}")
            out[p.folder, f] = st.st_size, st.st_mtime_ns
    return out


def test_place_among(spark):
    lows = ["", "b", "bb", "k\\'x", "ä"]
    df = spark.createDataFrame([("",), ("a",), ("b",), ("bz",), ("k\\'x",), ("z",), ("ä",), ("öl",)], "k string")
    for n in range(6):
        got = {r.k: r.p for r in df.select("k", place_among(F.col("k"), lows[:n]).alias("p")).collect()}
        assert got == {k: sum(x <= k for x in lows[:n]) for k in got}


def test_upsert_writes_touched_ranges_only(spark):
    table, rows = manifest(spark, range(1000, 4000))
    before = table.version()
    assert len(before.parts) >= 4 and before.rows == len(rows)
    old, there = content(table), files_of(table, before.parts)
    incoming = [("videos/1005/1.mp4", 99, 5, "video"), ("videos/1005/1.mp4", 98, 4, "video"), ("videos/1005/9.mp4", 7, 0, "video"), ("aaa", 1, 1, None), (None, 1, 1, "video")]
    number = SO.stored_upsert(table, spark.createDataFrame(incoming, COLS))
    after = table.version()
    assert number == after.number == before.number + 1
    want = {r[0]: r for r in rows} | {"videos/1005/1.mp4": incoming[0], "videos/1005/9.mp4": incoming[2], "aaa": incoming[3]}
    assert content(table) == sorted(want.values(), key=str)
    kept = set(before.parts) & set(after.parts)
    assert len(before.parts) - 3 <= len(kept) < len(before.parts)
    assert content(table, table.version(before.number)) == old  # the version before is as it was
    assert files_of(table, before.parts) == there
    assert SO.stored_upsert(table, spark.createDataFrame([], COLS)) == number


def test_ranges_hold_after_many_changes(spark):
    rng = random.Random(6)
    table, rows = manifest(spark, range(100, 400), 1)
    want = {r[0]: r for r in rows}
    for k in range(6):
        incoming = [(f"videos/{rng.randrange(50, 500)}/{rng.randrange(2)}.mp4", k, 10 + k, "video") for _ in range(15)]
        incoming = list({r[0]: r for r in incoming}.values())
        SO.stored_upsert(table, spark.createDataFrame(incoming, COLS))
        want |= {r[0]: r for r in incoming}
        ids = [str(rng.randrange(50, 500)) for _ in range(10)]
        report = {r.processing_id: (r.n_deleted, r.found) for r in SO.stored_delete(table, spark.createDataFrame([(i,) for i in [*ids, *ids[:2]]], "processing_id string")).collect()}
        for i in set(ids):
            gone = [key for key in want if key.startswith(f"videos/{i}/")]
            assert report[i] == (len(gone), bool(gone))
            for key in gone:
                del want[key]
        assert len(report) == len(set(ids))
        parts = sorted(table.version().parts, key=lambda p: p.low)
        assert all(a.high < b.low for a, b in zip(parts, parts[1:]))
    assert content(table) == sorted(want.values(), key=str)


def test_delete_does_not_take_ids_that_begin_alike(spark):
    table, rows = manifest(spark, [1, 10, 11, 2, "1.5", "1-x"])
    report = SO.stored_delete(table, spark.createDataFrame([("1",), ("9",), (None,), ("%",)], "processing_id string"))
    assert sorted(map(tuple, report.collect())) == [("%", 0, False), ("1", 3, True), ("9", 0, False)]
    assert content(table) == sorted([r for r in rows if not r[0].startswith("videos/1/")], key=str)
    SO.stored_delete(table, spark.createDataFrame([(str(i),) for i in (10, 11, 2, "1.5", "1-x")], "processing_id string"))
    assert [r[0] for r in content(table)] == ["stray"]


def test_of_two_writers_one_fails(spark):
    table, _ = manifest(spark, range(20))
    v = table.version()
    rows = table.read(v)
    table.replace(list(v.parts), rows.where("size > 5"), v)
    with pytest.raises(ConcurrentChange):
        table.replace(list(v.parts), rows, v)
    assert "stray" not in [r[0] for r in content(table)]


def test_vacuum_keeps_what_newest_versions_list(spark):
    table, _ = manifest(spark, range(300))
    for k in range(4):
        SO.stored_upsert(table, spark.createDataFrame([(f"videos/{k}/0.mp4", k, 9, "video")], COLS))
    now, before = content(table), content(table, table.version(3))
    assert table.vacuum(keep=2) > 0 and table.numbers() == [3, 4]
    assert content(table) == now and content(table, table.version(3)) == before
    assert table.vacuum(keep=2) == 0


def test_empty_and_missing_tables(spark):
    table = KeyedTable(spark, scratch(spark, "nothing"), "key")
    assert table.version() is None and table.numbers() == [] and not table.applied(0)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(spark.createDataFrame([], COLS))
    assert table.read().collect() == [] and table.read().columns == ["key", "size", "last_modified", "file_type"]
    SO.stored_upsert(table, spark.createDataFrame([("k", 1, 1, "video"), ("j", 1, 1, None)], COLS))
    assert [r[0] for r in content(table)] == ["j", "k"]


def test_compaction_folds_small_runs(spark):
    table = KeyedTable(spark, scratch(spark, "runs"), F.col("k"))
    for e in range(12):
        table.append(spark.createDataFrame([(i, e) for i in range(1000 if e == 0 else 10)], "k int, e int"), e)
        table.compact(lambda d: d.groupBy("k").agg(F.max("e").alias("e")))
    v = table.version()
    assert v.epoch == 11 and len({p.run for p in v.parts}) <= 5
    assert {r.k: r.e for r in table.read().groupBy("k").agg(F.max("e").alias("e")).collect()} == {**{i: 0 for i in range(1000)}, **{i: 11 for i in range(10)}}


def test_upsert_keeps_one_row_of_a_key_that_was_stored_twice(spark):
    rows = [("a", 1, 1, "video"), ("a", 2, 1, "video"), ("a", 5, 0, "video"), ("b", 1, 1, "video"), ("b", 1, 1, "video"), (None, 1, 1, "video"), (None, 1, 1, "video"), ("", 3, 3, None), ("", 4, 2, None)]
    want = [("", 3, 3, None), ("a", 2, 1, "video"), (None, 1, 1, "video"), (None, 1, 1, "video")]
    incoming = [("b", 7, 0, "video"), ("b", 6, 0, "video"), (None, 9, 9, "video")]
    for create in (lambda table, listing: table.create(listing), SO.create_manifest):
        table = SO.stored_manifest(spark, scratch(spark, "manifest-test"))
        create(table, spark.createDataFrame(rows, COLS).repartition(4))
        SO.stored_upsert(table, spark.createDataFrame(incoming, COLS))
        if create is SO.create_manifest:
            assert content(table) == sorted([*want, ("b", 7, 0, "video")], key=str)
        # otherwise only ranges that hold an incoming key are settled
        assert [r for r in content(table) if r[0] == "b"] == [("b", 7, 0, "video")]
    assert SO.create_manifest(SO.stored_manifest(spark, scratch(spark, "manifest-test")), spark.createDataFrame([], COLS)) == 0


def test_parts_hold_the_rows_alone_in_order_of_the_key(spark):
    table, rows = manifest(spark, range(1000, 3000))
    SO.stored_upsert(table, spark.createDataFrame([(f"videos/{i}/1.mp4", 3, 3, "video") for i in range(900, 3000, 7)], COLS))
    SO.stored_delete(table, spark.createDataFrame([(str(i),) for i in range(1000, 3000, 50)], "processing_id string"))
    for number in table.numbers():
        for part in table.version(number).parts:
            found = spark.read.parquet(f"{table.path}/{part.folder}")
            assert found.columns == ["key", "size", "last_modified", "file_type"]  # no copy of the key
            keys = [r.key for r in found.coalesce(1).collect()]
            assert keys == sorted(keys) and (keys[0], keys[-1], len(keys)) == (part.low, part.high, part.rows)
