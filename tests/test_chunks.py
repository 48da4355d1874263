"""Stored chunks: real files of any length, empty ones too, and reads by byte range."""

import hashlib
import random

import pytest
from pyspark.sql import Row

from reelcat.sources import chunks as SC
from reelcat.sources import objects as SO

CHUNK = 1000
RANDOM = random.Random(5)
BODIES = {("007", "long one.mp4"): RANDOM.randbytes(250_017), ("007", "exact.mp4"): RANDOM.randbytes(3 * CHUNK), ("007", "empty.webp"): b"",
          ("7", "a+b%20.bin"): b"\x00\xff\r\n", ("7", "one.info.json"): RANDOM.randbytes(CHUNK + 1)}
KEYS = {f"videos/{pid}/{name}": body for (pid, name), body in BODIES.items()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for (pid, name), body in BODIES.items():
        (root / pid).mkdir(exist_ok=True)
        (root / pid / name).write_bytes(body)
    (root / "no-files").mkdir()
    path = SC.store_chunks(SC.file_chunks(spark, str(root), "media", CHUNK, span=20 * CHUNK + 1), str(tmp_path_factory.mktemp("store") / "s"))
    return spark.read.parquet(path)


def joined(rows) -> bytes:
    return b"".join(bytes(r.bytes) for r in sorted(rows, key=lambda r: r.offset))


def test_files_round_trip(store):
    found: dict = {}
    for r in store.collect():
        found.setdefault(r.key, []).append(r)
        assert len(r.bytes) == r.length <= CHUNK and r.offset == r.chunk * CHUNK
        assert r.size == len(KEYS[r.key])
    assert {k: joined(v) for k, v in found.items()} == KEYS
    assert len(found["videos/007/long one.mp4"]) == 251
    assert [(r.chunk, r.length) for r in found["videos/007/empty.webp"]] == [(0, 0)]


def test_every_file_is_an_object_once(store):
    got = {r.key: (r.size, r.content_type, r.metadata["file_type"]) for r in SC.objects_of(store).collect()}
    assert got["videos/007/empty.webp"] == (0, "image/webp", "thumbnail")
    assert got["videos/7/a+b%20.bin"] == (4, None, "video")
    assert SC.objects_of(store).count() == len(KEYS) == len(got)


def test_frame_and_files_give_the_same_chunks(spark, store):
    rows = [Row(processing_id=p, file_name=n, content=b or None, metadata={"processing_id": p}) for (p, n), b in BODIES.items()]
    uploads = spark.createDataFrame(rows, "processing_id string, file_name string, content binary, metadata map<string,string>")
    made = SC.frame_chunks(SO.new_objects(uploads, "media"), CHUNK)
    cols = ["key", "bucket", "size", "content_type", "chunk", "offset", "length", "bytes"]
    assert sorted(map(tuple, made.select(cols).collect()), key=str) == sorted(map(tuple, store.select(cols).collect()), key=str)


def test_ranges(spark, store):
    long, exact = "videos/007/long one.mp4", "videos/007/exact.mp4"
    asked = [(long, 0, 1), (long, 999, 2), (long, 123_456, 40_000), (long, 250_000, 2 ** 62), (long, 0, 250_017), (exact, 1000, 1000), (exact, 2999, 5),
             ("videos/7/a+b%20.bin", 1, 2)]
    none = [(long, 250_017, 1), (long, -1, 5), (long, 5, 0), (long, 5, -3), (long, None, 3), (None, 0, 3), ("videos/7/none", 0, 3), ("videos/007/empty.webp", 0, 9)]
    requests = spark.createDataFrame([*asked, *none, asked[1]], "key string, start long, n long")
    found: dict = {}
    for r in SC.read_ranges(store, requests, CHUNK).collect():
        found.setdefault((r.key, r.start, r.n), []).append(r)
    assert {k: hashlib.sha256(joined(v)).hexdigest() for k, v in found.items()} == {
        (k, s, n): hashlib.sha256(KEYS[k][s:s + n]).hexdigest() for k, s, n in asked}
    assert [r.offset for r in sorted(found[asked[1]], key=lambda r: r.offset)] == [999, 1000]


def test_empty_store_and_no_requests(spark, store, tmp_path):
    none = spark.createDataFrame([], "key string, start long, n long")
    assert SC.read_ranges(store, none, CHUNK).count() == 0
    (tmp_path / "in").mkdir()
    assert SC.file_chunks(spark, str(tmp_path / "in"), "media", CHUNK).count() == 0


def test_a_file_that_became_shorter_raises(spark, tmp_path):
    (tmp_path / "p").mkdir()
    path = tmp_path / "p" / "a.mp4"
    path.write_bytes(b"x" * 50)
    listed = SC.listed_files(spark, str(tmp_path)).collect()
    assert [(r.processing_id, r.file_name, r.size) for r in listed] == [("p", "a.mp4", 50)]
    row = spark.createDataFrame([("k", "media", 80, None, None, str(path), 0)], "key string, bucket string, size long, content_type string, metadata map<string,string>, path string, start long")
    with pytest.raises(Exception, match="fewer bytes"):
        row.mapInArrow(SC._read(str(tmp_path), CHUNK, CHUNK), SC._CHUNK_ROW).collect()


def test_a_manifest_reads_no_bytes_and_keys_reach_the_scan(store, capsys):
    SC.chunks_of(store).where("key = 'videos/7/a+b%20.bin'").explain("formatted")
    plan = capsys.readouterr().out
    assert "bytes:binary" not in plan and "EqualTo(key,videos/7/a+b%20.bin)" in plan
