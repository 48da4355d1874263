"""The reference's storage workflow replayed with DataFrames:
upload three objects, list by prefix (3), read them back, delete the video, list (0)."""

import datetime as dt

from pyspark.sql import Row

from reelcat.operators import catalog as C

PID = "test-workflow-123"


def test_upload_list_delete(spark):
    t = dt.datetime(2025, 7, 26, 12, 0, 0)
    uploads = spark.createDataFrame([
        Row(key=f"videos/{PID}/video.mp4", size=39, last_modified=t, file_type="video"),
        Row(key=f"videos/{PID}/info.json", size=39, last_modified=t, file_type="metadata"),
        Row(key=f"videos/{PID}/thumbnail.jpg", size=39, last_modified=t, file_type="thumbnail")])
    empty = uploads.limit(0)
    stored = C.upsert_objects(empty, uploads)
    assert stored.count() == 3
    listed = C.list_objects(stored, prefix=f"videos/{PID}/")
    assert sorted(r.content_type for r in listed.collect()) == ["application/json", "image/jpeg", "video/mp4"]
    details = C.video_details(stored, "https://store.example.com", "b").collect()
    assert len(details) == 1
    assert details[0].video_url == f"https://store.example.com/storage/v1/object/public/b/videos/{PID}/video.mp4"
    ids = spark.createDataFrame([Row(processing_id=PID), Row(processing_id="missing")])
    report, remaining, deleted = C.delete_videos(stored, ids)
    got = {r.processing_id: (r.n_deleted, r.found) for r in report.collect()}
    assert got == {PID: (3, True), "missing": (0, False)}
    assert deleted.count() == 3
    assert C.list_objects(remaining, prefix=f"videos/{PID}/").count() == 0


def test_real_files_are_stored_as_they_are(spark, tmp_path):
    from reelcat.sources import objects as SO
    bodies = {"007": {"clip one.mp4": b"\x00\xff\r\n", "clip.info.json": b"{}", "clip.webp": b"RIFF"},
              "7": {"a+b%20.bin": b"no newline"}}
    for pid, named in bodies.items():
        (tmp_path / "in" / pid).mkdir(parents=True)
        for name, body in named.items():
            (tmp_path / "in" / pid / name).write_bytes(body)
    path = SO.store_objects(SO.new_objects(SO.object_files(spark, str(tmp_path / "in")), "media"), str(tmp_path / "store"))
    store = spark.read.parquet(path)
    got = {(r.processing_id, r.key.split("/")[-1]): (r.size, r.content_type, r.file_type, r.bucket) for r in SO.manifest_of(store).collect()}
    assert got == {("007", "clip one.mp4"): (4, "video/mp4", "video", "media"),
                   ("007", "clip.info.json"): (2, "application/json", "metadata", "media"),
                   ("007", "clip.webp"): (4, "image/webp", "thumbnail", "media"),
                   ("7", "a+b%20.bin"): (10, None, "video", "media")}
    keys = spark.createDataFrame([Row(key="videos/007/clip one.mp4"), Row(key="videos/7/none"), Row(key="videos/7/a+b%20.bin")])
    assert {r.key: bytes(r.content) for r in SO.read_objects(store, keys).collect()} == {
        "videos/007/clip one.mp4": b"\x00\xff\r\n", "videos/7/a+b%20.bin": b"no newline"}


def test_any_file_type_is_listed(spark):
    t = dt.datetime(2025, 1, 1)
    files = spark.createDataFrame([Row(key="videos/p/a.mp4", size=1, last_modified=t, file_type="video"),
                                   Row(key="videos/p/a.srt", size=2, last_modified=t, file_type="subtitle"),
                                   Row(key="videos/p/b.srt", size=3, last_modified=t, file_type="subtitle")])
    row = C.video_catalog(files).first()
    assert (row.n_files, row.video_key) == (3, "videos/p/a.mp4")
    assert row.files == ('[{"file_type":"subtitle","key":"videos/p/b.srt","size":3,"content_type":null},'
                         '{"file_type":"video","key":"videos/p/a.mp4","size":1,"content_type":"video/mp4"}]')


def test_upsert_overwrites_by_key(spark):
    t1, t2 = dt.datetime(2025, 1, 1), dt.datetime(2024, 1, 1)
    cur = spark.createDataFrame([Row(key="videos/p/a.mp4", size=1, last_modified=t1, file_type="video")])
    new = spark.createDataFrame([Row(key="videos/p/a.mp4", size=2, last_modified=t2, file_type="video"),
                                 Row(key="videos/p/b.jpg", size=3, last_modified=t2, file_type="thumbnail")])
    out = {r.key: (r.size, r.from_incoming, r.n_versions) for r in C.upsert_objects(cur, new).collect()}
    # the incoming write wins even with an older timestamp (overwrite semantics)
    assert out == {"videos/p/a.mp4": (2, True, 2), "videos/p/b.jpg": (3, True, 1)}


def test_listing_records_with_metadata_map(spark):
    from reelcat import schemas as S
    t = dt.datetime(2025, 7, 26, 12, 0, 0)
    rows = [(f"videos/{PID}/video.mp4", 39, t, "video/mp4", {"processing_id": PID, "file_type": "video"}),
            (f"videos/{PID}/info.json", 39, t, None, {"processing_id": PID, "file_type": "metadata"}),
            (f"videos/{PID}/thumb.jpg", 39, t, "image/jpeg", {})]
    records = spark.createDataFrame(rows, S.OBJECT_LISTING)
    cat = C.video_catalog(C.listing_from_records(records)).first()
    assert cat.n_files == 3
    assert (cat.video_key, cat.metadata_content_type) == (f"videos/{PID}/video.mp4", "application/json")
    assert cat.unknown_key == f"videos/{PID}/thumb.jpg"  # no file_type in its metadata
