"""Rules and traps on tiny hand-made frames, plus an independent Python model
of the URL rules checked against the Spark expressions on the fixture tasks."""

import hashlib
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat.functions import objects as O
from reelcat.functions import urls as U
from reelcat.operators import catalog as C
from reelcat.operators import identity as I
from reelcat.operators import lifecycle as L
from reelcat.operators import media as M
from reelcat.sources import fixtures as X
from tests.conftest import SF_MID, SF_SMALL


# ---- an independent model of the URL rules (plain Python) -------------------

def py_hash(url):
    return hashlib.md5(url.lower().strip().encode()).hexdigest()[:8]


def py_video_id(url):
    for p in K.VIDEO_ID_PATTERNS:
        m = re.search(p, url)
        if m:
            return m.group(1)
    return None


def py_domain(url):
    m = re.search(r"://([^/]+)", url)
    if m:
        return re.sub(r"^(www\.|m\.)", "", m.group(1))
    return url


def py_url_match(o, p):
    if not o or not p:
        return False
    o, p = o.lower().strip(), p.lower().strip()
    a, b = py_video_id(o), py_video_id(p)
    if a and b:
        return a == b
    return py_domain(o) == py_domain(p)


def py_valid(task_id, url, min_parts=5):
    parts = task_id.split("-")
    if len(parts) < min_parts:
        return True
    return parts[-1] == py_hash(url)


def test_url_rules_match_python_model(spark):
    t = X.tasks(spark, SF_MID)
    rows = t.select("id", "video_url", "processed_url",
                    U.url_match("video_url", "processed_url").alias("m"),
                    U.task_id_matches_url("id", "video_url").alias("v"),
                    U.url_hash("video_url").alias("h")).collect()
    assert len(rows) == 15000
    for r in rows:
        assert r.m == py_url_match(r.video_url, r.processed_url), r
        assert r.v == py_valid(r.id, r.video_url), r
        assert r.h == py_hash(r.video_url), r
    assert sum(r.v for r in rows) == 12000
    assert sum(r.m for r in rows) == 7500


def test_strip_removes_tabs_and_newlines(spark):
    df = spark.createDataFrame([Row(u="\t HTTPS://YouTu.be/Abc \n")])
    got = df.select(U.normalize_url("u").alias("n"), U.url_hash("u").alias("h")).first()
    assert got.n == "https://youtu.be/abc"
    assert got.h == py_hash("\t HTTPS://YouTu.be/Abc \n")


def test_video_id_empty_match_is_null(spark):
    df = spark.createDataFrame([Row(u="https://vimeo.com/1"), Row(u="https://youtu.be/XyZ_9-")])
    got = [r.v for r in df.select(U.video_id("u").alias("v")).collect()]
    assert got == [None, "XyZ_9-"]


def test_domain_keeps_port_and_query_without_slash(spark):
    df = spark.createDataFrame([Row(u="https://www.a.com:8080/x"), Row(u="http://m.b.org?x=1"), Row(u="nourl")])
    got = [r.d for r in df.select(U.domain("u").alias("d")).collect()]
    assert got == ["a.com:8080", "b.org?x=1", "nourl"]


def test_bare_uuid_counts_as_composite(spark):
    uuid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    df = spark.createDataFrame([Row(id=uuid, url="https://x.com/1"), Row(id="job1-abcdef12", url="https://x.com/1")])
    out = I.parse_task_ids(df).collect()
    assert out[0].processing_id == "0f8fad5b-d9cb-469f-a165"  # reference behaviour (min_parts 5)
    assert out[1].processing_id == "job1-abcdef12"
    six = I.parse_task_ids(df, min_parts=6).collect()
    assert six[0].processing_id == uuid
    valid = I.validate_task_ids(df.withColumnRenamed("url", "video_url")).collect()
    assert valid[0].valid is False and valid[1].valid is True


def test_vcodec_none_filter_keeps_null(spark):
    df = spark.createDataFrame(
        [Row(video_id=1, format_id="a", height=None, filesize=None, vcodec=None),
         Row(video_id=1, format_id="b", height=480, filesize=10, vcodec="none"),
         Row(video_id=1, format_id="c", height=360, filesize=5, vcodec="avc1")],
        "video_id bigint, format_id string, height int, filesize bigint, vcodec string")
    kept = sorted(r.format_id for r in M.video_formats(df).collect())
    assert kept == ["a", "c"]
    best = M.best_format(df).first()
    assert best.format_id == "c"  # null height counts as 0, 360 <= 720 wins


def test_best_format_rule_and_ties(spark):
    df = spark.createDataFrame(
        [Row(video_id=1, format_id="x1080", height=1080, filesize=99, vcodec="vp9"),
         Row(video_id=1, format_id="b720", height=720, filesize=7, vcodec="avc1"),
         Row(video_id=1, format_id="a720", height=720, filesize=7, vcodec="avc1"),
         Row(video_id=2, format_id="only", height=2160, filesize=None, vcodec="vp9")],
        "video_id bigint, format_id string, height int, filesize bigint, vcodec string")
    got = {r.video_id: r.format_id for r in M.best_format(df).collect()}
    assert got == {1: "a720", 2: "only"}


def test_nested_best_format_keeps_first_of_ties(spark):
    rows = [Row(id="v", formats=[Row(format_id="f1", ext="mp4", width=1, height=720, filesize=5, vcodec="a", acodec=None),
                                 Row(format_id="f2", ext="mp4", width=1, height=720, filesize=5, vcodec="a", acodec=None),
                                 Row(format_id="f3", ext="mp4", width=1, height=None, filesize=None, vcodec="none", acodec=None)]),
            Row(id="e", formats=[])]
    from reelcat import schemas as S
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("formats", T.ArrayType(S.FORMAT))])
    df = spark.createDataFrame(rows, schema)
    out = {r.id: r.best_format for r in M.best_format_nested(M.video_formats_nested(df)).collect()}
    assert out["v"].format_id == "f1"
    assert out["e"] is None


def test_listing_last_wins_and_paging(spark):
    files = spark.createDataFrame(
        [Row(key="videos/p1/a.mp4", size=1, file_type="video", last_modified="2024-01-02 00:00:00"),
         Row(key="videos/p1/b.mp4", size=2, file_type="video", last_modified="2024-01-02 00:00:00"),
         Row(key="videos/p1/i.info.json", size=3, file_type=None, last_modified="2024-01-01 00:00:00"),
         Row(key="videos/p2/t.jpg", size=4, file_type="thumbnail", last_modified="2024-01-03 00:00:00"),
         Row(key="other/p3/x.mp4", size=5, file_type="video", last_modified="2024-01-03 00:00:00"),
         Row(key="videos/short", size=6, file_type="video", last_modified="2024-01-03 00:00:00")]
    ).withColumn("last_modified", F.to_timestamp_ntz("last_modified"))
    cat = {r.processing_id: r for r in C.video_catalog(files).collect()}
    assert set(cat) == {"p1", "p2"}
    assert cat["p1"].video_key == "videos/p1/b.mp4"  # tie on time -> greatest key
    assert cat["p1"].unknown_key == "videos/p1/i.info.json"
    assert cat["p1"].unknown_content_type == "application/json"
    page = C.video_listing(files, page=1, limit=1).collect()
    assert [(r.processing_id, r.total, r.has_next, r.position) for r in page] == [("p2", 2, True, 1)]
    page2 = C.video_listing(files, page=2, limit=1).collect()
    assert [(r.processing_id, r.has_next, r.position) for r in page2] == [("p1", False, 2)]
    with pytest.raises(ValueError):
        C.video_listing(files, page=0)
    assert C.check_page(1, 500) == (1, 100)


def test_exists_is_exact_not_prefix(spark):
    files = spark.createDataFrame([Row(key="videos/p/a.mp4.bak"), Row(key="videos/p/b.mp4")])
    probes = spark.createDataFrame([Row(key="videos/p/a.mp4"), Row(key="videos/p/b.mp4")])
    got = {r.key: r.exists for r in C.object_exists(files, probes).collect()}
    assert got == {"videos/p/a.mp4": False, "videos/p/b.mp4": True}


def test_exists_shuffles_each_key_once(spark):
    files = spark.createDataFrame([(k,) for k in ["a", "a", "b", "only stored", None]], "key string")
    probes = spark.createDataFrame([(k,) for k in ["a", "c", "a", "c", None, None, "b"]], "key string")
    found = C.object_exists(files, probes)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    # one shuffle, no join, and no combine below, where a map task would hold all keys of its split
    shuffle, = (i for i, x in enumerate(plan) if "Exchange" in x)
    assert not any("Join" in x for x in plan) and not any("Aggregate" in x for x in plan[shuffle:])
    assert sorted(((r.key, r.exists) for r in found.collect()), key=str) == [("a", True), ("b", True), ("c", False), (None, False)]


def test_content_types_and_kinds(spark):
    keys = ["videos/1/a.MP4", "videos/1/a.info.json", "videos/1/.mp4", "videos/1/x", "videos/1/t.webp", "videos/1/t.JPG"]
    df = spark.createDataFrame([Row(k=k) for k in keys])
    got = df.select(O.content_type("k").alias("c"), O.file_kind("k").alias("kind")).collect()
    assert [r.c for r in got] == ["video/mp4", "application/json", None, None, "image/webp", "image/jpeg"]
    assert [r.kind for r in got] == ["video", "metadata", "video", "video", "thumbnail", "video"]


def test_url_extension(spark):
    urls = ["https://i.example.com/a/b.JPG?x=1", "https://example.com", "https://x.com/p#f.png", None, "noext"]
    df = spark.createDataFrame([Row(u=u) for u in urls], "u string")
    got = [r.e for r in df.select(U.url_extension("u").alias("e")).collect()]
    assert got == ["jpg", "com", "png", None, None]


def test_error_text_and_retry(spark):
    tasks = spark.createDataFrame([
        Row(src_key=1, id="a", status="failed", error_class="VideoDownloadError", error_code="FORMAT_ERROR",
            error_message="bad", video_url="https://timeout.example.com/v"),
        Row(src_key=2, id="b", status="failed", error_class="StorageError", error_code=None,
            error_message="HTTP 403", video_url="u"),
        Row(src_key=3, id="c", status="failed", error_class="Exception", error_code=None,
            error_message="HTTP 403", video_url="u"),
        Row(src_key=4, id="d", status="failed", error_class="Exception", error_code=None,
            error_message="Network unreachable", video_url="u")],
        "src_key bigint, id string, status string, error_class string, error_code string, error_message string, "
        "video_url string")
    attempts = spark.createDataFrame([Row(task_key=2, attempts=2)], "task_key bigint, attempts bigint")
    got = {r.id: r for r in L.retry_eligible(tasks, attempts).collect()}
    assert got["a"].error_text == "bad | URL: https://timeout.example.com/v | Code: FORMAT_ERROR"
    assert got["a"].retry is True  # 'timeout' appears in the URL part of the text
    assert got["b"].error_text == "HTTP 403 | Provider: supabase"
    assert got["b"].retry is False  # attempts exhausted
    assert got["c"].retry is False
    assert got["d"].retry is True


def test_legal_transitions(spark):
    df = spark.createDataFrame(
        [Row(p=None, c="queued"), Row(p="queued", c="processing"), Row(p="processing", c="queued"),
         Row(p="queued", c="completed"), Row(p="completed", c="processing"), Row(p=None, c="processing")],
        "p string, c string")
    got = [r.ok for r in df.select(L.legal_transition(F.col("p"), F.col("c")).alias("ok")).collect()]
    assert got == [True, True, True, False, False, False]


def test_chunk_manifest_edges(spark):
    from reelcat.operators import metrics as MM
    df = spark.createDataFrame([Row(k=1, n=0), Row(k=2, n=10), Row(k=3, n=4)], "k bigint, n bigint")
    out = MM.chunk_manifest(df, "k", F.col("n"), 4).orderBy("k", "chunk_index").collect()
    assert [(r.k, r.offset, r.length, r.n_chunks) for r in out] == [
        (2, 0, 4, 3), (2, 4, 4, 3), (2, 8, 2, 3), (3, 0, 4, 1)]


def test_expected_fixture_numbers(spark):
    t = X.tasks(spark, SF_SMALL)
    counts = {r.status: r["count"] for r in t.groupBy("status").count().collect()}
    assert counts == {"queued": 514, "processing": 493, "completed": 387, "failed": 106}
    subs = X.submissions(spark, SF_SMALL)
    assert subs.count() == 2118
    assert I.validate_submissions(subs).where("accepted").count() == 1035
    dup = I.duplicate_urls(t)
    assert dup.count() == 426 and dup.agg(F.sum("n_tasks")).first()[0] == 1067
    assert C.video_catalog(X.files(spark, SF_SMALL)).count() == 1473
    assert M.video_formats(X.formats(spark, SF_SMALL)).count() == 4032
    assert M.best_format(X.formats(spark, SF_SMALL)).count() == 1395


def test_deep_page_uses_ranked_scan_and_matches_topk(spark, monkeypatch):
    cat = C.video_catalog(X.files(spark, SF_SMALL)).select("processing_id", "created_at", "n_files")
    order = ["-created_at", "processing_id"]
    shallow = C.listing_page(cat, order, page=7, limit=40).collect()
    monkeypatch.setattr(C, "TOPK_ROWS", 10)
    deep = C.listing_page(cat, order, page=7, limit=40).collect()
    key = lambda r: r.position
    assert [tuple(r) for r in sorted(shallow, key=key)] == [tuple(r) for r in sorted(deep, key=key)]
    assert [r.position for r in sorted(deep, key=key)] == list(range(241, 281))


def test_catalog_with_one_video_holding_a_third_of_objects(spark):
    files = X.files(spark, SF_MID)
    hot = F.col("processing_id").cast("bigint") % 3 == 0
    skewed = files.withColumn("key", F.when(hot, F.concat(F.lit("videos/hot/"), F.substring_index("key", "/", -1)))
                              .otherwise(F.col("key")))
    cat = {r.processing_id: r for r in C.video_catalog(skewed).collect()}
    hot_rows = skewed.where(F.col("key").startswith("videos/hot/"))
    n_hot = hot_rows.count()
    assert n_hot > 60000 / 4
    got = cat["hot"]
    assert got.n_files == n_hot
    assert got.created_at == hot_rows.agg(F.min("last_modified")).first()[0]
    last_video = (hot_rows.where(F.col("file_type") == "video")
                  .orderBy(F.col("last_modified").desc(), F.col("key").desc()).first())
    assert (got.video_key, got.video_size) == (last_video.key, last_video.size)
    assert len(cat) == C.video_catalog(files.where(~hot)).count() + 1


def test_submissions_are_appended_to_the_task_table_once(spark):
    from reelcat.sources.task_table import append_submissions, read_task_table, write_task_table
    from reelcat.streaming.jobs import scratch
    path = write_task_table(X.tasks(spark, SF_SMALL), scratch(spark, "t-append"))
    before = read_task_table(spark, path).count()
    subs = X.submissions(spark, SF_SMALL)
    append_submissions(spark, path, subs)
    after = read_task_table(spark, path)
    n = after.count()
    assert n > before and n == after.select("id").distinct().count()
    append_submissions(spark, path, subs)  # every id is there already
    assert read_task_table(spark, path).count() == n


def test_timeouts_are_counted_at_the_last_logged_stage(spark):
    import datetime as dt

    from reelcat.operators.metrics import timeout_stage_counts
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "a", 1, None), (2, "a", 2, None), (3, "a", None, "timeout"), (4, "a", None, "timeout"), (5, "b", None, "timeout"),
            (6, None, 3, None), (7, None, None, "timeout"), (8, "a", 1, None)]
    parsed = spark.createDataFrame([(i, t + dt.timedelta(seconds=i), tag, st, p) for i, tag, st, p in rows],
                                   "event_id long, logged_at timestamp_ntz, task_tag string, stage long, pattern string")
    got = {r.stage: r.n_timeouts for r in timeout_stage_counts(parsed).collect()}
    assert got == {2: 2, None: 1, 3: 1}


def test_url_match_case_flag(spark):
    df = spark.createDataFrame([Row(o="https://youtu.be/AbC", p="https://www.youtube.com/watch?v=abc")])
    got = df.select(U.url_match("o", "p").alias("default"),
                    U.url_match("o", "p", case_sensitive=True).alias("exact")).first()
    assert got.default is True   # ids compared after lower-casing
    assert got.exact is False


def test_claim_batches_are_planned_alike_at_every_size(spark):
    import contextlib
    import io
    t = X.tasks(spark, SF_SMALL)
    small = L.claim_batch(t, 10, "1998-08-03 00:00:00")[1]
    big = L.claim_batch(t, 100_001, "1998-08-03 00:00:00")[1]

    def hinted(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(True)
        return "BROADCAST" in buf.getvalue().upper().split("== OPTIMIZED LOGICAL PLAN ==")[0]

    assert not hinted(small) and not hinted(big)
    assert big.where("status = 'processing'").count() == t.where("status in ('queued', 'processing')").count()
