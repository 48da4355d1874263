"""Registered metric and report queries, plus file-kind / key / URL helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat.functions import objects as O
from reelcat.functions import urls as U
from reelcat.operators import catalog as C
from reelcat.operators import metrics as M
from reelcat.plans.catalog import BASE_URL, BUCKET
from reelcat.plans.lifecycle import task_objects
from reelcat.plans.oracle_views import (
    sql_content_type, sql_domain, sql_error_text, sql_key_pid, sql_norm, sql_object_url, sql_processing_id, sql_url_ext, sql_video_id,
    with_views,
)
from reelcat.sources import fixtures as X
from reelcat.sources.media import media_records
from reelcat.sources.tables import read_table

FAILURE_WINDOW = "1 day"
FAILURE_ALERT = 0.2
CHUNK = K.STREAM_CHUNK_BYTES
SLIDE = "12 hours"


def q_result_documents(spark: SparkSession, sf: str) -> DataFrame:
    tasks = X.tasks(spark, sf)
    # only tasks whose id has ended get a document: objects and records of others aren't gathered
    ended = tasks.select("id", "src_key").join(tasks.where(F.col("status").isin(K.TERMINAL_STATUSES)).select("id"), "id", "left_semi")
    slots = C.video_details(task_objects(spark, sf, ended), BASE_URL, BUCKET)
    # records are built after the join with their tasks: the shuffle carries the columns they are built from
    orders = read_table(spark, sf, "orders").join(ended.select("src_key", F.col("id").alias("task_id")), F.col("o_orderkey") == F.col("src_key"))
    records = media_records(spark, sf, orders, ["task_id"])
    videos = records.select(F.col("task_id").alias("id"), F.struct(*(c for c in records.columns if c != "task_id")).alias("record"))
    return M.result_documents(tasks, slots, X.task_warnings(spark, sf), videos)


def q_webhook_outbox(spark: SparkSession, sf: str) -> DataFrame:
    return M.webhook_outbox(q_result_documents(spark, sf), X.tasks(spark, sf))


def q_file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    f = X.files(spark, sf)
    return f.select("key", O.file_kind("key").alias("kind"), O.content_type("key").alias("content_type"),
                    O.listed_file_type("file_type").alias("listed_type"))


def q_url_extensions(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    ext = U.url_extension("url")
    return p.select("page_id", "url", ext.alias("ext"), F.coalesce(ext, F.lit(K.DEFAULT_THUMBNAIL_EXT)).alias("thumb_ext"))


def q_object_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = X.tasks(spark, sf)
    vid = F.coalesce(U.video_id(U.normalize_url("video_url")), F.col("base_id"))
    thumb = U.url_extension("processed_url")
    std = O.standard_object_keys("id", vid, F.lit("mp4"), F.coalesce(thumb, F.lit(K.DEFAULT_THUMBNAIL_EXT)))
    direct = O.direct_object_keys("id", vid, thumb)
    return (t.select("id", std.alias("s"), direct.alias("d"))
            .select("id", F.col("s.video").alias("video_key"), F.col("s.metadata").alias("metadata_key"),
                    F.col("s.thumbnail").alias("thumbnail_key"), F.col("d.video").alias("direct_video_key"),
                    F.col("d.metadata").alias("direct_metadata_key"), F.col("d.thumbnail").alias("direct_thumbnail_key"),
                    O.key_processing_id(F.col("s.video")).alias("parsed_id")))


def q_object_urls(spark: SparkSession, sf: str) -> DataFrame:
    return X.files(spark, sf).select("key", O.object_url("key", BASE_URL, BUCKET).alias("url"))


QUERIES = {
    "supported_sites": lambda s, sf: M.supported_sites(read_table(s, sf, "pages")),
    "status_summary": lambda s, sf: M.status_summary(X.tasks(s, sf)),
    "completion_rates": lambda s, sf: M.completion_rates(X.tasks(s, sf)),
    "processing_time": lambda s, sf: M.processing_time(X.tasks(s, sf)),
    "timeout_counts": lambda s, sf: M.timeout_counts(X.tasks(s, sf)),
    "timeout_stage_counts": lambda s, sf: M.timeout_stage_counts(M.parse_log_lines(X.log_lines(s, sf))),
    "warning_counts": lambda s, sf: M.warning_counts(X.task_warnings(s, sf)),
    "partial_share": lambda s, sf: M.partial_share(X.tasks(s, sf), X.task_warnings(s, sf)),
    "result_documents": lambda s, sf: q_result_documents(s, sf).drop("document"),
    "result_json": lambda s, sf: q_result_documents(s, sf).select("id", "document"),
    "webhook_outbox": q_webhook_outbox,
    "log_events": lambda s, sf: M.parse_log_lines(X.log_lines(s, sf)),
    "log_pattern_counts": lambda s, sf: M.log_pattern_counts(M.parse_log_lines(X.log_lines(s, sf))),
    "chunk_manifest": lambda s, sf: M.chunk_manifest(read_table(s, sf, "pages"), "page_id",
                                                     F.octet_length("html"), CHUNK),
    "chunk_manifest_upload": lambda s, sf: M.chunk_manifest(read_table(s, sf, "pages"), "page_id",
                                                            F.octet_length("html"), K.UPLOADER_CHUNK_BYTES),
    "failure_rate_windows": lambda s, sf: M.failure_rate_windows(X.task_events(s, sf), FAILURE_WINDOW,
                                                                 threshold=FAILURE_ALERT),
    "failure_rate_sliding": lambda s, sf: M.failure_rate_windows(X.task_events(s, sf), FAILURE_WINDOW, SLIDE,
                                                                 threshold=FAILURE_ALERT),
    "file_kinds": q_file_kinds,
    "url_extensions": q_url_extensions,
    "object_keys": q_object_keys,
    "object_urls": q_object_urls,
}


# --- oracle -------------------------------------------------------------------

_SECS = "(epoch_us({b}) - epoch_us({a})) / 1000000.0"
_ERR_TEXT = sql_error_text()
_TASK_OBJECTS = """tobj AS (
 SELECT 'videos/' || t.id || '/' || CASE WHEN t.src_key % 4 = 0 THEN t.id || '_' ELSE '' END || regexp_extract(f.key, '[^/]*$') AS key, f.file_type, f.size, f.last_modified
 FROM files f JOIN tasks t ON f.processing_id = cast(t.src_key as varchar))"""
_SLOTS = f"""slots AS (
 SELECT {sql_key_pid('key')} AS id,
  (max(CASE WHEN file_type = 'video' THEN struct_pack(lm := last_modified, k := key) END)).k AS video_key,
  (max(CASE WHEN file_type = 'metadata' THEN struct_pack(lm := last_modified, k := key) END)).k AS metadata_key,
  (max(CASE WHEN file_type = 'thumbnail' THEN struct_pack(lm := last_modified, k := key) END)).k AS thumbnail_key
 FROM tobj WHERE file_type IN ('video', 'metadata', 'thumbnail') GROUP BY 1)"""
_PARTIAL_IN = "('" + "','".join(K.PARTIAL_WARNINGS) + "')"
_KNOWN_IN = "('" + "','".join(K.WARNINGS) + "')"
_WFLAGS = f"""wf AS (
 SELECT id, count(DISTINCT warning) AS n_w,
  bool_or(warning IN {_PARTIAL_IN}) AS partial
 FROM task_warnings GROUP BY id)"""


def _url_match(o: str, p: str) -> str:
    from reelcat.plans.oracle_views import sql_url_match
    return sql_url_match(o, p)


_IS_DIRECT = "coalesce(starts_with(regexp_extract(s.video_key, '[^/]*$'), t.id || '_'), false)"
_RESULT_FLAT = f"""WITH {_TASK_OBJECTS}, {_SLOTS}, {_WFLAGS}
SELECT t.id, t.status = 'completed' AS success,
 CASE WHEN t.status = 'completed' THEN {_url_match('t.video_url', 't.processed_url')} END AS url_match,
 CASE WHEN t.status = 'completed' THEN {sql_processing_id('t.id')} END AS original_id,
 CASE WHEN t.status = 'completed' THEN {_IS_DIRECT} END AS direct_processing,
 CASE WHEN t.status = 'completed' THEN 'Order video ' || cast(t.src_key as varchar) END AS video_title,
 CASE WHEN t.status = 'completed' THEN s.video_key END AS video_key,
 CASE WHEN t.status = 'completed' THEN s.metadata_key END AS metadata_key,
 CASE WHEN t.status = 'completed' THEN s.thumbnail_key END AS thumbnail_key,
 CASE WHEN t.status = 'completed' THEN coalesce(w.n_w, 0) END AS n_warnings,
 CASE WHEN t.status = 'completed' THEN coalesce(w.partial, false) END AS partial_success,
 CASE WHEN t.status <> 'completed' THEN CASE WHEN t.error_code = 'TIMEOUT' THEN '{K.FAILURE_TIMEOUT}'
   ELSE '{K.FAILURE_OTHER}' END END AS error
FROM tasks t LEFT JOIN slots s ON t.id = s.id LEFT JOIN wf w ON t.id = w.id
WHERE t.status IN ('completed', 'failed')"""

_LOG = K.LOG_LINE_PATTERN
_PATTERN_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(message, '{rx}') THEN '{name}'" for name, rx in K.LOG_WATCH_PATTERNS) + " END"
_PARSED_LOG = f"""pl AS (
 SELECT event_id, strptime(regexp_extract(line, '{_LOG}', 1), '%Y-%m-%d %H:%M:%S,%g') AS logged_at,
  nullif(regexp_extract(line, '{_LOG}', 2), '') AS logger, nullif(regexp_extract(line, '{_LOG}', 3), '') AS level,
  regexp_extract(line, '{_LOG}', 4) AS message
 FROM log_lines),
pl2 AS (
 SELECT event_id, logged_at, logger, level, message,
  nullif(regexp_extract(message, '{K.LOG_TASK_TAG_PATTERN}', 1), '') AS task_tag,
  cast(nullif(regexp_extract(message, '{K.LOG_STAGE_PATTERN}', 1), '') AS BIGINT) AS stage,
  {_PATTERN_CASE} AS pattern
 FROM pl)"""

def _warning_list_sql() -> str:
    items = ", ".join(f"CASE WHEN w.f{i} THEN '{w}' END" for i, w in enumerate(K.WARNINGS))
    return f"list_concat(coalesce(list_filter([{items}], lambda x: x IS NOT NULL), []), coalesce(w.others, []))"


_WFLAGS_EACH = "wl AS (SELECT id, " + ", ".join(
    f"bool_or(warning = '{w}') AS f{i}" for i, w in enumerate(K.WARNINGS)) + (
    f", list_sort(list(DISTINCT warning) FILTER (WHERE warning NOT IN {_KNOWN_IN})) AS others FROM task_warnings GROUP BY id)")


def _slot_doc(t: str) -> str:
    return (f"CASE WHEN s.{t}_key IS NOT NULL THEN struct_pack(key := s.{t}_key, "
            f"url := {sql_object_url(f's.{t}_key', BASE_URL, BUCKET)}, size := s.{t}_size) END")


_SLOTS_FULL = f"""slots AS (
 SELECT {sql_key_pid('key')} AS id,
  (max(CASE WHEN file_type = 'video' THEN struct_pack(lm := last_modified, k := key, sz := size) END)).k AS video_key,
  (max(CASE WHEN file_type = 'video' THEN struct_pack(lm := last_modified, k := key, sz := size) END)).sz AS video_size,
  (max(CASE WHEN file_type = 'metadata' THEN struct_pack(lm := last_modified, k := key, sz := size) END)).k AS metadata_key,
  (max(CASE WHEN file_type = 'metadata' THEN struct_pack(lm := last_modified, k := key, sz := size) END)).sz AS metadata_size,
  (max(CASE WHEN file_type = 'thumbnail' THEN struct_pack(lm := last_modified, k := key, sz := size) END)).k AS thumbnail_key,
  (max(CASE WHEN file_type = 'thumbnail' THEN struct_pack(lm := last_modified, k := key, sz := size) END)).sz AS thumbnail_size
 FROM tobj WHERE file_type IN ('video', 'metadata', 'thumbnail') GROUP BY 1)"""

_PARTIAL_ANY = " OR ".join(f"w.f{K.WARNINGS.index(x)}" for x in K.PARTIAL_WARNINGS)

_ORIGINAL_ID = sql_processing_id("t.id")
_INFO = """v AS (
 SELECT o_orderkey AS src_key, struct_pack(id := 'v' || cast(o_orderkey as varchar), title := 'Order video ' || cast(o_orderkey as varchar),
  description := CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END, duration := o_totalprice / 100,
  uploader := 'uploader' || cast(o_custkey as varchar), upload_date := strftime(o_orderdate, '%Y%m%d'),
  view_count := o_orderkey * 37 % 100000, like_count := CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END,
  thumbnail := 'https://img.example.com/' || cast(o_orderkey as varchar) || '.jpg',
  webpage_url := 'https://www.youtube.com/watch?v=V' || cast(o_orderkey as varchar),
  extractor := CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'youtube' END) AS info,
  [struct_pack(format_id := cast(o_orderkey as varchar) || '-360', ext := 'mp4', width := 640, height := 360,
    filesize := cast(floor(o_totalprice) as bigint) * 10, vcodec := 'avc1', acodec := 'mp4a'),
   struct_pack(format_id := cast(o_orderkey as varchar) || '-1080', ext := 'webm', width := 1920,
    height := CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1080 END, filesize := cast(floor(o_totalprice) as bigint) * 40,
    vcodec := CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'vp9' END, acodec := NULL),
   struct_pack(format_id := cast(o_orderkey as varchar) || '-a', ext := 'm4a', width := NULL, height := NULL,
    filesize := cast(floor(o_totalprice) as bigint), vcodec := 'none', acodec := 'mp4a'),
   struct_pack(format_id := cast(o_orderkey as varchar) || '-720', ext := 'mp4', width := 1280, height := 720,
    filesize := CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE cast(floor(o_totalprice) as bigint) * 20 END, vcodec := NULL, acodec := 'mp4a')] AS formats,
  CASE WHEN o_orderstatus = 'F' THEN cast(floor(o_totalprice) as bigint) * 1000 END AS file_size,
  CASE WHEN o_orderstatus = 'F' THEN 'mp4' END AS file_extension FROM orders)"""


def _success_sql(video: str, storage: str, more: str = "") -> str:
    return f"""to_json(struct_pack(success := true, processing_id := t.id, original_id := {_ORIGINAL_ID}, original_url := t.video_url,
   processed_url := t.processed_url, url_match := {_url_match('t.video_url', 't.processed_url')}, video_info := {video},
   storage := {storage}, warnings := {_warning_list_sql()}, partial_success := coalesce({_PARTIAL_ANY}, false){more}))::VARCHAR"""


_ALL_SLOTS = f"struct_pack(video := {_slot_doc('video')}, metadata := {_slot_doc('metadata')}, thumbnail := {_slot_doc('thumbnail')})"
_OWN_SLOTS = "map_from_entries(list_filter([" + ", ".join(
    f"struct_pack(k := '{t}', v := {_slot_doc(t)})" for t in K.FILE_TYPES) + "], lambda x: x.v IS NOT NULL))"
_DOC_CTES = f"{_TASK_OBJECTS}, {_SLOTS_FULL}, {_WFLAGS_EACH}, {_INFO}"
_DOC_SELECT = f"""SELECT t.id, CASE WHEN t.status <> 'completed' THEN to_json(struct_pack(success := false, processing_id := t.id,
   error := CASE WHEN t.error_code = 'TIMEOUT' THEN '{K.FAILURE_TIMEOUT}' ELSE '{K.FAILURE_OTHER}' END,
   error_details := {_ERR_TEXT.replace('error_class', 't.error_class').replace('error_message', 't.error_message')
                     .replace('video_url', 't.video_url').replace('error_code', 't.error_code')}))::VARCHAR
 WHEN {_IS_DIRECT} THEN {_success_sql("struct_insert(v.info, formats := v.formats)", _OWN_SLOTS, ", direct_processing := true")}
 ELSE {_success_sql("struct_insert(v.info, file_size := v.file_size, file_extension := v.file_extension)", _ALL_SLOTS)} END AS document
FROM tasks t LEFT JOIN slots s ON t.id = s.id LEFT JOIN wl w ON t.id = w.id LEFT JOIN v ON v.src_key = t.src_key
WHERE t.status IN ('completed', 'failed')"""
_RESULT_JSON = f"WITH {_DOC_CTES}\n{_DOC_SELECT}"

def _chunk_sql(chunk: int) -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(html)::BIGINT AS n_bytes FROM pages),
 c AS (SELECT page_id, n_bytes, unnest(range(0, n_bytes, {chunk})) AS "offset" FROM p WHERE n_bytes > 0)
SELECT page_id, n_bytes, ("offset" // {chunk})::BIGINT AS chunk_index, "offset"::BIGINT AS "offset",
 least({chunk}, n_bytes - "offset")::BIGINT AS length, ceil(n_bytes / {chunk})::BIGINT AS n_chunks FROM c"""


ORACLE = {
    "result_json": with_views(["files", "tasks", "task_warnings"], _RESULT_JSON),
    "supported_sites": f"""WITH s AS (SELECT DISTINCT {sql_domain('url')} AS site FROM pages)
SELECT site, (SELECT count(*) FROM s) AS total_count FROM s ORDER BY site LIMIT {K.SUPPORTED_SITES_SHOWN}""",
    "status_summary": with_views(["tasks"], """
SELECT status, count(*) AS n_tasks, round(count(*) / (SELECT count(*) FROM tasks), 6) AS share FROM tasks GROUP BY status"""),
    "completion_rates": with_views(["tasks"], """
WITH c AS (SELECT count(*) AS n_tasks, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END)::BIGINT AS n_completed,
  sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS n_failed FROM tasks)
SELECT n_tasks, n_completed, n_failed, round(n_completed / n_tasks, 6) AS completion_rate,
 round(n_failed / n_tasks, 6) AS failure_rate, round(n_completed / (n_completed + n_failed), 6) AS terminal_success_rate
FROM c"""),
    "processing_time": with_views(["tasks"], f"""
WITH d AS (SELECT status, {_SECS.format(a='created_at', b='updated_at')} AS secs FROM tasks
           WHERE status IN ('completed', 'failed'))
SELECT status, count(*) AS n_tasks, round(avg(secs), 6) AS avg_s, round(quantile_cont(secs, 0.5), 6) AS p50_s,
 round(quantile_cont(secs, 0.95), 6) AS p95_s, max(secs) AS max_s
FROM d GROUP BY status"""),
    "timeout_counts": with_views(["tasks"], f"""
SELECT date_trunc('day', updated_at)::TIMESTAMP AS day, count(*) AS n_failed,
 sum(CASE WHEN coalesce(error_code = 'TIMEOUT', false) OR coalesce(contains(lower({_ERR_TEXT}), 'timeout')
   OR contains(lower({_ERR_TEXT}), 'timed out'), false) THEN 1 ELSE 0 END)::BIGINT AS n_timeouts
FROM tasks WHERE status = 'failed' GROUP BY 1"""),
    "timeout_stage_counts": with_views(["log_lines"], f"""WITH {_PARSED_LOG},
 s AS (SELECT *, last_value(stage IGNORE NULLS) OVER (PARTITION BY task_tag ORDER BY logged_at, event_id) AS at_stage FROM pl2)
SELECT date_trunc('day', logged_at)::TIMESTAMP AS day, at_stage AS stage, count(*) AS n_timeouts
FROM s WHERE pattern = 'timeout' GROUP BY 1, 2"""),
    "warning_counts": with_views(["task_warnings"], """
SELECT warning, count(DISTINCT id) AS n_tasks FROM task_warnings GROUP BY warning"""),
    "partial_share": with_views(["tasks", "task_warnings"], f"""WITH {_WFLAGS},
 c AS (SELECT count(*) AS n_completed, sum(CASE WHEN coalesce(w.partial, false) THEN 1 ELSE 0 END)::BIGINT AS n_partial
       FROM tasks t LEFT JOIN wf w ON t.id = w.id WHERE t.status = 'completed')
SELECT n_completed, n_partial, round(n_partial / n_completed, 6) AS partial_share FROM c"""),
    "result_documents": with_views(["files", "tasks", "task_warnings"], _RESULT_FLAT),
    "webhook_outbox": with_views(["files", "tasks", "task_warnings"], f"""WITH {_DOC_CTES}, docs AS ({_DOC_SELECT}),
 a AS (SELECT id, webhook_url, updated_at, unnest(range(1, {K.WEBHOOK_MAX_ATTEMPTS + 1})) AS attempt FROM tasks
       WHERE status IN ('completed', 'failed') AND webhook_url IS NOT NULL)
SELECT a.id, webhook_url, attempt::BIGINT AS attempt, (pow(2, attempt - 1) - 1)::BIGINT AS delay_s,
 updated_at + to_seconds((pow(2, attempt - 1) - 1)::BIGINT) AS send_after,
 contains(webhook_url, '{K.WEBHOOK_AUTH_MARKER}') AS authorized, docs.document AS payload
FROM a JOIN docs ON a.id = docs.id"""),
    "log_events": with_views(["log_lines"], f"WITH {_PARSED_LOG}\nSELECT * FROM pl2"),
    "log_pattern_counts": with_views(["log_lines"], f"""WITH {_PARSED_LOG}
SELECT pattern, level, count(*) AS n_lines, min(logged_at) AS first_at, max(logged_at) AS last_at
FROM pl2 GROUP BY pattern, level"""),
    "chunk_manifest": _chunk_sql(CHUNK),
    "chunk_manifest_upload": _chunk_sql(K.UPLOADER_CHUNK_BYTES),
    "failure_rate_windows": with_views(["task_events"], f"""
WITH w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n_events,
  sum(CASE WHEN event = 'failed' THEN 1 ELSE 0 END)::BIGINT AS n_failed,
  sum(CASE WHEN event = 'completed' THEN 1 ELSE 0 END)::BIGINT AS n_completed
 FROM task_events WHERE event IN ('queued','processing','completed','failed') GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n_events, n_failed, n_completed,
 round(n_failed / n_events, 6) AS failure_rate, round(n_failed / n_events, 6) > {FAILURE_ALERT} AS alert FROM w"""),
    "failure_rate_sliding": with_views(["task_events"], f"""
WITH e AS (SELECT ts, event FROM task_events WHERE event IN ('queued','processing','completed','failed')),
 b AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, event FROM e
       UNION ALL
       SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 12:00:00') AS window_start, event FROM e),
 w AS (SELECT window_start, count(*) AS n_events, sum(CASE WHEN event = 'failed' THEN 1 ELSE 0 END)::BIGINT AS n_failed,
        sum(CASE WHEN event = 'completed' THEN 1 ELSE 0 END)::BIGINT AS n_completed FROM b GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n_events, n_failed, n_completed,
 round(n_failed / n_events, 6) AS failure_rate, round(n_failed / n_events, 6) > {FAILURE_ALERT} AS alert FROM w"""),
    "file_kinds": with_views(["files"], f"""
SELECT key, CASE WHEN ends_with(key, '.info.json') THEN 'metadata'
  WHEN ends_with(key, '.jpg') OR ends_with(key, '.png') OR ends_with(key, '.webp') THEN 'thumbnail' ELSE 'video' END AS kind,
 {sql_content_type('key')} AS content_type, coalesce(file_type, 'unknown') AS listed_type FROM files"""),
    "url_extensions": f"""
SELECT page_id, url, {sql_url_ext('url')} AS ext, coalesce({sql_url_ext('url')}, 'jpg') AS thumb_ext FROM pages""",
    "object_keys": with_views(["tasks"], f"""
WITH k AS (SELECT id, coalesce({sql_video_id(sql_norm('video_url'))}, base_id) AS vid,
  {sql_url_ext('processed_url')} AS te FROM tasks)
SELECT id, 'videos/' || id || '/' || vid || '.mp4' AS video_key, 'videos/' || id || '/' || vid || '.info.json' AS metadata_key,
 'videos/' || id || '/' || vid || '.' || coalesce(te, 'jpg') AS thumbnail_key,
 'videos/' || id || '/' || id || '_' || vid || '.mp4' AS direct_video_key,
 'videos/' || id || '/' || id || '{K.DIRECT_METADATA_SUFFIX}' AS direct_metadata_key,
 'videos/' || id || '/' || id || '{K.DIRECT_THUMBNAIL_INFIX}' || coalesce(te, '{K.DEFAULT_THUMBNAIL_EXT}') AS direct_thumbnail_key,
 {sql_key_pid("'videos/' || id || '/' || vid || '.mp4'")} AS parsed_id
FROM k"""),
    "object_urls": with_views(["files"], f"SELECT key, {sql_object_url('key', BASE_URL, BUCKET)} AS url FROM files"),
}


# --- log files: text sink and source -------------------------------------------

def q_log_file_events(spark: SparkSession, sf: str) -> DataFrame:
    """Write the worker log as text files, read them back with ``spark.read.text`` and parse."""
    from reelcat.sources.media import scratch_path
    path = scratch_path(spark, "logs")
    X.log_lines(spark, sf).select(F.col("line").alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.lit(None).cast("bigint").alias("event_id"), F.col("value").alias("line"))
    return M.parse_log_lines(lines).drop("event_id")


QUERIES["log_file_events"] = q_log_file_events
ORACLE["log_file_events"] = with_views(["log_lines"], f"WITH {_PARSED_LOG}\nSELECT * EXCLUDE (event_id) FROM pl2")



def _log_with_tracebacks(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines as a worker writes them to a file: an error goes on over several lines, some times and stage numbers are broken, some uploads are retried."""
    lines = X.log_lines(spark, sf)
    i = F.col("event_id")
    line = (F.when(i % 89 == 0, F.regexp_replace("line", r"^(\d{4})-\d\d", "$1-19"))
            .when(i % 83 == 0, F.regexp_replace("line", "Stage 2", "Stage 99999999999999999999"))
            .when(i % 79 == 0, F.regexp_replace("line", " - ([A-Z]+) - .*$", " - WARNING - Retrying in 2 seconds...")).otherwise(F.col("line")))
    trace = F.concat(F.lit("\nTraceback (most recent call last):\n  File \"worker.py\", line "), i.cast("string"), F.lit(", in run\n\nTimeoutError: limit"))
    return lines.select(F.concat(line, F.when(F.col("line").contains(" - ERROR - "), trace).otherwise(F.lit(""))).alias("value"))


def q_log_records(spark: SparkSession, sf: str) -> DataFrame:
    """Write a worker log with tracebacks and malformed fields as text files, read it back record by record."""
    from reelcat.sources.media import scratch_path
    path = scratch_path(spark, "records")
    _log_with_tracebacks(spark, sf).write.text(path)
    return M.log_records(M.log_file_lines(spark, path)).drop("file")


QUERIES["log_records"] = q_log_records
ORACLE["log_records"] = with_views(["log_lines"], rf"""WITH src AS (
 SELECT event_id, CASE WHEN event_id % 89 = 0 THEN regexp_replace(line, '^(\d{{4}})-\d\d', '\1-19')
   WHEN event_id % 83 = 0 THEN replace(line, 'Stage 2', 'Stage 99999999999999999999')
   WHEN event_id % 79 = 0 THEN regexp_replace(line, ' - ([A-Z]+) - .*$', ' - WARNING - Retrying in 2 seconds...') ELSE line END AS line,
  CASE WHEN line LIKE '% - ERROR - %' THEN 'Traceback (most recent call last):' || chr(10) || '  File "worker.py", line ' || event_id || ', in run' || chr(10) || chr(10) || 'TimeoutError: limit' END AS "trailing"
 FROM log_lines),
p AS (SELECT *, regexp_extract(line, '{_LOG}', 4) AS message FROM src)
SELECT "trailing", try_strptime(regexp_extract(line, '{_LOG}', 1), '%Y-%m-%d %H:%M:%S,%g') AS logged_at,
 nullif(regexp_extract(line, '{_LOG}', 2), '') AS logger, nullif(regexp_extract(line, '{_LOG}', 3), '') AS level, message,
 nullif(regexp_extract(message, '{K.LOG_TASK_TAG_PATTERN}', 1), '') AS task_tag,
 try_cast(nullif(regexp_extract(message, '{K.LOG_STAGE_PATTERN}', 1), '') AS BIGINT) AS stage,
 {_PATTERN_CASE} AS pattern FROM p""")
