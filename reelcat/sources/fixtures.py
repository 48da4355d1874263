"""Fixture views derived by Spark from the driver's tables.

The ingestion data model (tasks, object listings, media formats, task
events, submissions, warnings, log lines) is built from ``orders``,
``lineitem`` and ``events`` with plain Spark SQL, so every query's work grows
with the input tables.  Each function returns a lazy DataFrame; nothing is
materialised until an operator runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelcat.sources.tables import read_table

TASKS_SQL = """
WITH u AS (
 SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice,
  md5(cast(o_orderkey as string)) AS h,
  CASE o_orderkey % 8
   WHEN 0 THEN 'https://www.youtube.com/watch?v=V' || cast(o_custkey as string)
   WHEN 1 THEN 'https://youtu.be/V' || cast(o_custkey as string)
   WHEN 2 THEN 'https://www.youtube.com/embed/V' || cast(o_custkey as string)
   WHEN 3 THEN 'https://m.youtube.com/v/V' || cast(o_custkey as string)
   WHEN 4 THEN 'https://www.tiktok.com/@u' || cast(o_custkey % 10 as string) || '/video/' || cast(o_custkey as string)
   WHEN 5 THEN 'https://tiktok.com/t/T' || cast(o_custkey as string)
   WHEN 6 THEN 'http://vimeo.com/' || cast(o_custkey as string) || '?ref=x'
   ELSE 'not-a-url-' || cast(o_custkey as string) END AS clean_url
 FROM {orders}),
b AS (SELECT *, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS base_id,
  substr(md5(lower(clean_url)),1,8) AS uh FROM u)
SELECT o_orderkey AS src_key, base_id,
 CASE WHEN o_orderkey % 10 = 9 THEN base_id
      WHEN o_orderkey % 10 = 8 THEN 'job' || cast(o_orderkey as string) || '-' || uh
      WHEN o_orderkey % 10 = 7 THEN base_id || '-deadbeef'
      ELSE base_id || '-' || uh END AS id,
 CASE WHEN o_custkey % 5 = 0 THEN chr(9) || upper(clean_url) || '  ' ELSE clean_url END AS video_url,
 CASE o_orderkey % 4 WHEN 0 THEN clean_url WHEN 1 THEN 'https://www.youtube.com/watch?v=V' || cast(o_custkey as string)
   WHEN 2 THEN 'https://vimeo.com/1' ELSE NULL END AS processed_url,
 CASE WHEN o_custkey % 3 = 0 THEN 'https://hooks.example.com/' || cast(o_custkey as string) END AS webhook_url,
 CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing'
   ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'completed' END END AS status,
 CASE WHEN o_orderstatus='F' AND o_orderpriority='5-LOW' THEN CASE o_orderkey % 3 WHEN 0 THEN 'VideoDownloadError'
   WHEN 1 THEN 'StorageError' ELSE 'Exception' END END AS error_class,
 CASE WHEN o_orderstatus='F' AND o_orderpriority='5-LOW' AND o_orderkey % 3 = 0 THEN CASE o_custkey % 3
   WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'FORMAT_ERROR' END END AS error_code,
 CASE WHEN o_orderstatus='F' AND o_orderpriority='5-LOW' THEN CASE o_custkey % 4 WHEN 0 THEN 'Timeout after 900s'
   WHEN 1 THEN 'Network unreachable' WHEN 2 THEN 'Processing timed out' ELSE 'HTTP 403' END END AS error_message,
 o_orderdate + make_dt_interval(0,0,0,o_orderkey % 86400) AS created_at,
 o_orderdate + make_dt_interval(0,0,0,o_orderkey % 86400 + cast(floor(o_totalprice) as bigint) % 3600) AS updated_at
FROM b
"""

FILES_SQL = """
SELECT cast(l_orderkey as string) AS processing_id,
 'videos/' || cast(l_orderkey as string) || '/' || cast(l_linenumber as string) || '_' || cast(l_partkey as string)
  || '_' || cast(l_suppkey as string)
  || CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus='F' THEN '.mp4' ELSE '.webm' END WHEN 'N' THEN '.info.json'
     ELSE CASE WHEN l_linestatus='F' THEN '.jpg' ELSE '.webp' END END AS key,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 AND l_returnflag='R' THEN 'subtitle' WHEN l_returnflag='A' THEN 'video' WHEN l_returnflag='N' THEN 'metadata'
   ELSE 'thumbnail' END AS file_type,
 cast(round(l_extendedprice * 100) as bigint) AS size, l_shipdate AS last_modified
FROM {lineitem}
"""

FORMATS_SQL = """
SELECT l_orderkey AS video_id,
 cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(l_linenumber as string) AS format_id,
 CASE l_linenumber WHEN 1 THEN 144 WHEN 2 THEN 240 WHEN 3 THEN 360 WHEN 4 THEN 480 WHEN 5 THEN 720 WHEN 6 THEN 1080 END AS height,
 CASE WHEN l_linestatus='F' THEN cast(round(l_extendedprice * 100) as bigint) END AS filesize,
 CASE l_returnflag WHEN 'A' THEN 'avc1' WHEN 'R' THEN 'none' END AS vcodec
FROM {lineitem}
"""

TASK_EVENTS_SQL = """
SELECT event_id, ts, user_id AS task_id,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'progress'
   WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS event,
 cast(round(value * 1024) as bigint) AS bytes
FROM {events}
"""

# The two views below are written as one scan of ``tasks`` that explodes a
# small fixed array per row, instead of a UNION ALL of several scans; the
# rows are the same (the oracle keeps the UNION ALL form and checks it).
SUBMISSIONS_SQL = """
SELECT s.base_id, s.url, s.submitted_at FROM (
 SELECT explode(filter(array(
   named_struct('keep', true, 'base_id', base_id, 'url', video_url, 'submitted_at', created_at),
   named_struct('keep', webhook_url IS NOT NULL, 'base_id', base_id, 'url', upper(video_url) || ' ',
                'submitted_at', updated_at),
   named_struct('keep', substr(base_id,1,1) = '0', 'base_id', CASE WHEN status = 'failed' THEN base_id END,
                'url', CASE WHEN status = 'queued' THEN 'ftp://x.example.com/' || base_id END, 'submitted_at', created_at)
  ), x -> x.keep)) AS s
 FROM {tasks})
"""

TASK_WARNINGS_SQL = """
SELECT id, w.warning FROM (
 SELECT id, explode(filter(array(
   named_struct('warning', 'url_mismatch', 'hit', processed_url IS NULL),
   named_struct('warning', 'metadata_upload_failed', 'hit', substr(md5(id),1,1) IN ('0','1')),
   named_struct('warning', 'thumbnail_upload_failed', 'hit', substr(md5(id),1,1) IN ('1','2')),
   named_struct('warning', 'info_url_generation_failed', 'hit', substr(md5(id),1,1) = '3'),
   named_struct('warning', 'subtitle_upload_failed', 'hit', substr(md5(id),1,1) IN ('3','4'))
  ), x -> x.hit)) AS w
 FROM {tasks} WHERE status = 'completed')
"""

LOG_LINES_SQL = """
SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS') || ' - src.tasks - '
 || CASE event WHEN 'failed' THEN 'ERROR' ELSE 'INFO' END || ' - ' ||
 CASE event WHEN 'queued' THEN '[' || cast(task_id as string) || '] Stage 1: Downloading video'
  WHEN 'processing' THEN 'Using proxy for request'
  WHEN 'progress' THEN '[' || cast(task_id as string) || '] Stage 2: Uploading files to storage'
  WHEN 'completed' THEN 'Task ' || cast(task_id as string) || ' completed successfully.'
  ELSE '[' || cast(task_id as string) || '] Timeout during video processing: ' END AS line
FROM {task_events}
"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task table (one row per task id) derived from ``orders``."""
    return spark.sql(TASKS_SQL, orders=read_table(spark, sf_dir, "orders"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object listing (key, file_type, size, last_modified) derived from ``lineitem``."""
    return spark.sql(FILES_SQL, lineitem=read_table(spark, sf_dir, "lineitem"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded media formats derived from ``lineitem``."""
    return spark.sql(FORMATS_SQL, lineitem=read_table(spark, sf_dir, "lineitem"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task event log derived from ``events``."""
    return spark.sql(TASK_EVENTS_SQL, events=read_table(spark, sf_dir, "events"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL submissions: originals, case/space repeats and invalid rows."""
    return spark.sql(SUBMISSIONS_SQL, tasks=tasks(spark, sf_dir))


def task_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings raised while completing tasks, one row per (id, warning)."""
    return spark.sql(TASK_WARNINGS_SQL, tasks=tasks(spark, sf_dir))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker log lines in the reference's log format, one per task event."""
    return spark.sql(LOG_LINES_SQL, task_events=task_events(spark, sf_dir))


FIXTURES = {
    "tasks": tasks,
    "files": files,
    "formats": formats,
    "task_events": task_events,
    "submissions": submissions,
    "task_warnings": task_warnings,
    "log_lines": log_lines,
}
