"""Registered lifecycle queries (queue, event log, attempts, retries, deadlines, joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat.operators import lifecycle as L
from reelcat.plans.oracle_views import sql_error_text, sql_hash, with_views
from reelcat.sources import fixtures as X

CLAIM_N = 100
NOW = "1998-08-03 00:00:00"


def task_objects(spark: SparkSession, sf: str, owners: DataFrame | None = None) -> DataFrame:
    """The object listing re-keyed under each task's full id: objects of order
    ``k`` belong to the task whose ``src_key`` is ``k``.  Objects of every fourth order
    are named as the direct path names them.  ``owners`` (id, src_key) are the tasks to take, by default all."""
    files = X.files(spark, sf).withColumn("name", F.substring_index("key", "/", -1)).drop("key")
    tasks = (X.tasks(spark, sf) if owners is None else owners).select(F.col("src_key").cast("string").alias("processing_id"), F.col("id").alias("tid"))
    return (files.join(tasks, "processing_id")
            .select(F.concat(F.lit(f"{K.KEY_ROOT}/"), "tid", F.lit("/"),
                             F.when(F.col("processing_id").cast("bigint") % 4 == 0, F.concat("tid", F.lit("_"))).otherwise(F.lit("")),
                             "name").alias("key"),
                    "file_type", "size", "last_modified"))


def attempts_per_task(spark: SparkSession, sf: str) -> DataFrame:
    ev = X.task_events(spark, sf)
    return (ev.groupBy(F.col("task_id").alias("task_key"))
            .agg(F.sum((F.col("event") == "processing").cast("bigint")).alias("attempts")))


QUERIES = {
    "claim_batch": lambda s, sf: L.claim_batch(X.tasks(s, sf), CLAIM_N, NOW)[0],
    "claim_snapshot": lambda s, sf: L.claim_batch(X.tasks(s, sf), CLAIM_N, NOW)[1].select(
        "id", "status", "created_at", "updated_at"),
    "queue_positions": lambda s, sf: L.queue_positions(X.tasks(s, sf)),
    "stuck_tasks": lambda s, sf: L.stuck_tasks(X.tasks(s, sf), NOW),
    "latest_task_state": lambda s, sf: L.latest_task_state(X.task_events(s, sf)),
    "state_transitions": lambda s, sf: L.state_transitions(X.task_events(s, sf)),
    "task_attempts": lambda s, sf: L.task_attempts(X.task_events(s, sf)),
    "retry_frequency": lambda s, sf: L.retry_frequency(X.task_events(s, sf)),
    "upload_progress": lambda s, sf: L.upload_progress(X.task_events(s, sf)),
    "error_text": lambda s, sf: X.tasks(s, sf).where(F.col("status") == "failed").select(
        "id", "error_class", L.task_error_text(X.tasks(s, sf)).alias("error_text")),
    "retry_eligible": lambda s, sf: L.retry_eligible(X.tasks(s, sf), attempts_per_task(s, sf)),
    "stage_deadlines": lambda s, sf: L.stage_deadlines(X.task_events(s, sf)),
    "task_files": lambda s, sf: L.task_files(X.tasks(s, sf), task_objects(s, sf)),
    "tasks_without_video": lambda s, sf: L.tasks_without_video(X.tasks(s, sf), task_objects(s, sf)),
}


# --- oracle -------------------------------------------------------------------

def _legal_sql(prev: str, cur: str) -> str:
    edges = " OR ".join(f"({prev} = '{a}' AND {cur} = '{b}')" for a, b in K.LEGAL_TRANSITIONS)
    return f"coalesce(({prev} IS NULL AND {cur} = 'queued') OR {edges}, false)"


_STATUS_IN = "('" + "','".join(K.TASK_STATUSES) + "')"
_SECS = "(epoch_us({b}) - epoch_us({a})) / 1000000.0"
_ATT = """ea AS (
 SELECT *, sum(CASE WHEN event = 'processing' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts, event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS attempt
 FROM task_events)"""
_TASK_OBJECTS = """tobj AS (
 SELECT 'videos/' || t.id || '/' || CASE WHEN t.src_key % 4 = 0 THEN t.id || '_' ELSE '' END || regexp_extract(f.key, '[^/]*$') AS key, f.file_type, f.size, f.last_modified
 FROM files f JOIN tasks t ON f.processing_id = cast(t.src_key as varchar))"""
_ERR_TEXT = sql_error_text()
_STAGES = ", ".join(f"{{'stage': '{s}', 'limit_s': {v}}}" for s, v in K.STAGE_LIMITS)

ORACLE = {
    "claim_batch": with_views(["tasks"], f"""
SELECT id, video_url, webhook_url, created_at, TIMESTAMP '{NOW}' AS claimed_at FROM tasks
WHERE status = 'queued' ORDER BY created_at, id LIMIT {CLAIM_N}"""),
    "claim_snapshot": with_views(["tasks"], f"""
WITH c AS (SELECT id FROM tasks WHERE status = 'queued' ORDER BY created_at, id LIMIT {CLAIM_N})
SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'processing' ELSE status END AS status, created_at,
 CASE WHEN id IN (SELECT id FROM c) THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
FROM tasks"""),
    "queue_positions": with_views(["tasks"], """
SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS position FROM tasks WHERE status = 'queued'"""),
    "stuck_tasks": with_views(["tasks"], f"""
SELECT id, status, updated_at, {_SECS.format(a='updated_at', b=f"TIMESTAMP '{NOW}'")} AS stuck_for_s FROM tasks
WHERE status = 'processing' AND {_SECS.format(a='updated_at', b=f"TIMESTAMP '{NOW}'")} > {K.OVERALL_TIMEOUT_S}"""),
    "latest_task_state": with_views(["task_events"], f"""
SELECT task_id, (max(struct_pack(t := ts, i := event_id, e := event))).e AS status, max(ts) AS updated_at,
 (max(struct_pack(t := ts, i := event_id))).i AS event_id, count(*) AS n_events
FROM task_events WHERE event IN {_STATUS_IN} GROUP BY task_id"""),
    "state_transitions": with_views(["task_events"], f"""
WITH s AS (
 SELECT event_id, task_id, ts, event AS status,
  row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS seq,
  lag(event) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS prev_status,
  lag(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS prev_ts
 FROM task_events WHERE event IN {_STATUS_IN})
SELECT event_id, task_id, ts, seq, prev_status, status, {_SECS.format(a='prev_ts', b='ts')} AS dwell_s,
 {_legal_sql('prev_status', 'status')} AS legal
FROM s"""),
    "task_attempts": with_views(["task_events"], f"""WITH {_ATT}
SELECT task_id, attempt, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events,
 (max(struct_pack(t := ts, i := event_id, e := event))).e AS last_event
FROM ea WHERE attempt >= 1 GROUP BY task_id, attempt"""),
    "retry_frequency": with_views(["task_events"], """
SELECT attempts, count(*) AS n_tasks FROM (
 SELECT task_id, sum(CASE WHEN event = 'processing' THEN 1 ELSE 0 END)::BIGINT AS attempts FROM task_events GROUP BY task_id)
GROUP BY attempts"""),
    "upload_progress": with_views(["task_events"], f"""WITH {_ATT},
 a AS (SELECT task_id, attempt, min(ts) AS attempt_start,
        sum(CASE WHEN event = 'progress' THEN bytes END)::BIGINT AS total_bytes
       FROM ea WHERE attempt >= 1 GROUP BY task_id, attempt),
 p AS (SELECT event_id, ts, task_id, attempt, bytes,
        row_number() OVER (PARTITION BY task_id, attempt ORDER BY ts, event_id) AS chunk,
        sum(bytes) OVER (PARTITION BY task_id, attempt ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS done_bytes
       FROM ea WHERE attempt >= 1 AND event = 'progress')
SELECT p.event_id, p.task_id, p.attempt, p.ts, p.chunk, p.done_bytes, a.total_bytes,
 round({_SECS.format(a='a.attempt_start', b='p.ts')}, 6) AS elapsed_s,
 round(CASE WHEN a.total_bytes > 0 THEN p.done_bytes / a.total_bytes * 100 END, 6) AS percent,
 round(CASE WHEN {_SECS.format(a='a.attempt_start', b='p.ts')} > 0
   THEN p.done_bytes / ({_SECS.format(a='a.attempt_start', b='p.ts')}) / 1024 END, 6) AS speed_kbps
FROM p JOIN a ON p.task_id = a.task_id AND p.attempt = a.attempt"""),
    "error_text": with_views(["tasks"], f"SELECT id, error_class, {_ERR_TEXT} AS error_text FROM tasks WHERE status = 'failed'"),
    "retry_eligible": with_views(["tasks", "task_events"], f"""
WITH att AS (SELECT task_id AS task_key, sum(CASE WHEN event = 'processing' THEN 1 ELSE 0 END)::BIGINT AS attempts
             FROM task_events GROUP BY task_id),
 f AS (SELECT t.*, {_ERR_TEXT} AS error_text, coalesce(att.attempts, 0) AS n
       FROM tasks t LEFT JOIN att ON t.src_key = att.task_key WHERE t.status = 'failed'),
 r AS (SELECT *, n < {K.MAX_RETRIES} AND coalesce(CASE error_class
        WHEN 'VideoDownloadError' THEN error_code IN ('TIMEOUT', 'NETWORK_ERROR') OR contains(lower(error_text), 'timeout')
        WHEN 'StorageError' THEN true
        ELSE contains(lower(error_text), 'timeout') OR contains(lower(error_text), 'network') END, false) AS retry
       FROM f)
SELECT id, error_class, error_code, error_text, n AS attempts, retry,
 CASE WHEN retry THEN 'queued' ELSE 'failed' END AS next_status FROM r"""),
    "stage_deadlines": with_views(["task_events"], f"""
WITH s AS (SELECT event_id, task_id, ts, unnest([{_STAGES}]) AS l FROM task_events WHERE event = 'processing')
SELECT event_id, task_id, ts AS started_at, l.stage, l.limit_s::BIGINT AS limit_s, ts + to_seconds(l.limit_s) AS deadline
FROM s"""),
    "task_files": with_views(["files", "tasks"], f"""WITH {_TASK_OBJECTS}
SELECT t.id, t.status, o.key, o.file_type, o.size FROM tasks t
LEFT JOIN tobj o ON t.id = CASE WHEN len(string_split(o.key, '/')) >= 3 AND string_split(o.key, '/')[1] = 'videos'
                                THEN string_split(o.key, '/')[2] END"""),
    "tasks_without_video": with_views(["files", "tasks"], f"""WITH {_TASK_OBJECTS}
SELECT id, updated_at FROM tasks WHERE status = 'completed'
 AND id NOT IN (SELECT string_split(key, '/')[2] FROM tobj WHERE file_type = 'video')"""),
}


# --- the stored task table (partitioned sink + pruned reads) ---------------------

QUEUE_FROM, QUEUE_TO = "1994-01-01 00:00:00", "1996-01-01 00:00:00"
_TASK_TABLES: dict = {}


def _stored_tasks(spark: SparkSession, sf: str) -> str:
    from reelcat.sources.media import scratch_path
    from reelcat.sources.task_table import write_task_table
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TASK_TABLES:
        _TASK_TABLES[key] = write_task_table(X.tasks(spark, sf), scratch_path(spark, "task-table"))
    return _TASK_TABLES[key]


def q_queued_between(spark: SparkSession, sf: str) -> DataFrame:
    from reelcat.sources.task_table import queued_between
    t = queued_between(spark, _stored_tasks(spark, sf), QUEUE_FROM, QUEUE_TO)
    return t.select("id", "video_url", "created_at", "updated_at")


QUERIES["queued_between"] = q_queued_between
ORACLE["queued_between"] = with_views(["tasks"], f"""
SELECT id, video_url, created_at, updated_at FROM tasks
WHERE status = 'queued' AND created_at >= TIMESTAMP '{QUEUE_FROM}' AND created_at < TIMESTAMP '{QUEUE_TO}'""")


def q_appended_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The task table after all submissions were appended to it."""
    from reelcat.sources.media import scratch_path
    from reelcat.sources.task_table import append_submissions, read_task_table, write_task_table
    path = write_task_table(X.tasks(spark, sf), scratch_path(spark, "appended-tasks"))
    append_submissions(spark, path, X.submissions(spark, sf))
    return read_task_table(spark, path).select("id", "base_id", "video_url", "status", "created_at", "updated_at")


QUERIES["appended_tasks"] = q_appended_tasks
ORACLE["appended_tasks"] = with_views(["submissions", "tasks"], f"""
WITH q AS (SELECT base_id || '-' || {sql_hash('url')} AS id, base_id, url, submitted_at FROM submissions
           WHERE base_id IS NOT NULL AND url IS NOT NULL),
 f AS (SELECT * FROM q WHERE id NOT IN (SELECT id FROM tasks)
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY submitted_at, url) = 1)
SELECT id, base_id, video_url, status, created_at, updated_at FROM tasks
UNION ALL SELECT id, base_id, url, 'queued', submitted_at, submitted_at FROM f""")

RETENTION_DAYS = 365

QUERIES["expired_tasks"] = lambda s, sf: L.expired_tasks(X.tasks(s, sf), NOW, RETENTION_DAYS)
QUERIES["queue_depth"] = lambda s, sf: L.queue_depth(L.latest_task_state(X.task_events(s, sf)))
ORACLE["expired_tasks"] = with_views(["tasks"], f"""
SELECT id, status, updated_at FROM tasks
WHERE status IN ('completed', 'failed') AND updated_at < TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY""")
ORACLE["queue_depth"] = with_views(["task_events"], f"""
WITH s AS (SELECT task_id, (max(struct_pack(t := ts, i := event_id, e := event))).e AS status
           FROM task_events WHERE event IN {_STATUS_IN} GROUP BY task_id)
SELECT status, count(*) AS n_tasks FROM s GROUP BY status""")
