"""Registered streaming queries and their batch twins.

Streaming queries run with ``trigger(availableNow=True)`` into a folder under
the shared checkpoint directory and return the written table; the driver's
check for them is row-based (no SQL oracle), while the batch twins carry the
SQL oracle and tests assert ``stream == batch`` on rows the watermark closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat.operators import lifecycle as L
from reelcat.operators import metrics as M
from reelcat.plans.oracle_views import sql_hash, with_views
from reelcat.sources import fixtures as X
from reelcat.streaming import jobs as J

PROGRESS_WINDOW = "1 hour"


def _ntz(df: DataFrame) -> DataFrame:
    """Event times are instants in UTC for the watermark; report them as zone-less times, the type of
    the input tables, whatever the session zone."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return df.select(*[F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch).alias(c) if t == "timestamp" else F.col(c)
                       for c, t in df.dtypes])


_KNOWN: dict = {}


def _known_tasks(spark: SparkSession, sf: str) -> str:
    """The stored task table the stream appends to (written once per application and input)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KNOWN:
        _KNOWN[key] = J.write_known_tasks(X.tasks(spark, sf), J.scratch(spark, "known-tasks"))
    return _KNOWN[key]


def q_stream_submissions(spark: SparkSession, sf: str) -> DataFrame:
    known = _known_tasks(spark, sf)
    out = J.run_to_table(J.stream_submissions(J.submission_stream(spark, sf)), "stream-submissions",
                         foreach_batch=J.new_tasks_batch(known))
    return _ntz(J.task_table(spark, out).read().select("id", "base_id", "video_url", "url_hash", "status", "created_at", "updated_at"))


def q_stream_failure_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = J.run_to_table(J.stream_failure_rate(J.task_event_stream(spark, sf)), "stream-failure-rate")
    return _ntz(spark.read.parquet(out))


def q_stream_task_state(spark: SparkSession, sf: str) -> DataFrame:
    out = J.run_to_table(J.stream_task_state(J.task_event_stream(spark, sf)), "stream-task-state",
                         foreach_batch=J.snapshot_merge_batch)
    return _ntz(J.latest_snapshot(spark, out))


def q_stream_queue_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks per current status, from the snapshot the task-state stream maintains."""
    return L.queue_depth(q_stream_task_state(spark, sf))


def q_stream_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    df = J.stream_timeouts(J.task_event_stream(spark, sf), J.task_event_stream(spark, sf))
    return _ntz(spark.read.parquet(J.run_to_table(df, "stream-timeouts")))


def q_stream_timeout_decisions(spark: SparkSession, sf: str) -> DataFrame:
    kept = J.run_to_table(J.attempt_starts(J.task_event_stream(spark, sf)), "stream-attempts", foreach_batch=J.attempt_starts_batch)
    df = J.stream_timeouts(J.task_event_stream(spark, sf), J.task_event_stream(spark, sf))
    out = J.run_to_table(df, "stream-timeout-decisions", foreach_batch=J.timeout_decisions_batch(kept))
    return _ntz(J.event_table(spark, out).read())


def q_stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    df = J.stream_progress(J.task_event_stream(spark, sf), PROGRESS_WINDOW)
    return _ntz(spark.read.parquet(J.run_to_table(df, "stream-progress")))


def q_stream_failure_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All windows, open ones too, from the job that keeps late events."""
    out = J.run_to_table(J.status_events(J.task_event_stream(spark, sf)), "stream-failure-windows", foreach_batch=J.failure_windows_batch())
    return _ntz(J.failure_windows(spark, out))


def q_stream_outbox(spark: SparkSession, sf: str) -> DataFrame:
    out = J.run_to_table(J.stream_outbox(J.task_event_stream(spark, sf)), "stream-outbox", foreach_batch=J.outbox_batch)
    return _ntz(J.event_table(spark, out).read())


QUERIES = {
    "timeouts": lambda s, sf: L.timeouts(X.task_events(s, sf)),
    "timeout_decisions": lambda s, sf: L.timeout_decisions(X.task_events(s, sf)),
    "progress_windows": lambda s, sf: M.progress_windows(X.task_events(s, sf), PROGRESS_WINDOW),
    "event_outbox": lambda s, sf: M.event_outbox(X.task_events(s, sf)),
    "stream_submissions": q_stream_submissions,
    "stream_failure_rate": q_stream_failure_rate,
    "stream_task_state": q_stream_task_state,
    "stream_queue_depth": q_stream_queue_depth,
    "stream_timeouts": q_stream_timeouts,
    "stream_timeout_decisions": q_stream_timeout_decisions,
    "stream_progress": q_stream_progress,
    "stream_outbox": q_stream_outbox,
    "stream_failure_windows": q_stream_failure_windows,
}

ORACLE = {
    "timeouts": with_views(["task_events"], f"""
SELECT p.task_id, p.event_id, p.ts AS started_at, p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND AS deadline
FROM task_events p WHERE p.event = 'processing' AND NOT EXISTS (
 SELECT 1 FROM task_events t WHERE t.task_id = p.task_id AND t.event IN ('queued', 'completed', 'failed')
  AND t.ts >= p.ts AND t.ts <= p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND)"""),
    "timeout_decisions": with_views(["task_events"], f"""
WITH ea AS (SELECT event_id, sum(CASE WHEN event = 'processing' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id
             ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS attempt FROM task_events)
SELECT p.task_id, p.event_id, p.ts AS started_at, p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND AS deadline, ea.attempt,
 ea.attempt < {K.MAX_RETRIES} AS retry, CASE WHEN ea.attempt < {K.MAX_RETRIES} THEN 'queued' ELSE 'failed' END AS next_status
FROM task_events p JOIN ea ON p.event_id = ea.event_id
WHERE p.event = 'processing' AND NOT EXISTS (
 SELECT 1 FROM task_events t WHERE t.task_id = p.task_id AND t.event IN ('queued', 'completed', 'failed')
  AND t.ts >= p.ts AND t.ts <= p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND)"""),
    "progress_windows": with_views(["task_events"], """
SELECT task_id, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
 sum(bytes)::BIGINT AS bytes, count(*) AS n_chunks, round(sum(bytes) / 3600 / 1024, 6) AS kbps
FROM task_events WHERE event = 'progress' GROUP BY task_id, date_trunc('hour', ts)"""),
    "event_outbox": with_views(["task_events"], f"""
WITH a AS (SELECT task_id, event_id, event, ts, unnest(range(1, {K.WEBHOOK_MAX_ATTEMPTS + 1})) AS attempt
           FROM task_events WHERE event IN ('completed', 'failed'))
SELECT task_id, event_id, event, attempt::BIGINT AS attempt, (pow(2, attempt - 1) - 1)::BIGINT AS delay_s,
 ts + to_seconds((pow(2, attempt - 1) - 1)::BIGINT) AS send_after
FROM a"""),
}


# --- oracles for the streams ---------------------------------------------------
# availableNow over one file runs one data batch and then a no-data batch at the
# final watermark: max event time (of each watermarked input, after its filter)
# minus 10 minutes, the minimum over inputs.  Closed rows are exactly those the
# final watermark has passed.

_WM = "INTERVAL 10 MINUTE"
_STATUS_IN = "('queued', 'processing', 'completed', 'failed')"

ORACLE["stream_submissions"] = with_views(["submissions", "tasks"], f"""
WITH q AS (SELECT base_id || '-' || {sql_hash('url')} AS id, base_id, url, {sql_hash('url')} AS url_hash, submitted_at
           FROM submissions WHERE base_id IS NOT NULL AND url IS NOT NULL)
SELECT id, base_id, url AS video_url, url_hash, 'queued' AS status, submitted_at AS created_at, submitted_at AS updated_at
FROM q WHERE id NOT IN (SELECT id FROM tasks)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY submitted_at, url) = 1""")
ORACLE["stream_failure_rate"] = with_views(["task_events"], f"""
WITH e AS (SELECT ts, event FROM task_events WHERE event IN {_STATUS_IN}),
 w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n_events,
        sum(CASE WHEN event = 'failed' THEN 1 ELSE 0 END)::BIGINT AS n_failed,
        sum(CASE WHEN event = 'completed' THEN 1 ELSE 0 END)::BIGINT AS n_completed FROM e GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n_events, n_failed, n_completed,
 round(n_failed / n_events, 6) AS failure_rate, round(n_failed / n_events, 6) > 0.2 AS alert FROM w
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - {_WM}""")
ORACLE["stream_failure_windows"] = with_views(["task_events"], f"""
WITH e AS (SELECT ts, event FROM task_events WHERE event IN {_STATUS_IN}),
 w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n_events,
        sum(CASE WHEN event = 'failed' THEN 1 ELSE 0 END)::BIGINT AS n_failed,
        sum(CASE WHEN event = 'completed' THEN 1 ELSE 0 END)::BIGINT AS n_completed FROM e GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n_events, n_failed, n_completed,
 round(n_failed / n_events, 6) AS failure_rate, round(n_failed / n_events, 6) > 0.2 AS alert,
 window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM e) - {_WM} AS closed FROM w""")
ORACLE["stream_task_state"] = with_views(["task_events"], f"""
SELECT task_id, (max(struct_pack(t := ts, i := event_id, e := event))).e AS status, max(ts) AS updated_at,
 (max(struct_pack(t := ts, i := event_id))).i AS event_id
FROM task_events WHERE event IN {_STATUS_IN} GROUP BY task_id""")
ORACLE["stream_timeouts"] = with_views(["task_events"], f"""
SELECT p.task_id, p.event_id, p.ts AS started_at, p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND AS deadline
FROM task_events p WHERE p.event = 'processing' AND NOT EXISTS (
 SELECT 1 FROM task_events t WHERE t.task_id = p.task_id AND t.event IN ('queued', 'completed', 'failed')
  AND t.ts >= p.ts AND t.ts <= p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND)
 AND p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND < least(
  (SELECT max(ts) FROM task_events WHERE event = 'processing'),
  (SELECT max(ts) FROM task_events WHERE event IN ('queued', 'completed', 'failed'))) - {_WM}""")
ORACLE["stream_progress"] = with_views(["task_events"], f"""
WITH e AS (SELECT * FROM task_events WHERE event = 'progress')
SELECT task_id, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
 sum(bytes)::BIGINT AS bytes, count(*) AS n_chunks, round(sum(bytes) / 3600 / 1024, 6) AS kbps
FROM e GROUP BY task_id, date_trunc('hour', ts)
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - {_WM}""")
ORACLE["stream_outbox"] = ORACLE["event_outbox"]
ORACLE["stream_timeout_decisions"] = with_views(["task_events"], f"""
WITH ea AS (SELECT event_id, sum(CASE WHEN event = 'processing' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id
             ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS attempt FROM task_events)
SELECT p.task_id, p.event_id, p.ts AS started_at, p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND AS deadline, ea.attempt,
 ea.attempt < {K.MAX_RETRIES} AS retry, CASE WHEN ea.attempt < {K.MAX_RETRIES} THEN 'queued' ELSE 'failed' END AS next_status
FROM task_events p JOIN ea ON p.event_id = ea.event_id
WHERE p.event = 'processing' AND NOT EXISTS (
 SELECT 1 FROM task_events t WHERE t.task_id = p.task_id AND t.event IN ('queued', 'completed', 'failed')
  AND t.ts >= p.ts AND t.ts <= p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND)
 AND p.ts + INTERVAL {K.OVERALL_TIMEOUT_S} SECOND < least(
  (SELECT max(ts) FROM task_events WHERE event = 'processing'),
  (SELECT max(ts) FROM task_events WHERE event IN ('queued', 'completed', 'failed'))) - {_WM}""")
ORACLE["stream_queue_depth"] = with_views(["task_events"], f"""
WITH s AS (SELECT task_id, (max(struct_pack(t := ts, i := event_id, e := event))).e AS status
           FROM task_events WHERE event IN {_STATUS_IN} GROUP BY task_id)
SELECT status, count(*) AS n_tasks FROM s GROUP BY status""")
