"""Task lifecycle: claiming, queue order, state from the event log, transitions,
attempts, retries, deadlines, stuck tasks, and task <-> object joins.

Scale notes
-----------
* Latest state per task is an aggregate (``max_by`` over ``(ts, event_id)``),
  combined map-side.
* Sequences per task (previous state, attempt number, running bytes) and the
  global queue order use ``scan.running``, which splits a hot task across
  range partitions instead of sorting it in one task.
* Claiming the oldest ``n`` tasks is a top-k (TakeOrderedAndProject); the
  claimed ids (at most ``n`` rows, a proven bound) are broadcast back onto the
  snapshot.
* Timeouts are an anti join on ``(task, time bucket)`` plus the range, so only
  events within about one time limit of each other are compared.
* Task <-> object joins are inner + anti joins (skew can be split on either
  side) instead of one left outer join.
* Durations use ``timestamp_diff`` on wall-clock times, independent of the
  session time zone.
* "Now" is always a parameter, so results are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat.functions import objects as O
from reelcat.operators.scan import running

STATUS_EVENTS = K.TASK_STATUSES


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` (microsecond precision) as a double.

    ``timestamp_diff`` works on wall-clock ``timestamp_ntz`` values directly, so
    the result does not depend on the session time zone (no DST jumps).
    """
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of a ``timestamp_ntz`` value, independent of the session zone."""
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


# ---- queue ------------------------------------------------------------------

def claim_batch(tasks: DataFrame, n: int, now: str) -> tuple[DataFrame, DataFrame]:
    """Claim the ``n`` oldest queued tasks (by ``created_at``, then ``id``).

    Returns ``(claimed, snapshot)``: the claimed rows (id, url, webhook) and the
    task table with those rows moved to ``processing`` at ``now``.
    """
    queued = tasks.where(F.col("status") == "queued")
    claimed = (queued.orderBy("created_at", "id").limit(n)
               .select("id", "video_url", "webhook_url", "created_at",
                       F.to_timestamp_ntz(F.lit(now)).alias("claimed_at")))
    ids = claimed.select("id", F.lit(True).alias("_claimed"))
    # planned by AQE from runtime sizes
    snap = (tasks.join(ids, "id", "left")
            .withColumn("status", F.when(F.col("_claimed"), F.lit("processing")).otherwise(F.col("status")))
            .withColumn("updated_at", F.when(F.col("_claimed"), F.to_timestamp_ntz(F.lit(now)))
                        .otherwise(F.col("updated_at")))
            .drop("_claimed"))
    return claimed, snap


def queue_positions(tasks: DataFrame) -> DataFrame:
    """1-based position of every queued task in claim order (created_at, id)."""
    queued = tasks.where(F.col("status") == "queued").select("id", "created_at")
    return running(queued, [], ["created_at", "id"], rn_col="position")


def stuck_tasks(tasks: DataFrame, now: str, limit_s: int = K.OVERALL_TIMEOUT_S) -> DataFrame:
    """Tasks still ``processing`` whose last update is more than ``limit_s`` before ``now``."""
    now_c = F.to_timestamp_ntz(F.lit(now))
    age = seconds_between(F.col("updated_at"), now_c)
    bound = now_c - F.make_dt_interval(secs=F.lit(limit_s))  # reaches the scan as a filter on the stored column
    return (tasks.where((F.col("status") == "processing") & (F.col("updated_at") < bound) & (age > limit_s))
            .select("id", "status", "updated_at", age.alias("stuck_for_s")))


# ---- event log --------------------------------------------------------------

def latest_task_state(events: DataFrame) -> DataFrame:
    """Current status of each task: its last status event by (ts, event_id)."""
    ev = events.where(F.col("event").isin(STATUS_EVENTS))
    last = F.max_by(F.struct("event", "ts", "event_id"), F.struct("ts", "event_id"))
    return (ev.groupBy("task_id").agg(last.alias("l"), F.count(F.lit(1)).alias("n_events"))
            .select("task_id", F.col("l.event").alias("status"), F.col("l.ts").alias("updated_at"),
                    F.col("l.event_id").alias("event_id"), "n_events"))


def legal_transition(prev: Column, cur: Column) -> Column:
    """Is ``prev -> cur`` an edge of the task graph?  A first event must be ``queued``."""
    cond = prev.isNull() & (cur == "queued")
    for a, b in K.LEGAL_TRANSITIONS:
        cond = cond | ((prev == a) & (cur == b))
    return F.coalesce(cond, F.lit(False))


def state_transitions(events: DataFrame) -> DataFrame:
    """Each status event with the previous status of its task, the dwell time in
    the previous status and whether the transition is legal."""
    ev = events.where(F.col("event").isin(STATUS_EVENTS)).select("event_id", "ts", "task_id", "event")
    seq = running(ev, ["task_id"], ["ts", "event_id"], lags=["event", "ts"], rn_col="seq")
    return seq.select(
        "event_id", "task_id", "ts", "seq", F.col("prev_event").alias("prev_status"), F.col("event").alias("status"),
        seconds_between(F.col("prev_ts"), F.col("ts")).alias("dwell_s"),
        legal_transition(F.col("prev_event"), F.col("event")).alias("legal"))


def event_attempts(events: DataFrame) -> DataFrame:
    """Each event with its task's attempt number: the running count of ``processing`` events."""
    return running(events, ["task_id"], ["ts", "event_id"],
                   sums={"attempt": (F.col("event") == "processing").cast("bigint")}, rn_col="seq")


def task_attempts(events: DataFrame) -> DataFrame:
    """One row per (task, attempt >= 1): start, end, events and the last event."""
    ea = event_attempts(events).where(F.col("attempt") >= 1)
    last = F.max_by(F.col("event"), F.struct("ts", "event_id"))
    return (ea.groupBy("task_id", "attempt")
            .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
                 F.count(F.lit(1)).alias("n_events"), last.alias("last_event")))


def retry_frequency(events: DataFrame) -> DataFrame:
    """How many tasks had how many attempts (``processing`` events)."""
    per_task = (events.groupBy("task_id")
                .agg(F.sum((F.col("event") == "processing").cast("bigint")).alias("attempts")))
    return per_task.groupBy("attempts").agg(F.count(F.lit(1)).alias("n_tasks"))


def upload_progress(events: DataFrame) -> DataFrame:
    """Progress of each attempt: running bytes, percent of the attempt's bytes and
    speed in KB/s since the attempt started (only when time has passed)."""
    ea = event_attempts(events).where(F.col("attempt") >= 1)
    att = (ea.groupBy("task_id", "attempt")
           .agg(F.min("ts").alias("attempt_start"),
                F.sum(F.when(F.col("event") == "progress", F.col("bytes"))).alias("total_bytes")))
    prog = ea.where(F.col("event") == "progress").select("event_id", "ts", "task_id", "attempt", "bytes")
    run = running(prog, ["task_id", "attempt"], ["ts", "event_id"], sums={"done_bytes": F.col("bytes")},
                  rn_col="chunk")
    elapsed = seconds_between(F.col("attempt_start"), F.col("ts"))
    return (run.join(att, ["task_id", "attempt"])
            .select("event_id", "task_id", "attempt", "ts", "chunk", "done_bytes", "total_bytes",
                    F.round(elapsed, 6).alias("elapsed_s"),
                    F.round(F.when(F.col("total_bytes") > 0, F.col("done_bytes") / F.col("total_bytes") * 100), 6)
                    .alias("percent"),
                    F.round(F.when(elapsed > 0, F.col("done_bytes") / elapsed / 1024), 6).alias("speed_kbps")))


# ---- errors and retries -----------------------------------------------------

def error_text(message: Column, url: Column | None = None, code: Column | None = None,
               provider: Column | None = None) -> Column:
    """``message | URL: u | Code: c`` (download errors) or ``message | Provider: p | Code: c``
    (storage errors); empty or missing parts are skipped."""
    parts = [message]
    if url is not None:
        parts.append(F.when(url != "", F.concat(F.lit(K.ERROR_URL_LABEL), url)))
    if provider is not None:
        parts.append(F.when(provider != "", F.concat(F.lit(K.ERROR_PROVIDER_LABEL), provider)))
    if code is not None:
        parts.append(F.when(code != "", F.concat(F.lit(K.ERROR_CODE_LABEL), code)))
    return F.concat_ws(K.ERROR_TEXT_SEPARATOR, *parts)


def task_error_text(tasks: DataFrame, provider: str = K.STORAGE_PROVIDER) -> Column:
    cls = F.col("error_class")
    return (F.when(cls == "VideoDownloadError",
                   error_text(F.col("error_message"), url=F.col("video_url"), code=F.col("error_code")))
            .when(cls == "StorageError",
                  error_text(F.col("error_message"), provider=F.lit(provider), code=F.col("error_code")))
            .otherwise(F.col("error_message")))


def retry_eligible(tasks: DataFrame, attempts: DataFrame, max_retries: int = K.MAX_RETRIES) -> DataFrame:
    """Decide retry or final failure for failed tasks.

    ``attempts`` has ``task_key, attempts`` (processing events per task).  A
    task is retried while attempts < ``max_retries`` and its error is
    retryable: download errors with a retryable code or 'timeout' in the text,
    any storage error, other errors mentioning 'timeout' or 'network'.
    """
    failed = tasks.where(F.col("status") == "failed")
    text = task_error_text(failed)
    low = F.lower(text)
    cls = F.col("error_class")
    retryable = (F.when(cls == "VideoDownloadError",
                        F.col("error_code").isin(K.RETRYABLE_DOWNLOAD_CODES) | low.contains("timeout"))
                 .when(cls == "StorageError", F.lit(True))
                 .otherwise(low.contains("timeout") | low.contains("network")))
    joined = failed.join(attempts, failed.src_key == attempts.task_key, "left")
    n = F.coalesce(F.col("attempts"), F.lit(0)).cast("bigint")
    eligible = (n < max_retries) & F.coalesce(retryable, F.lit(False))
    return joined.select("id", "error_class", "error_code", text.alias("error_text"), n.alias("attempts"),
                         eligible.alias("retry"),
                         F.when(eligible, F.lit("queued")).otherwise(F.lit("failed")).alias("next_status"))


def stage_deadlines(events: DataFrame) -> DataFrame:
    """Deadline of every stage for each attempt start (``processing`` event)."""
    limits = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(v).alias("limit_s")) for s, v in K.STAGE_LIMITS])
    starts = events.where(F.col("event") == "processing")
    return (starts.select("event_id", "task_id", "ts", F.explode(limits).alias("l"))
            .select("event_id", "task_id", F.col("ts").alias("started_at"), "l.stage",
                    F.col("l.limit_s").cast("bigint").alias("limit_s"),
                    (F.col("ts") + F.make_dt_interval(secs=F.col("l.limit_s"))).alias("deadline")))


# ---- tasks <-> objects ------------------------------------------------------

def task_files(tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """Each task with its stored objects (prefix ``videos/{task id}/``); tasks without objects keep one row.

    Written as inner join + anti join rather than one left outer join: AQE can
    split a skewed partition on either side of an inner join, but only on the
    left side of a left outer join, and the hot side here is the objects.  The
    anti join's right side is de-duplicated first, so it is one row per id.
    """
    t = tasks.select("id", "status")
    objs = objects.select(O.key_processing_id("key").alias("id"), "key", "file_type", "size")
    with_objects = t.join(objs, "id")
    without = (t.join(objs.select("id").distinct(), "id", "left_anti")
               .select("id", "status", F.lit(None).cast("string").alias("key"),
                       F.lit(None).cast("string").alias("file_type"), F.lit(None).cast("bigint").alias("size")))
    return with_objects.unionByName(without)


def tasks_without_video(tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """Completed tasks whose required ``video`` object is missing."""
    videos = (objects.where(F.col("file_type") == "video")
              .select(O.key_processing_id("key").alias("id")).distinct())
    return tasks.where(F.col("status") == "completed").select("id", "updated_at").join(videos, "id", "left_anti")


def timeouts(events: DataFrame, limit_s: int = K.OVERALL_TIMEOUT_S) -> DataFrame:
    """``processing`` events with no queued/completed/failed event of the same task
    within ``limit_s`` seconds (batch twin of the streaming interval join).

    The range condition is made an equi-join on ``(task, time bucket)``: with
    buckets of ``limit_s`` seconds, an end event at ``x`` can only match starts
    in bucket ``b(x)`` or ``b(x) - 1``, so each end event is offered to two
    buckets and only pairs within about one time limit are compared, even for
    a task with a huge number of events.
    """
    secs = epoch_seconds(F.col("ts"))
    starts = (events.where(F.col("event") == "processing")
              .select("task_id", "event_id", "ts", F.floor(secs / limit_s).alias("bucket")))
    b = F.floor(secs / limit_s)
    ends = (events.where(F.col("event").isin("queued", "completed", "failed"))
            .select(F.col("task_id").alias("e_task"), F.col("ts").alias("e_ts"),
                    F.explode(F.array(b, b - 1)).alias("e_bucket")))
    cond = ((starts.task_id == ends.e_task) & (starts.bucket == ends.e_bucket)
            & (ends.e_ts >= starts.ts)
            & (ends.e_ts <= starts.ts + F.make_dt_interval(secs=F.lit(limit_s))))
    return (starts.join(ends, cond, "left_anti")
            .select("task_id", "event_id", F.col("ts").alias("started_at"),
                    (F.col("ts") + F.make_dt_interval(secs=F.lit(limit_s))).alias("deadline")))


def timeout_decisions(events: DataFrame, limit_s: int = K.OVERALL_TIMEOUT_S,
                      max_retries: int = K.MAX_RETRIES) -> DataFrame:
    """What happens after each timeout: a timeout is a retryable download error
    (code TIMEOUT), so the task is requeued while its attempt number is below
    ``max_retries`` and fails otherwise.  The attempt number is the running
    count of ``processing`` events of the task at the timed-out start."""
    attempts = event_attempts(events).select("event_id", "attempt")
    return (timeouts(events, limit_s).join(attempts, "event_id")
            .select("task_id", "event_id", "started_at", "deadline", "attempt",
                    (F.col("attempt") < max_retries).alias("retry"),
                    F.when(F.col("attempt") < max_retries, F.lit("queued")).otherwise(F.lit("failed"))
                    .alias("next_status")))


def expired_tasks(tasks: DataFrame, now: str, retention_days: int) -> DataFrame:
    """Terminal tasks last updated more than ``retention_days`` before ``now`` (retention by ``updated_at``)."""
    cutoff = F.to_timestamp_ntz(F.lit(now)) - F.make_dt_interval(days=F.lit(retention_days))
    return (tasks.where(F.col("status").isin(K.TERMINAL_STATUSES) & (F.col("updated_at") < cutoff))
            .select("id", "status", "updated_at"))


def queue_depth(state: DataFrame) -> DataFrame:
    """Tasks per current status (from ``latest_task_state`` or the streamed snapshot)."""
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n_tasks"))
