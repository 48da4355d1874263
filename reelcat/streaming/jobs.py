"""Structured Streaming twins of the batch operators.

Each job is a function from a streaming DataFrame to a streaming DataFrame
(column logic shared with the batch operator), plus ``run_to_table`` to drive
it with ``trigger(availableNow=True)`` into a Parquet folder under the shared
checkpoint directory.  A job that is given its folder goes on where its last run stopped.

State is always bounded: every stateful step has an event-time watermark
(windowed aggregation, interval join), and table-level facts that must hold for
ever (the task primary key, one delivery per event, the task snapshot) are
enforced in ``foreachBatch`` against a stored, versioned table (``KeyedTable``) rather than in streaming
state.  A version names the epoch it came from, so a replayed batch is applied once, whatever marks
the file system keeps; a batch reads only the parts that may hold its keys and writes what it adds.  No row is dropped for being late in these: arrival order and file layout
don't change what is accepted.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat.operators import identity as I
from reelcat.session import checkpoint_dir
from reelcat.sources import fixtures as X
from reelcat.sources.keyed_table import KeyedTable, hadoop

TERMINAL_OR_REQUEUE = ["queued", "completed", "failed"]


# ---- sources ----------------------------------------------------------------

def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream one table of ``sf_dir``: a folder of part files, or one file (its folder is watched, one file name matched)."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    fs, p = hadoop(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def utc_instant(col: str):
    """A zone-less time read as UTC, whatever the session zone (watermarks reject zone-less times)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(col)))


def task_event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Task events as a stream, event time as an instant in UTC."""
    ev = spark.sql(X.TASK_EVENTS_SQL, events=table_stream(spark, sf_dir, "events", max_files))
    return ev.withColumn("ts", utc_instant("ts"))


def submission_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    tasks = spark.sql(X.TASKS_SQL, orders=table_stream(spark, sf_dir, "orders", max_files))
    subs = spark.sql(X.SUBMISSIONS_SQL, tasks=tasks)
    return subs.withColumn("submitted_at", utc_instant("submitted_at"))


# ---- jobs -------------------------------------------------------------------

def stream_submissions(subs: DataFrame) -> DataFrame:
    """Validated, hashed submissions; ``new_tasks_batch`` keeps the first of each task id."""
    return I.submit_tasks(subs)


def stream_failure_rate(events: DataFrame, duration: str = "1 day", slide: str | None = None,
                        watermark: str = "10 minutes", threshold: float = 0.2) -> DataFrame:
    ev = events.where(F.col("event").isin(K.TASK_STATUSES)).withWatermark("ts", watermark)
    win = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    return (ev.groupBy(win.alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum((F.col("event") == "failed").cast("bigint")).alias("n_failed"),
                 F.sum((F.col("event") == "completed").cast("bigint")).alias("n_completed"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n_events", "n_failed", "n_completed",
                    F.round(F.col("n_failed") / F.col("n_events"), 6).alias("failure_rate"))
            .withColumn("alert", F.col("failure_rate") > threshold))


def stream_task_state(events: DataFrame) -> DataFrame:
    """Status events to fold into the task snapshot.

    The stream itself keeps no state (the number of tasks grows without end);
    ``snapshot_merge_batch`` reduces each micro-batch to the latest event per
    task and merges it into the stored, versioned snapshot.
    """
    return (events.where(F.col("event").isin(K.TASK_STATUSES))
            .select("task_id", F.col("event").alias("status"), F.col("ts").alias("updated_at"), "event_id"))


def stream_timeouts(starts: DataFrame, ends: DataFrame, limit_s: int = K.OVERALL_TIMEOUT_S,
                    watermark: str = "10 minutes") -> DataFrame:
    """``processing`` events with no queued/completed/failed event of the same task within
    ``limit_s``: a watermarked left-outer interval join, unmatched rows are timeouts.

    As in the batch twin, the equi-key is ``(task, time bucket of limit_s)`` and
    each end event is offered to its bucket and the one before, so the join
    state of a very busy task is spread over buckets instead of one key.
    """
    p = (starts.where(F.col("event") == "processing")
         .select(F.col("task_id").alias("p_task"), F.col("event_id").alias("p_event_id"), F.col("ts").alias("p_ts"),
                 F.floor(F.unix_seconds("ts") / limit_s).alias("p_bucket"))
         .withWatermark("p_ts", watermark))
    b = F.floor(F.unix_seconds("ts") / limit_s)
    t = (ends.where(F.col("event").isin(TERMINAL_OR_REQUEUE))
         .select(F.col("task_id").alias("t_task"), F.col("ts").alias("t_ts"),
                 F.explode(F.array(b, b - 1)).alias("t_bucket"))
         .withWatermark("t_ts", watermark))
    cond = ((F.col("p_task") == F.col("t_task")) & (F.col("p_bucket") == F.col("t_bucket"))
            & (F.col("t_ts") >= F.col("p_ts"))
            & (F.col("t_ts") <= F.col("p_ts") + F.expr(f"INTERVAL {limit_s} SECONDS")))
    j = p.join(t, cond, "leftOuter")
    return (j.where(F.col("t_task").isNull())
            .select(F.col("p_task").alias("task_id"), F.col("p_event_id").alias("event_id"),
                    F.col("p_ts").alias("started_at"),
                    (F.col("p_ts") + F.expr(f"INTERVAL {limit_s} SECONDS")).alias("deadline")))


def stream_progress(events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Bytes moved per task and window, and the throughput in KB/s over the window."""
    secs = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end"))
    return (events.where(F.col("event") == "progress").withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "task_id")
            .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_chunks"))
            .select("task_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "bytes", "n_chunks", F.round(F.col("bytes") / secs / 1024, 6).alias("kbps")))


def stream_outbox(events: DataFrame, max_attempts: int = K.WEBHOOK_MAX_ATTEMPTS) -> DataFrame:
    """One outbox row per delivery attempt for each terminal event; ``outbox_batch`` writes each event's rows once."""
    term = events.where(F.col("event").isin(K.TERMINAL_STATUSES))
    att = F.explode(F.sequence(F.lit(1), F.lit(max_attempts))).alias("attempt")
    delay = F.pow(F.lit(2), F.col("attempt") - 1).cast("bigint") - 1
    return (term.select("task_id", "event_id", "event", "ts", att)
            .select("task_id", "event_id", "event", F.col("attempt").cast("bigint").alias("attempt"),
                    delay.alias("delay_s"), (F.col("ts") + F.make_dt_interval(secs=delay)).alias("send_after")))


# ---- sinks and drivers ------------------------------------------------------

def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def run_to_table(df: DataFrame, name: str, mode: str = "append", foreach_batch=None, root: str | None = None) -> str:
    """Run ``df`` over all input there is with ``availableNow`` into a Parquet folder; return the folder.

    With ``root``, the job's own folder, a run goes on from the checkpoint that the last one left there: input that
    came since is read, and a batch that failed is repeated under its old number.  The folder holds
    checkpoint and output, which belong together.
    """
    spark = df.sparkSession
    root = root or scratch(spark, name)
    out, ckpt = os.path.join(root, "out"), os.path.join(root, "ckpt")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if foreach_batch is not None:
        writer = writer.foreachBatch(lambda batch, epoch: foreach_batch(batch, epoch, out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return out


def task_table(spark: SparkSession, path: str) -> KeyedTable:
    """Tasks by id: stored ones, and those that the submission stream adds."""
    return KeyedTable(spark, path, "id")


def event_table(spark: SparkSession, path: str) -> KeyedTable:
    """Rows by event id, in the order of the numbers."""
    return KeyedTable(spark, path, F.lpad(F.col("event_id").cast("string"), 20, "0"))


def write_known_tasks(tasks: DataFrame, path: str) -> str:
    """Store task rows in ranges of the id (the primary-key lookup structure)."""
    task_table(tasks.sparkSession, path).create(tasks)
    return path


def new_tasks_batch(known_path: str):
    """``foreachBatch`` body for T1: keep tasks whose id is neither stored nor
    added by an earlier epoch (the primary key holds for ever), of repeats within the
    batch the one submitted first, and append them to the table at ``out``.

    Only parts whose range holds one of the batch's ids are read, of the stored table and of the stream's own.
    """
    def body(batch: DataFrame, epoch: int, out: str) -> None:
        spark = batch.sparkSession
        added = task_table(spark, out)
        if added.applied(epoch):
            return
        rest = F.struct(*(c for c in batch.columns if c != "id"))
        first = batch.groupBy("id").agg(F.min_by(rest, F.struct("created_at", "video_url")).alias("_first")).select("id", "_first.*").select(*batch.columns).persist()
        try:
            fresh = first
            for table in (task_table(spark, known_path), added):
                if table.version() is not None:
                    fresh = fresh.join(table.holding(first, F.col("id")).select("id"), "id", "left_anti")
            added.append(fresh.select(*batch.columns), epoch)
            added.compact(lambda rows: rows)
        finally:
            first.unpersist()
    return body


def outbox_batch(batch: DataFrame, epoch: int, out: str) -> None:
    """``foreachBatch`` body for T6: rows of events that no earlier epoch wrote, each once."""
    sent = event_table(batch.sparkSession, out)
    if sent.applied(epoch):
        return
    fresh = batch.dropDuplicates(["event_id", "attempt"]).persist()
    try:
        new = fresh
        if sent.version() is not None:
            new = fresh.join(sent.holding(fresh, F.lpad(F.col("event_id").cast("string"), 20, "0")).select("event_id").distinct(), "event_id", "left_anti")
        sent.append(new.select(*batch.columns), epoch)
        sent.compact(lambda rows: rows)
    finally:
        fresh.unpersist()


def _latest(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "updated_at", "event_id"), F.struct("updated_at", "event_id"))
    return rows.groupBy("task_id").agg(last.alias("l")).select("task_id", "l.status", "l.updated_at", "l.event_id")


def snapshot_merge_batch(batch: DataFrame, epoch: int, out: str) -> None:
    """``foreachBatch`` body for T2: add a batch of status events to the stored snapshot.

    Each epoch appends the latest row by ``(updated_at, event_id)`` of the tasks in its batch (an
    aggregate with map-side combine), so it writes what the batch holds and not the table; ``compact`` folds small runs.
    Versions that are being read stay; those before the newest few are removed.
    """
    state = KeyedTable(batch.sparkSession, out, "task_id")
    if state.applied(epoch):
        return
    state.append(_latest(batch.select("task_id", "status", "updated_at", "event_id")), epoch)
    state.compact(_latest)
    state.vacuum(KEPT_VERSIONS)


#: versions of the snapshot that stay readable beside the newest
KEPT_VERSIONS = 4


def latest_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of every task."""
    return _latest(KeyedTable(spark, out, "task_id").read())


# ---- failure windows with a side table of late events --------------------------

#: length of a window and the delay after which it closes, in seconds
WINDOW_S, DELAY_S = 86_400, 600


def status_events(events: DataFrame) -> DataFrame:
    """Status events as a stateless stream for ``failure_windows_batch``."""
    return events.where(F.col("event").isin(K.TASK_STATUSES)).select("event_id", "task_id", "event", "ts")


def window_tables(spark: SparkSession, out: str) -> tuple[KeyedTable, KeyedTable, KeyedTable]:
    """(counts by window start, late events by event id, newest event time and numbers of rows by epoch) that ``failure_windows_batch`` keeps at ``out``."""
    return KeyedTable(spark, f"{out}/windows", F.lpad(F.col("start_us").cast("string"), 20, "0")), event_table(spark, f"{out}/late"), KeyedTable(spark, f"{out}/marks", F.lit(""))


_COUNTS = ["n_events", "n_failed", "n_completed"]


def _window_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("start_us").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def _mark_sums(marks: DataFrame) -> DataFrame:
    return marks.agg(F.max("epoch").alias("epoch"), F.max("max_us").alias("max_us"), F.sum("n_rows").alias("n_rows"), F.sum("n_late").alias("n_late"))


def failure_windows_batch(window_s: int = WINDOW_S, delay_s: int = DELAY_S):
    """``foreachBatch`` body for T4 that loses no row: counts per window are added up, late events go to a table of their own.

    An event is late if its window had closed before its batch, by the newest event time of the batches before
    (the rule by which the watermarked stream drops it), or if it has no time.  So the events of the windows
    and the late ones are together the input.  The newest time is kept by epoch: a repeated batch decides as the first time.
    """
    step = window_s * 1_000_000

    def body(batch: DataFrame, epoch: int, out: str) -> None:
        windows, late, marks = window_tables(batch.sparkSession, out)
        if marks.applied(epoch):
            return
        newest = None if marks.version() is None else _mark_sums(marks.read()).first().max_us
        bound = -(2 ** 62) if newest is None else newest - delay_s * 1_000_000
        start = F.floor(F.unix_micros("ts") / F.lit(step)) * step
        rows = (batch.withColumn("start_us", start).withColumn("is_late", F.col("ts").isNull() | (F.col("start_us") + step <= F.lit(bound))).persist())
        try:
            if not late.applied(epoch):
                late.append(rows.where("is_late").select("event_id", "task_id", "event", "ts", F.lit(epoch).cast("long").alias("epoch")), epoch)
            if not windows.applied(epoch):
                each = {"n_events": F.lit(True), "n_failed": F.col("event") == "failed", "n_completed": F.col("event") == "completed"}
                windows.append(rows.where("not is_late").groupBy("start_us").agg(*(F.count_if(x).alias(c) for c, x in each.items())), epoch)
            marks.append(rows.agg(F.lit(epoch).cast("long").alias("epoch"), F.max(F.unix_micros("ts")).alias("max_us"), F.count(F.lit(1)).alias("n_rows"),
                                  F.count_if("is_late").alias("n_late")), epoch)
            for table, fold in ((windows, _window_sums), (late, lambda x: x), (marks, _mark_sums)):
                table.compact(fold)
        finally:
            rows.unpersist()
    return body


def failure_windows(spark: SparkSession, out: str, window_s: int = WINDOW_S, delay_s: int = DELAY_S, threshold: float = 0.2) -> DataFrame:
    """All windows kept at ``out``, with ``closed``: later events of the window are late."""
    windows, _, marks = window_tables(spark, out)
    newest = _mark_sums(marks.read()).first().max_us
    bound = -(2 ** 62) if newest is None else newest - delay_s * 1_000_000
    end = F.col("start_us") + window_s * 1_000_000
    return (_window_sums(windows.read())
            .select(F.timestamp_micros("start_us").alias("window_start"), F.timestamp_micros(end).alias("window_end"), *_COUNTS,
                    F.round(F.col("n_failed") / F.col("n_events"), 6).alias("failure_rate"), (end <= F.lit(bound)).alias("closed"))
            .withColumn("alert", F.col("failure_rate") > threshold))


def late_events(spark: SparkSession, out: str) -> DataFrame:
    """The late events kept at ``out``, with the epoch that brought them."""
    return window_tables(spark, out)[1].read()


# ---- timeout decisions from kept attempts ------------------------------------

_DAY_S = 86_400


def _day(ts: str):
    return F.floor(F.unix_seconds(ts) / _DAY_S)


def _task_day(task: str = "task_id", day: str = "day"):
    """Key of one task's starts on one day."""
    return F.concat_ws("/", F.col(task), F.lpad(F.col(day).cast("string"), 8, "0"))


def attempt_starts(events: DataFrame) -> DataFrame:
    """``processing`` events as a stateless stream for ``attempt_starts_batch``."""
    return events.where(F.col("event") == "processing").select("task_id", "event_id", "ts")


def attempt_tables(spark: SparkSession, out: str) -> tuple[KeyedTable, KeyedTable]:
    """(starts by task and day, number of starts of each task on each day by task) that ``attempt_starts_batch`` keeps at ``out``."""
    return KeyedTable(spark, f"{out}/starts", _task_day()), KeyedTable(spark, f"{out}/counts", "task_id")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("task_id", "day").agg(F.sum("n").alias("n"))


def attempt_starts_batch(batch: DataFrame, epoch: int, out: str) -> None:
    """``foreachBatch`` body that keeps attempts: appends a batch's starts, and adds its counts per task and day."""
    starts, counts = attempt_tables(batch.sparkSession, out)
    rows = batch.withColumn("day", _day("ts")).select("task_id", "day", "event_id", "ts")
    if not starts.applied(epoch):
        starts.append(rows, epoch)
        starts.compact(lambda x: x)
    if not counts.applied(epoch):
        counts.append(rows.groupBy("task_id", "day").agg(F.count(F.lit(1)).alias("n")), epoch)
        counts.compact(_summed)


def kept_attempts(timeouts: DataFrame, out: str) -> DataFrame:
    """task_id, event_id, attempt of the timeouts' starts: the kept counts of the task's earlier days plus the place
    within its own day.  Reads only parts that may hold these tasks, and of starts only those days; a day with very
    many starts of one task is numbered by the segmented scan."""
    from reelcat.operators.scan import running

    starts, counts = attempt_tables(timeouts.sparkSession, out)
    asked = timeouts.select("task_id", _day("started_at").alias("day")).distinct().persist()
    before = (_summed(counts.holding(asked, F.col("task_id"))).select(F.col("task_id").alias("_t"), F.col("day").alias("_d"), "n")
              .join(asked, (F.col("_t") == F.col("task_id")) & (F.col("_d") < F.col("day")))
              .groupBy("task_id", "day").agg(F.sum("n").alias("_before")))
    own = starts.holding(asked, _task_day()).join(asked, ["task_id", "day"], "left_semi")
    numbered = running(own.select("task_id", "day", "ts", "event_id"), ["task_id", "day"], ["ts", "event_id"], sums={"_place": F.lit(1).cast("bigint")})
    return (numbered.join(before, ["task_id", "day"], "left")
            .select("task_id", "event_id", (F.coalesce("_before", F.lit(0)) + F.col("_place")).cast("bigint").alias("attempt")))


def timeout_decisions_batch(attempts: str, max_retries: int = K.MAX_RETRIES):
    """``foreachBatch`` body for T3's decision step: requeue or fail each timeout.

    ``attempts`` is the folder that ``attempt_starts_batch`` keeps (its stream must have read the starts of these timeouts, which are emitted at
    least the time limit after them).  Each timeout gets ``attempt``,
    ``retry`` and ``next_status`` (a timeout is a retryable TIMEOUT error, so
    it is requeued while the attempt number is below ``max_retries``).
    """
    def body(batch: DataFrame, epoch: int, out: str) -> None:
        decided = event_table(batch.sparkSession, out)
        if decided.applied(epoch):
            return
        rows = batch.persist()
        try:
            retry = F.col("attempt") < max_retries
            decided.append(rows.join(kept_attempts(rows, attempts).drop("task_id"), "event_id")
                           .select("task_id", "event_id", "started_at", "deadline", "attempt", retry.alias("retry"),
                                   F.when(retry, F.lit("queued")).otherwise(F.lit("failed")).alias("next_status")), epoch)
        finally:
            rows.unpersist()
    return body
