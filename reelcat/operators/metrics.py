"""Operational metrics and reports: supported sites, status summary, processing
time, timeouts, warnings, result documents, log analysis, chunk manifests,
webhook outbox and failure-rate windows.

Scale notes
-----------
* All metrics are grouped aggregates with map-side combine; conditional
  counts are ``sum(cast(cond))`` so they stay in the hash aggregate.
* Warning lists per task hold each distinct warning once.
* Percentiles: exact ones are computed by rank over a range-partitioned sort
  (no group's values are held in one task); ``percentile_approx`` is the
  one-pass bounded-sketch alternative.
* Fan-outs (webhook retry schedule, stage deadlines, chunk offsets) explode a
  bounded array per row; no joins are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat import schemas as S
from reelcat.functions import objects as O
from reelcat.functions import urls as U
from reelcat.operators.lifecycle import seconds_between, task_error_text


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 6)


def supported_sites(urls: DataFrame, url_col: str = "url", shown: int = K.SUPPORTED_SITES_SHOWN) -> DataFrame:
    """Distinct site names (URL domains): the first ``shown`` in name order, with the total count."""
    sites = urls.select(U.domain(url_col).alias("site")).distinct()
    total = sites.select(F.count(F.lit(1))).scalar()
    return sites.orderBy("site").limit(shown).withColumn("total_count", total)


def status_summary(tasks: DataFrame) -> DataFrame:
    """Tasks per status with their share of all tasks."""
    total = tasks.select(F.count(F.lit(1))).scalar()
    return (tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n_tasks"))
            .withColumn("share", _share(F.col("n_tasks"), total)))


def completion_rates(tasks: DataFrame) -> DataFrame:
    """One row: completion and failure rates over all tasks and over terminal tasks."""
    n = F.count(F.lit(1))
    done = F.sum((F.col("status") == "completed").cast("bigint"))
    failed = F.sum((F.col("status") == "failed").cast("bigint"))
    return tasks.agg(n.alias("n_tasks"), done.alias("n_completed"), failed.alias("n_failed")).select(
        "n_tasks", "n_completed", "n_failed",
        _share(F.col("n_completed"), F.col("n_tasks")).alias("completion_rate"),
        _share(F.col("n_failed"), F.col("n_tasks")).alias("failure_rate"),
        _share(F.col("n_completed"), F.col("n_completed") + F.col("n_failed")).alias("terminal_success_rate"))


def processing_time(tasks: DataFrame, exact: bool = True) -> DataFrame:
    """Processing time (updated_at - created_at, seconds) of terminal tasks per status.

    ``exact=True`` ranks the durations (``scan.exact_percentiles``), so no
    status's values are ever held in one task; ``exact=False`` uses
    ``percentile_approx`` (bounded sketch, one pass).
    """
    term = (tasks.where(F.col("status").isin(K.TERMINAL_STATUSES))
            .withColumn("secs", seconds_between(F.col("created_at"), F.col("updated_at"))))
    base = (term.groupBy("status")
            .agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("secs"), 6).alias("avg_s"),
                 F.max("secs").alias("max_s")))
    if exact:
        from reelcat.operators.scan import exact_percentiles
        pct = exact_percentiles(term, ["status"], "secs", "id", {"p50_s": 0.5, "p95_s": 0.95})
    else:
        pct = term.groupBy("status").agg(F.percentile_approx("secs", 0.5).alias("p50_s"),
                                          F.percentile_approx("secs", 0.95).alias("p95_s"))
    return (base.join(pct, "status")
            .select("status", "n_tasks", "avg_s", F.round("p50_s", 6).alias("p50_s"),
                    F.round("p95_s", 6).alias("p95_s"), "max_s"))


def is_timeout(tasks: DataFrame) -> Column:
    """A failure counts as a timeout when its code is TIMEOUT or its text mentions a timeout."""
    low = F.lower(task_error_text(tasks))
    return (F.coalesce(F.col("error_code") == "TIMEOUT", F.lit(False))
            | F.coalesce(low.contains("timeout") | low.contains("timed out"), F.lit(False)))


def timeout_counts(tasks: DataFrame) -> DataFrame:
    """Failed tasks and timeouts among them, per day of the failure."""
    failed = tasks.where(F.col("status") == "failed")
    return (failed.groupBy(F.date_trunc("day", "updated_at").cast("timestamp_ntz").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_failed"),
                 F.sum(is_timeout(failed).cast("bigint")).alias("n_timeouts")))


def timeout_stage_counts(parsed: DataFrame) -> DataFrame:
    """Timeouts in a parsed log per day and stage: the last stage the task had logged before
    (null when it had logged none).

    Each task's stage lines are numbered by the segmented scan; a timeout then joins the
    one stage line with the number reached so far, so a task's lines are never held in one task.
    """
    from reelcat.operators.scan import running
    lines = parsed.where(F.col("stage").isNotNull() | (F.col("pattern") == "timeout"))
    seen = running(lines.select("task_tag", "logged_at", "event_id", "stage", "pattern"), ["task_tag"], ["logged_at", "event_id"],
                   sums={"n_stages": F.col("stage").isNotNull().cast("bigint")})
    stages = seen.where(F.col("stage").isNotNull()).select(F.col("task_tag").alias("_tag"), F.col("n_stages").alias("_n"), F.col("stage").alias("_stage"))
    late = seen.where(F.col("pattern") == "timeout").select("task_tag", "n_stages", "logged_at")
    hit = F.col("task_tag").eqNullSafe(F.col("_tag")) & (F.col("n_stages") == F.col("_n"))
    return (late.join(stages, hit, "left")
            .groupBy(F.date_trunc("day", "logged_at").cast("timestamp_ntz").alias("day"), F.col("_stage").alias("stage"))
            .agg(F.count(F.lit(1)).alias("n_timeouts")))


def warning_counts(warnings: DataFrame) -> DataFrame:
    """Histogram of warnings: tasks per warning."""
    return warnings.groupBy("warning").agg(F.countDistinct("id").alias("n_tasks"))


def warning_flags(warnings: DataFrame) -> DataFrame:
    """Per task: its distinct warnings (known ones in vocabulary order, then any others
    by name) and ``partial_success``.  A task's list is bounded by the warnings there are."""
    known = F.array(*[F.lit(w) for w in K.WARNINGS])
    own = F.col("_own")
    arr = F.concat(F.filter(known, lambda w: F.array_contains(own, w)), F.array_sort(F.array_except(own, known)))
    partial = F.arrays_overlap("warnings", F.array(*[F.lit(w) for w in K.PARTIAL_WARNINGS]))
    return (warnings.groupBy("id").agg(F.collect_set("warning").alias("_own"))
            .select("id", arr.alias("warnings"))
            .withColumn("partial_success", partial))


def partial_share(tasks: DataFrame, warnings: DataFrame) -> DataFrame:
    """Share of completed tasks whose result is partial (a failed optional upload)."""
    done = tasks.where(F.col("status") == "completed").select("id")
    flags = warning_flags(warnings).select("id", "partial_success")
    j = done.join(flags, "id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_completed"),
                 F.sum(F.coalesce(F.col("partial_success"), F.lit(False)).cast("bigint")).alias("n_partial")
                 ).withColumn("partial_share", _share(F.col("n_partial"), F.col("n_completed")))


def result_documents(tasks: DataFrame, slots: DataFrame, warnings: DataFrame, videos: DataFrame | None = None,
                     min_parts: int = 5) -> DataFrame:
    """Assemble the result document of each terminal task.

    ``slots`` has one row per task ``processing_id`` with ``{video,metadata,thumbnail}_{key,url,size}``
    (see ``catalog.video_details``); ``videos`` has ``id`` and the info ``record`` (``schemas.MEDIA_INFO``).
    Completed tasks get the success form, failed tasks the failure form.

    A document whose video has the direct path's file name (it starts with the task id) is the direct
    form: ``direct_processing`` is true, its record has the formats instead of the file fields, and
    ``storage`` names only what was stored.  Other missing members are written as null.  The
    original id follows ``identity.original_ids`` (the stored ``base_id`` if ``tasks`` has ``result``).
    Returns flat columns plus ``document`` (JSON).
    """
    term = tasks.where(F.col("status").isin(K.TERMINAL_STATUSES))
    flags = warning_flags(warnings)
    s = slots.select(F.col("processing_id").alias("id"),
                     *[F.col(f"{t}_{f}").alias(f"s_{t}_{f}") for t in K.FILE_TYPES for f in ("key", "url", "size")])
    j = term.join(s, "id", "left").join(flags, "id", "left")
    if videos is None:
        j = j.withColumn("_video", F.lit(None).cast(S.MEDIA_INFO))
    else:
        j = j.join(videos.select("id", F.col("record").cast(S.MEDIA_INFO).alias("_video")), "id", "left")
    ok = F.col("status") == "completed"
    direct = F.coalesce(O.base_name("s_video_key").startswith(F.concat("id", F.lit("_"))), F.lit(False))
    stored = F.get_json_object("result", "$.base_id") if "result" in tasks.columns else F.lit(None).cast("string")
    own = F.when(U.is_composite("id", min_parts), F.coalesce(stored, U.processing_id("id", min_parts))).otherwise(F.col("id"))

    def slot(t: str) -> Column:
        return F.when(F.col(f"s_{t}_key").isNotNull(),
                      F.struct(F.col(f"s_{t}_key").alias("key"), F.col(f"s_{t}_url").alias("url"),
                               F.col(f"s_{t}_size").alias("size")))

    def record(*extra: str) -> Column:
        return F.when(F.col("_video").isNotNull(), F.struct(*[F.col("_video")[f].alias(f) for f in (*S.SCALAR_NAMES, *extra)]))

    warns = F.coalesce(F.col("warnings"), F.array().cast("array<string>"))
    partial = F.coalesce(F.col("partial_success"), F.lit(False))
    match = U.url_match("video_url", "processed_url")
    err = F.when(F.col("error_code") == "TIMEOUT", F.lit(K.FAILURE_TIMEOUT)).otherwise(F.lit(K.FAILURE_OTHER))
    details = task_error_text(term)
    # missing members are written as null, as the service's JSON documents do
    keep_nulls = {"ignoreNullFields": "false"}
    storage = F.create_map(*[x for t in K.FILE_TYPES for x in (F.lit(t), slot(t))])

    def success(video: Column, objects: Column, *more: Column) -> Column:
        return F.to_json(F.struct(
            F.lit(True).alias("success"), F.col("id").alias("processing_id"), own.alias("original_id"),
            F.col("video_url").alias("original_url"), F.col("processed_url").alias("processed_url"),
            match.alias("url_match"), video.alias("video_info"), objects.alias("storage"),
            warns.alias("warnings"), partial.alias("partial_success"), *more), keep_nulls)

    failure_doc = F.to_json(F.struct(
        F.lit(False).alias("success"), F.col("id").alias("processing_id"), err.alias("error"),
        details.alias("error_details")), keep_nulls)
    direct_doc = success(record("formats"), F.map_filter(storage, lambda _, o: o.isNotNull()), F.lit(True).alias("direct_processing"))
    return j.select(
        "id", ok.alias("success"),
        F.when(ok, own).alias("original_id"),
        F.when(ok, match).alias("url_match"),
        F.when(ok, F.col("_video.title")).alias("video_title"),
        F.when(ok, F.col("s_video_key")).alias("video_key"),
        F.when(ok, F.col("s_metadata_key")).alias("metadata_key"),
        F.when(ok, F.col("s_thumbnail_key")).alias("thumbnail_key"),
        F.when(ok, F.size(warns)).cast("bigint").alias("n_warnings"),
        F.when(ok, partial).alias("partial_success"),
        F.when(ok, direct).alias("direct_processing"),
        F.when(~ok, err).alias("error"),
        F.when(~ok, failure_doc).when(direct, direct_doc)
        .otherwise(success(record("file_size", "file_extension"), storage)).alias("document"))


def webhook_outbox(docs: DataFrame, tasks: DataFrame, max_attempts: int = K.WEBHOOK_MAX_ATTEMPTS) -> DataFrame:
    """Delivery schedule for terminal tasks that have a webhook.

    Attempt ``a`` (1-based) is due ``2^(a-1) - 1`` seconds after the terminal
    update (the backoff waits 1 s, then 2 s): 0 s, 1 s, 3 s.
    ``authorized`` marks URLs that get a bearer token.
    """
    hooks = (tasks.where(F.col("status").isin(K.TERMINAL_STATUSES) & F.col("webhook_url").isNotNull())
             .select("id", "webhook_url", "updated_at"))
    j = hooks.join(docs.select("id", "document"), "id")
    att = F.explode(F.sequence(F.lit(1), F.lit(max_attempts))).alias("attempt")
    delay = F.pow(F.lit(2), F.col("attempt") - 1).cast("bigint") - 1
    return (j.select("id", "webhook_url", "updated_at", "document", att)
            .select("id", "webhook_url", F.col("attempt").cast("bigint").alias("attempt"),
                    delay.alias("delay_s"),
                    (F.col("updated_at") + F.make_dt_interval(secs=delay)).alias("send_after"),
                    F.col("webhook_url").contains(K.WEBHOOK_AUTH_MARKER).alias("authorized"),
                    F.col("document").alias("payload")))


def parse_log_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """Split log lines into time, logger, level and message; extract the task
    tag, the stage number and the first documented pattern that matches.

    A line outside the format has no time, logger, level or pattern and an empty message; a time that is no
    time of day, or a stage number beyond 64 bits, is null.  ``log_records`` puts such lines under the record they follow."""
    line = F.col(col)
    msg = F.regexp_extract(line, K.LOG_LINE_PATTERN, 4)
    pattern = F.lit(None).cast("string")
    for name, rx in reversed(K.LOG_WATCH_PATTERNS):
        pattern = F.when(msg.rlike(rx), F.lit(name)).otherwise(pattern)
    stage = F.nullif(F.regexp_extract(msg, K.LOG_STAGE_PATTERN, 1), F.lit(""))
    return lines.select(
        "event_id",
        F.replace(F.regexp_extract(line, K.LOG_LINE_PATTERN, 1), F.lit(","), F.lit(".")).try_cast("timestamp_ntz").alias("logged_at"),
        F.nullif(F.regexp_extract(line, K.LOG_LINE_PATTERN, 2), F.lit("")).alias("logger"),
        F.nullif(F.regexp_extract(line, K.LOG_LINE_PATTERN, 3), F.lit("")).alias("level"),
        msg.alias("message"),
        F.nullif(F.regexp_extract(msg, K.LOG_TASK_TAG_PATTERN, 1), F.lit("")).alias("task_tag"),
        stage.try_cast("bigint").alias("stage"),
        pattern.alias("pattern"))


def log_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, block (where the split begins that read them), at (rising within a split) and line."""
    read = spark.read.text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def log_records(lines: DataFrame) -> DataFrame:
    """One row per log record: the fields of its first line, and in ``trailing`` the lines that follow it without a header
    of their own (a traceback, a message of several lines), as one text; null if there are none.

    ``lines`` as of ``log_file_lines``.  A record may begin in one split of a file and end in the next: the segmented scan over
    (file, block, at) numbers the headers, so a line knows the last header before it wherever that was read.  Only places and
    trailing lines are exchanged; the lines with a header, most of a log, are parsed where they are.  Lines
    before a file's first header are a record without fields.
    """
    from reelcat.operators.scan import running

    header = F.coalesce(F.col("line").rlike(K.LOG_LINE_PATTERN), F.lit(False))
    places = lines.select("file", "block", "at", header.alias("_header"), F.when(~header, F.coalesce("line", F.lit(""))).alias("_text"))
    numbered = running(places, ["file"], ["block", "at"], sums={"_record": F.col("_header").cast("bigint")}, rn_col="_rn")
    text = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "_text"))), lambda x: x["_text"])
    trailing = (numbered.where(~F.col("_header")).groupBy("file", "_record").agg(F.concat_ws("\n", text).alias("trailing"))
                .select(F.col("file").alias("_f"), F.col("_record").alias("_r"), "trailing"))
    of_header = (numbered.where("_header").select("file", "at", "_record").join(trailing, (F.col("file") == F.col("_f")) & (F.col("_record") == F.col("_r")))
                 .select(F.col("at").alias("_at"), F.col("_f"), "trailing"))
    headed = lines.where(header).join(of_header, (F.col("at") == F.col("_at")) & (F.col("file") == F.col("_f")), "left")
    none = F.lit(None).cast("string")
    orphans = trailing.where("_r = 0").select(F.col("_f").alias("file"), none.alias("line"), "trailing")
    found = headed.select("file", "line", "trailing").unionByName(orphans).withColumn("event_id", F.struct("file", "trailing"))
    return parse_log_lines(found).select("event_id.*", "*").drop("event_id")


def log_pattern_counts(parsed: DataFrame) -> DataFrame:
    return (parsed.groupBy("pattern", "level")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.min("logged_at").alias("first_at"),
                 F.max("logged_at").alias("last_at")))


def chunk_manifest(payloads: DataFrame, key: str, size: Column, chunk: int) -> DataFrame:
    """Fixed-size chunks of each payload: index, offset and length; a zero-byte payload has none."""
    n = size.cast("bigint")
    offsets = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(chunk).cast("bigint")))
    return (payloads.select(key, n.alias("n_bytes"), F.posexplode(offsets).alias("chunk_index", "offset"))
            .select(key, "n_bytes", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                    F.col("offset").alias("offset"),
                    F.least(F.lit(chunk).cast("bigint"), F.col("n_bytes") - F.col("offset")).alias("length"),
                    F.ceil(F.col("n_bytes") / chunk).cast("bigint").alias("n_chunks")))


def failure_rate_windows(events: DataFrame, duration: str = "1 day", slide: str | None = None,
                         threshold: float = 0.2) -> DataFrame:
    """Failure rate of status events per tumbling (or sliding) time window, with an alert flag."""
    ev = events.where(F.col("event").isin(K.TASK_STATUSES))
    win = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    return (ev.groupBy(win.alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum((F.col("event") == "failed").cast("bigint")).alias("n_failed"),
                 F.sum((F.col("event") == "completed").cast("bigint")).alias("n_completed"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n_events", "n_failed", "n_completed",
                    _share(F.col("n_failed"), F.col("n_events")).alias("failure_rate"))
            .withColumn("alert", F.col("failure_rate") > threshold))


def progress_windows(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Bytes moved per task and time window, with throughput in KB/s (batch twin of the stream)."""
    secs = F.timestamp_diff("SECOND", F.col("w.start"), F.col("w.end"))
    return (events.where(F.col("event") == "progress")
            .groupBy(F.window("ts", window).alias("w"), "task_id")
            .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_chunks"))
            .select("task_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "bytes", "n_chunks", F.round(F.col("bytes") / secs / 1024, 6).alias("kbps")))


def event_outbox(events: DataFrame, max_attempts: int = K.WEBHOOK_MAX_ATTEMPTS) -> DataFrame:
    """One delivery row per attempt for each terminal event (batch twin of the stream outbox)."""
    # redelivered events are exact copies: a whole-row de-duplication (hash aggregate)
    term = events.where(F.col("event").isin(K.TERMINAL_STATUSES)).dropDuplicates()
    att = F.explode(F.sequence(F.lit(1), F.lit(max_attempts))).alias("attempt")
    delay = F.pow(F.lit(2), F.col("attempt") - 1).cast("bigint") - 1
    return (term.select("task_id", "event_id", "event", "ts", att)
            .select("task_id", "event_id", "event", F.col("attempt").cast("bigint").alias("attempt"),
                    delay.alias("delay_s"), (F.col("ts") + F.make_dt_interval(secs=delay)).alias("send_after")))
