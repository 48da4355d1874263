"""URL identity over tables: validation, composite ids, parsing, matching,
submission, de-duplication and duplicate detection.

Scale notes
-----------
* Everything row-level is a projection of built-in expressions (one
  whole-stage-codegen span, no Python).
* "Earliest submission per task id" is an aggregate (``min_by``) rather than a
  ``row_number`` window, so a task id that holds a third of all submissions is
  combined map-side instead of landing in one task.
* The existing-task check is an anti join on ``id``; AQE picks broadcast or
  sort-merge from runtime sizes and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelcat.functions import urls as U

REASON_MISSING = "url_and_id_required"
REASON_SCHEME = "invalid_url_format"


def validate_submissions(subs: DataFrame, check_scheme: bool = True) -> DataFrame:
    """Add ``accepted`` and ``reason``: id and url must be present, and (unless
    ``check_scheme`` is off, as on the queueing path) the url must start with
    ``http://`` or ``https://`` exactly."""
    missing = F.col("base_id").isNull() | F.col("url").isNull()
    reason = F.when(missing, F.lit(REASON_MISSING))
    if check_scheme:
        reason = reason.when(~U.has_http_scheme("url"), F.lit(REASON_SCHEME))
    return subs.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def composite_ids(subs: DataFrame) -> DataFrame:
    """Add ``url_hash`` and the composite task ``id`` to each submission."""
    return (subs.withColumn("url_hash", U.url_hash("url"))
            .withColumn("id", U.composite_id("base_id", "url")))


def parse_task_ids(tasks: DataFrame, min_parts: int = 5) -> DataFrame:
    return tasks.select(
        "id",
        U.id_parts("id").cast("bigint").alias("n_parts"),
        U.is_composite("id", min_parts).alias("is_composite"),
        U.processing_id("id", min_parts).alias("processing_id"))


def validate_task_ids(tasks: DataFrame, min_parts: int = 5) -> DataFrame:
    return tasks.select("id", "video_url", U.task_id_matches_url("id", "video_url", min_parts).alias("valid"))


def id_mapping_json(base_id, url) -> F.Column:
    """The JSON id mapping stored with a queued task."""
    return F.to_json(F.struct(
        U.composite_id(base_id, url).alias("composite_id"),
        F.col(base_id).alias("base_id") if isinstance(base_id, str) else base_id.alias("base_id"),
        U.url_hash(url).alias("url_hash"),
        F.col(url).alias("video_url") if isinstance(url, str) else url.alias("video_url")))


def original_ids(tasks: DataFrame, min_parts: int = 5) -> DataFrame:
    """Original (caller-supplied) id of each task.

    For composite ids the ``base_id`` stored in the ``result`` JSON wins; when
    absent (the mapping is overwritten on completion) the hash part is dropped.
    Non-composite ids are their own original id.
    """
    stored = F.get_json_object("result", "$.base_id")
    original = F.when(U.is_composite("id", min_parts),
                      F.coalesce(stored, U.processing_id("id", min_parts))).otherwise(F.col("id"))
    return tasks.select("id", original.alias("original_id"), stored.isNotNull().alias("from_result"))


def video_ids(df: DataFrame, url_col: str, key_col: str) -> DataFrame:
    """Video id of each (normalised) URL; null when no pattern matches."""
    return df.select(key_col, url_col, U.video_id(U.normalize_url(url_col)).alias("video_id"))


def url_domains(df: DataFrame, url_col: str, key_col: str) -> DataFrame:
    return df.select(key_col, url_col, U.domain(url_col).alias("domain"))


def url_matches(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", "video_url", "processed_url",
                        U.url_match("video_url", "processed_url").alias("url_match"))


def url_platform(df: DataFrame, url_col: str) -> DataFrame:
    """Counts of URLs that need the YouTube path (and the proxy) versus others."""
    return (df.groupBy(U.is_youtube(url_col).alias("is_youtube"))
            .agg(F.count(F.lit(1)).alias("n_urls")))


def submit_tasks(subs: DataFrame) -> DataFrame:
    """Queue accepted submissions as task rows (queueing path: presence check only)."""
    ok = validate_submissions(subs, check_scheme=False).where("accepted")
    return ok.select(
        U.composite_id("base_id", "url").alias("id"),
        F.col("base_id"),
        F.col("url").alias("video_url"),
        U.url_hash("url").alias("url_hash"),
        F.lit("queued").alias("status"),
        F.lit(None).cast("string").alias("webhook_url"),
        id_mapping_json("base_id", "url").alias("result"),
        F.col("submitted_at").alias("created_at"),
        F.col("submitted_at").alias("updated_at"))


def dedupe_submissions(subs: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New tasks from a submission batch, once per composite id.

    Returns ``(accepted, rejected)``.  Within the batch the earliest submission
    (ties by url) wins; a composite id that already exists in ``existing`` is
    rejected as the primary key would reject it.  ``rejected`` has one row per
    composite id that lost anything: ``n_repeats`` in-batch repeats and whether
    the id already existed (then its winner is rejected too).
    """
    queued = submit_tasks(subs)
    first = (queued.groupBy("id")
             .agg(F.min_by(F.struct("base_id", "video_url", "created_at"),
                           F.struct("created_at", "video_url")).alias("w"),
                  F.count(F.lit(1)).alias("n_submitted"))
             .select("id", "w.base_id", "w.video_url", "w.created_at",
                     F.col("n_submitted").cast("bigint").alias("n_submitted")))
    known = existing.select("id").distinct().withColumn("already_exists", F.lit(True))
    flagged = (first.join(known, "id", "left")
               .withColumn("already_exists", F.coalesce("already_exists", F.lit(False))))
    accepted = flagged.where(~F.col("already_exists")).drop("already_exists")
    rejected = (flagged.where(F.col("already_exists") | (F.col("n_submitted") > 1))
                .select("id", "base_id", "video_url", "created_at",
                        (F.col("n_submitted") - 1).alias("n_repeats"), "already_exists"))
    return accepted, rejected


def duplicate_urls(tasks: DataFrame) -> DataFrame:
    """Groups of tasks whose normalised URL hashes equal; only groups of two or more."""
    return (tasks.groupBy(U.url_hash("video_url").alias("url_hash"))
            .agg(F.count(F.lit(1)).alias("n_tasks"),
                 F.min("created_at").alias("first_created_at"),
                 F.max("created_at").alias("last_created_at"))
            .where(F.col("n_tasks") > 1))


def task_lookup(ids: DataFrame, tasks: DataFrame) -> DataFrame:
    """Look up many task ids at once: status, stored result, error details and
    times; missing ids are reported with ``found = false``."""
    cols = [F.col("id"), F.col("status"), F.col("result"), F.col("error_message").alias("error_details"),
            F.col("created_at"), F.col("updated_at")]
    return (ids.select("id").where(F.col("id").isNotNull()).distinct()
            .join(tasks.select(*cols).withColumn("found", F.lit(True)), "id", "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))
