"""Registered URL-identity queries (validation, ids, matching, submission, dedupe)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelcat.operators import identity as I
from reelcat.plans.oracle_views import (
    sql_domain, sql_hash, sql_norm, sql_parts, sql_processing_id, sql_url_match, sql_video_id, with_views,
)
from reelcat.sources import fixtures as X
from reelcat.sources.tables import read_table

MIN_PARTS = 5


def tasks_with_result(tasks: DataFrame) -> DataFrame:
    """Tasks with their stored ``result`` JSON: the id mapping while the task is
    not completed; on completion the mapping is overwritten by a result
    document without ``base_id``."""
    mapping = I.id_mapping_json("base_id", "video_url")
    done = F.to_json(F.struct(F.lit(True).alias("success"), F.col("id").alias("processing_id")))
    return tasks.withColumn("result", F.when(F.col("status") == "completed", done).otherwise(mapping))


def lookup_ids(subs: DataFrame) -> DataFrame:
    """Task ids a batch of submissions would create (to ask which already exist)."""
    return I.composite_ids(subs).select("id")


QUERIES = {
    "validate_submissions": lambda s, sf: I.validate_submissions(X.submissions(s, sf)),
    "composite_ids": lambda s, sf: I.composite_ids(X.submissions(s, sf)),
    "parse_task_ids": lambda s, sf: I.parse_task_ids(X.tasks(s, sf), MIN_PARTS),
    "validate_task_ids": lambda s, sf: I.validate_task_ids(X.tasks(s, sf), MIN_PARTS),
    "original_ids": lambda s, sf: I.original_ids(tasks_with_result(X.tasks(s, sf)), MIN_PARTS),
    "video_ids": lambda s, sf: I.video_ids(X.tasks(s, sf), "video_url", "id"),
    "url_domains": lambda s, sf: I.url_domains(read_table(s, sf, "pages"), "url", "page_id"),
    "url_match": lambda s, sf: I.url_matches(X.tasks(s, sf)),
    "url_platform": lambda s, sf: I.url_platform(X.tasks(s, sf), "video_url"),
    "submit_tasks": lambda s, sf: I.submit_tasks(X.submissions(s, sf)),
    "dedupe_submissions": lambda s, sf: I.dedupe_submissions(X.submissions(s, sf), X.tasks(s, sf))[0],
    "dedupe_rejected": lambda s, sf: I.dedupe_submissions(X.submissions(s, sf), X.tasks(s, sf))[1],
    "duplicate_urls": lambda s, sf: I.duplicate_urls(X.tasks(s, sf)),
    "task_lookup": lambda s, sf: I.task_lookup(lookup_ids(X.submissions(s, sf)), tasks_with_result(X.tasks(s, sf))),
}


# --- oracle -------------------------------------------------------------------

_SCHEME = "(starts_with(url, 'http://') OR starts_with(url, 'https://'))"
_QUEUED = f"""queued AS (
 SELECT base_id || '-' || {sql_hash('url')} AS id, base_id, url AS video_url, {sql_hash('url')} AS url_hash,
  submitted_at AS created_at
 FROM submissions WHERE base_id IS NOT NULL AND url IS NOT NULL)"""
_FIRST = """firstq AS (
 SELECT id, (min(struct_pack(ca := created_at, u := video_url, b := base_id))).b AS base_id,
  (min(struct_pack(ca := created_at, u := video_url, b := base_id))).u AS video_url,
  min(created_at) AS created_at, count(*) AS n_submitted
 FROM queued GROUP BY id),
flagged AS (SELECT f.*, f.id IN (SELECT id FROM tasks) AS already_exists FROM firstq f)"""

ORACLE = {
    "validate_submissions": with_views(["submissions"], f"""
SELECT base_id, url, submitted_at,
 CASE WHEN base_id IS NULL OR url IS NULL THEN 'url_and_id_required'
      WHEN NOT {_SCHEME} THEN 'invalid_url_format' END AS reason,
 NOT (base_id IS NULL OR url IS NULL) AND {_SCHEME} AS accepted
FROM submissions"""),
    "composite_ids": with_views(["submissions"], f"""
SELECT base_id, url, submitted_at, {sql_hash('url')} AS url_hash, base_id || '-' || {sql_hash('url')} AS id
FROM submissions"""),
    "parse_task_ids": with_views(["tasks"], f"""
SELECT id, {sql_parts('id')} AS n_parts, {sql_parts('id')} >= {MIN_PARTS} AS is_composite,
 {sql_processing_id('id', MIN_PARTS)} AS processing_id
FROM tasks"""),
    "validate_task_ids": with_views(["tasks"], f"""
SELECT id, video_url,
 CASE WHEN {sql_parts('id')} < {MIN_PARTS} THEN true
      ELSE coalesce(string_split(id, '-')[-1] = {sql_hash('video_url')}, false) END AS valid
FROM tasks"""),
    "original_ids": with_views(["tasks"], f"""
WITH r AS (SELECT id, CASE WHEN status = 'completed' THEN NULL ELSE base_id END AS stored FROM tasks)
SELECT id, CASE WHEN {sql_parts('id')} >= {MIN_PARTS} THEN coalesce(stored, {sql_processing_id('id', MIN_PARTS)})
  ELSE id END AS original_id, stored IS NOT NULL AS from_result
FROM r"""),
    "video_ids": with_views(["tasks"], f"""
SELECT id, video_url, {sql_video_id(sql_norm('video_url'))} AS video_id FROM tasks"""),
    "url_domains": f"SELECT page_id, url, {sql_domain('url')} AS domain FROM pages",
    "url_match": with_views(["tasks"], f"""
SELECT id, video_url, processed_url, {sql_url_match('video_url', 'processed_url')} AS url_match FROM tasks"""),
    "url_platform": with_views(["tasks"], """
SELECT coalesce(contains(lower(video_url), 'youtube.com') OR contains(lower(video_url), 'youtu.be'), false) AS is_youtube,
 count(*) AS n_urls
FROM tasks GROUP BY 1"""),
    "submit_tasks": with_views(["submissions"], f"""
SELECT base_id || '-' || {sql_hash('url')} AS id, base_id, url AS video_url, {sql_hash('url')} AS url_hash,
 'queued' AS status, CAST(NULL AS VARCHAR) AS webhook_url,
 json_object('composite_id', base_id || '-' || {sql_hash('url')}, 'base_id', base_id,
             'url_hash', {sql_hash('url')}, 'video_url', url)::VARCHAR AS result,
 submitted_at AS created_at, submitted_at AS updated_at
FROM submissions WHERE base_id IS NOT NULL AND url IS NOT NULL"""),
    "dedupe_submissions": with_views(["submissions", "tasks"], f"""WITH {_QUEUED}, {_FIRST}
SELECT id, base_id, video_url, created_at, n_submitted FROM flagged WHERE NOT already_exists"""),
    "dedupe_rejected": with_views(["submissions", "tasks"], f"""WITH {_QUEUED}, {_FIRST}
SELECT id, base_id, video_url, created_at, n_submitted - 1 AS n_repeats, already_exists
FROM flagged WHERE already_exists OR n_submitted > 1"""),
    "duplicate_urls": with_views(["tasks"], f"""
SELECT {sql_hash('video_url')} AS url_hash, count(*) AS n_tasks, min(created_at) AS first_created_at,
 max(created_at) AS last_created_at
FROM tasks GROUP BY 1 HAVING count(*) > 1"""),
    "task_lookup": with_views(["submissions", "tasks"], f"""
WITH ids AS (SELECT DISTINCT base_id || '-' || {sql_hash('url')} AS id FROM submissions
             WHERE base_id || '-' || {sql_hash('url')} IS NOT NULL),
 tr AS (SELECT *, CASE WHEN status = 'completed' THEN json_object('success', true, 'processing_id', id)
                  ELSE json_object('composite_id', base_id || '-' || {sql_hash('video_url')}, 'base_id', base_id,
                                   'url_hash', {sql_hash('video_url')}, 'video_url', video_url) END::VARCHAR AS result
        FROM tasks)
SELECT ids.id, t.status, t.result, t.error_message AS error_details, t.created_at, t.updated_at,
 t.id IS NOT NULL AS found
FROM ids LEFT JOIN tr t ON ids.id = t.id"""),
}
