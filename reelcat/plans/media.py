"""Registered media queries (formats, best format, info records, JSON round trip, policy)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat import schemas as S
from reelcat.operators import media as M
from reelcat.plans.oracle_views import sql_file_ext, with_views
from reelcat.sources import fixtures as X
from reelcat.sources import media as SM


def q_media_formats(spark: SparkSession, sf: str) -> DataFrame:
    return M.flat_formats(M.video_formats_nested(SM.media_records(spark, sf)))


def q_media_best_format(spark: SparkSession, sf: str) -> DataFrame:
    docs = M.best_format_nested(M.video_formats_nested(SM.media_records(spark, sf)))
    return docs.select("id", *[F.col(f"best_format.{c}").alias(c) for c in ("format_id", "height", "filesize", "vcodec")])


def q_media_info(spark: SparkSession, sf: str) -> DataFrame:
    lines = SM.media_json_lines(SM.media_records(spark, sf))
    return M.media_info(M.parse_media_json(lines))


def q_media_info_files(spark: SparkSession, sf: str) -> DataFrame:
    path = SM.write_media_json(SM.media_records(spark, sf), SM.scratch_path(spark, "media-info"))
    back = SM.read_media_json(spark, path)
    return back.select(*S.SCALAR_NAMES, F.size("formats").cast("bigint").alias("n_formats"),
                       "file_size", "file_extension", F.col("_corrupt_record").isNotNull().alias("corrupt"))


def q_media_policy(spark: SparkSession, sf: str) -> DataFrame:
    return M.media_policy(X.files(spark, sf).where(F.col("file_type") == "video"))


QUERIES = {
    "video_formats": lambda s, sf: M.video_formats(X.formats(s, sf)),
    "best_format": lambda s, sf: M.best_format(X.formats(s, sf)),
    "media_formats": q_media_formats,
    "media_best_format": q_media_best_format,
    "media_info": q_media_info,
    "media_info_files": q_media_info_files,
    "media_policy": q_media_policy,
}


# --- oracle -------------------------------------------------------------------

_FM = """fm AS (
 SELECT 'v' || cast(o_orderkey as varchar) AS id, 0 AS pos0, cast(o_orderkey as varchar) || '-360' AS format_id,
  'mp4' AS ext, 640::INTEGER AS width, 360::INTEGER AS height, cast(floor(o_totalprice) as bigint) * 10 AS filesize,
  'avc1' AS vcodec, 'mp4a' AS acodec FROM orders
 UNION ALL
 SELECT 'v' || cast(o_orderkey as varchar), 1, cast(o_orderkey as varchar) || '-1080', 'webm', 1920::INTEGER,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1080 END::INTEGER, cast(floor(o_totalprice) as bigint) * 40,
  CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'vp9' END, NULL FROM orders
 UNION ALL
 SELECT 'v' || cast(o_orderkey as varchar), 2, cast(o_orderkey as varchar) || '-a', 'm4a', NULL::INTEGER, NULL::INTEGER,
  cast(floor(o_totalprice) as bigint), 'none', 'mp4a' FROM orders
 UNION ALL
 SELECT 'v' || cast(o_orderkey as varchar), 3, cast(o_orderkey as varchar) || '-720', 'mp4', 1280::INTEGER, 720::INTEGER,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE cast(floor(o_totalprice) as bigint) * 20 END, NULL, 'mp4a' FROM orders),
kept AS (SELECT * FROM fm WHERE vcodec IS DISTINCT FROM 'none')"""

_SCALARS = """'v' || cast(o_orderkey as varchar) AS id, 'Order video ' || cast(o_orderkey as varchar) AS title,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS description, o_totalprice / 100 AS duration,
 'uploader' || cast(o_custkey as varchar) AS uploader, strftime(o_orderdate, '%Y%m%d') AS upload_date,
 o_orderkey * 37 % 100000 AS view_count, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS like_count,
 'https://img.example.com/' || cast(o_orderkey as varchar) || '.jpg' AS thumbnail,
 'https://www.youtube.com/watch?v=V' || cast(o_orderkey as varchar) AS webpage_url,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'youtube' END AS extractor"""

_BEST_FLAT = """SELECT video_id, format_id, height, filesize, vcodec FROM (
 SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY coalesce(height, 0) <= 720 DESC, coalesce(height, 0) DESC,
   coalesce(filesize, 0) DESC, format_id) AS rn
 FROM formats WHERE vcodec IS DISTINCT FROM 'none') WHERE rn = 1"""

ORACLE = {
    "video_formats": with_views(["formats"], "SELECT * FROM formats WHERE vcodec IS DISTINCT FROM 'none'"),
    "best_format": with_views(["formats"], _BEST_FLAT),
    "media_formats": f"""WITH {_FM}
SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos0) - 1 AS pos, format_id, ext, width, height, filesize,
 vcodec, acodec FROM kept""",
    "media_best_format": f"""WITH {_FM}
SELECT id, format_id, height, filesize, vcodec FROM (
 SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(height, 0) <= 720 DESC, coalesce(height, 0) DESC,
   coalesce(filesize, 0) DESC, pos0) AS rn FROM kept) WHERE rn = 1""",
    "media_info": f"SELECT {_SCALARS}, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d')::DATE AS upload_day FROM orders",
    "media_info_files": f"""SELECT {_SCALARS}, 4::BIGINT AS n_formats,
 CASE WHEN o_orderstatus = 'F' THEN cast(floor(o_totalprice) as bigint) * 1000 END AS file_size,
 CASE WHEN o_orderstatus = 'F' THEN 'mp4' END AS file_extension, false AS corrupt FROM orders""",
    "media_policy": with_views(["files"], f"""
SELECT key, size, regexp_replace({sql_file_ext('key')}, '^\\.', '') AS ext,
 CASE WHEN coalesce(size > 1073741824, false) AND regexp_replace({sql_file_ext('key')}, '^\\.', '') NOT IN ('mp4','avi','mov','wmv','flv','webm','mkv')
      THEN 'file_too_large,format_not_allowed'
      WHEN coalesce(size > 1073741824, false) THEN 'file_too_large'
      WHEN regexp_replace({sql_file_ext('key')}, '^\\.', '') NOT IN ('mp4','avi','mov','wmv','flv','webm','mkv')
      THEN 'format_not_allowed' END AS violation
FROM files WHERE file_type = 'video'"""),
}
