"""Media formats and info records: video-format filter, best format, info
projection and the (declared) media policy.

Two shapes are supported:

* nested documents (one row per video, ``formats`` array) -- filtering and
  best-format choice are higher-order array functions evaluated per row, so
  they need no shuffle at all;
* flat format tables (one row per format) -- the best format per video is an
  aggregate (``min_by``) with a map-side combine, so a video with a huge
  number of formats never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat import schemas as S
from reelcat.functions import objects as O


def is_video_format(vcodec: Column) -> Column:
    """Formats whose vcodec is not exactly 'none' (a missing vcodec is kept)."""
    return ~vcodec.eqNullSafe(F.lit("none"))


def _rank_key(height: Column, filesize: Column) -> Column:
    """Sort key of the best-format rule: (height <= 720, height, filesize), missing values as 0."""
    h = F.coalesce(height, F.lit(0))
    return F.struct((h <= K.BEST_FORMAT_MAX_HEIGHT).alias("fits"), h.alias("h"),
                    F.coalesce(filesize, F.lit(0)).cast("bigint").alias("fs"))


# ---- nested documents -------------------------------------------------------

def video_formats_nested(docs: DataFrame, col: str = "formats") -> DataFrame:
    """Keep only video formats inside each document's ``formats`` array."""
    return docs.withColumn(col, F.filter(col, lambda f: is_video_format(f["vcodec"])))


def best_format_nested(docs: DataFrame, col: str = "formats") -> DataFrame:
    """Add ``best_format``: the first format by the best-format rule (earliest wins ties); null when empty."""
    empty = F.lit(None).cast(S.FORMAT)

    def pick(acc, f):
        better = _rank_key(f["height"], f["filesize"]) > _rank_key(acc["height"], acc["filesize"])
        return F.when(acc.isNull() | better, f).otherwise(acc)

    return docs.withColumn("best_format", F.aggregate(F.col(col), empty, pick))


def flat_formats(docs: DataFrame, key: str = "id", col: str = "formats") -> DataFrame:
    """One row per (document, format) with the format's position in the array."""
    return (docs.select(key, F.posexplode(col).alias("pos", "f"))
            .select(key, F.col("pos").cast("bigint").alias("pos"), "f.*"))


# ---- flat format tables -----------------------------------------------------

def video_formats(formats: DataFrame) -> DataFrame:
    return formats.where(is_video_format(F.col("vcodec")))


def best_format(formats: DataFrame, key: str = "video_id", tie: str = "format_id") -> DataFrame:
    """Best video format per ``key``: highest (fits 720p, height, filesize), then smallest ``tie``."""
    cols = [c for c in formats.columns if c != key]
    rank = _rank_key(F.col("height"), F.col("filesize"))
    order = F.struct((~rank["fits"]).alias("a"), (-rank["h"]).alias("b"), (-rank["fs"]).alias("c"),
                     F.col(tie).alias("d"))
    return (video_formats(formats).groupBy(key)
            .agg(F.min_by(F.struct(*cols), order).alias("b"))
            .select(key, *[F.col(f"b.{c}").alias(c) for c in cols]))


# ---- info records -----------------------------------------------------------

def media_info(docs: DataFrame) -> DataFrame:
    """The 11 scalar fields of an info record (missing -> null) and the parsed upload day (null where the text is no date)."""
    return docs.select(*S.SCALAR_NAMES, F.try_to_date("upload_date", "yyyyMMdd").alias("upload_day"))


def parse_media_json(lines: DataFrame, col: str = "value") -> DataFrame:
    """Schema-on-read of JSON text into typed info records."""
    return lines.select(F.from_json(col, S.MEDIA_INFO).alias("r")).select("r.*")


def media_policy(objects: DataFrame, max_size: int = K.MAX_FILE_SIZE,
                 allowed: list[str] = K.ALLOWED_FORMATS) -> DataFrame:
    """Check video objects against the declared size limit and allowed formats.

    The reference declares and displays these limits but never enforces
    them; this reports violations without removing anything.
    """
    ext = F.regexp_replace(O.file_extension("key"), r"^\.", "")
    too_big = F.coalesce(F.col("size") > max_size, F.lit(False))
    bad_fmt = ~ext.isin(allowed)
    return objects.select(
        "key", "size", ext.alias("ext"),
        F.when(too_big & bad_fmt, F.lit("file_too_large,format_not_allowed"))
         .when(too_big, F.lit("file_too_large"))
         .when(bad_fmt, F.lit("format_not_allowed")).alias("violation"))
