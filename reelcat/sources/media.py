"""Media-info documents: derived records, JSON sink and schema-on-read source.

``media_records`` builds one info document per order (the info variant with a
``formats`` array, built per row, so no grouping is needed); ``write_media_json``
and ``read_media_json`` are the JSON sink/source pair with an explicit schema
and a corrupt-record column (PERMISSIVE mode).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat import schemas as S
from reelcat.session import checkpoint_dir
from reelcat.sources.tables import read_table

MEDIA_RECORDS_SQL = """
SELECT 'v' || cast(o_orderkey as string) AS id,
 'Order video ' || cast(o_orderkey as string) AS title,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS description,
 o_totalprice / 100 AS duration,
 'uploader' || cast(o_custkey as string) AS uploader,
 date_format(o_orderdate, 'yyyyMMdd') AS upload_date,
 o_orderkey * 37 % 100000 AS view_count,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS like_count,
 'https://img.example.com/' || cast(o_orderkey as string) || '.jpg' AS thumbnail,
 'https://www.youtube.com/watch?v=V' || cast(o_orderkey as string) AS webpage_url,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'youtube' END AS extractor,
 array(
  named_struct('format_id', cast(o_orderkey as string) || '-360', 'ext', 'mp4', 'width', 640, 'height', 360,
   'filesize', cast(floor(o_totalprice) as bigint) * 10, 'vcodec', 'avc1', 'acodec', 'mp4a'),
  named_struct('format_id', cast(o_orderkey as string) || '-1080', 'ext', 'webm', 'width', 1920,
   'height', CASE WHEN o_orderkey % 3 = 0 THEN cast(NULL as int) ELSE 1080 END,
   'filesize', cast(floor(o_totalprice) as bigint) * 40,
   'vcodec', CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'vp9' END, 'acodec', cast(NULL as string)),
  named_struct('format_id', cast(o_orderkey as string) || '-a', 'ext', 'm4a', 'width', cast(NULL as int),
   'height', cast(NULL as int), 'filesize', cast(floor(o_totalprice) as bigint), 'vcodec', 'none', 'acodec', 'mp4a'),
  named_struct('format_id', cast(o_orderkey as string) || '-720', 'ext', 'mp4', 'width', 1280, 'height', 720,
   'filesize', CASE WHEN o_orderkey % 2 = 0 THEN cast(NULL as bigint) ELSE cast(floor(o_totalprice) as bigint) * 20 END,
   'vcodec', cast(NULL as string), 'acodec', 'mp4a')
 ) AS formats,
 CASE WHEN o_orderstatus = 'F' THEN cast(floor(o_totalprice) as bigint) * 1000 END AS file_size,
 CASE WHEN o_orderstatus = 'F' THEN 'mp4' END AS file_extension
FROM {orders}
"""


def media_records(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """One media-info document per order, typed to ``schemas.MEDIA_INFO``; ``orders`` are rows of that table (by
    default all), whose columns ``kept`` follow the document's."""
    sql = MEDIA_RECORDS_SQL.replace("FROM {orders}", "".join(f", {c}" for c in kept) + " FROM {orders}")
    raw = spark.sql(sql, orders=read_table(spark, sf_dir, "orders") if orders is None else orders)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.MEDIA_INFO.fields], *kept)


def media_json_lines(records: DataFrame) -> DataFrame:
    """Each record as one JSON text line (``value``); null fields are omitted."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))


def write_media_json(records: DataFrame, path: str) -> str:
    records.write.mode("overwrite").json(path)
    return path


def read_media_json(spark: SparkSession, path: str) -> DataFrame:
    """Read info JSON with the explicit schema; malformed lines land in ``_corrupt_record``."""
    return (spark.read.schema(S.MEDIA_INFO_WITH_CORRUPT)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
