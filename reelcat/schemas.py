"""Explicit schemas for nested media records (never inferred on read)."""

from __future__ import annotations

from pyspark.sql import types as T

FORMAT = T.StructType([
    T.StructField("format_id", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("filesize", T.LongType()),
    T.StructField("vcodec", T.StringType()),
    T.StructField("acodec", T.StringType()),
])

MEDIA_SCALARS = [
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("uploader", T.StringType()),
    T.StructField("upload_date", T.StringType()),
    T.StructField("view_count", T.LongType()),
    T.StructField("like_count", T.LongType()),
    T.StructField("thumbnail", T.StringType()),
    T.StructField("webpage_url", T.StringType()),
    T.StructField("extractor", T.StringType()),
]
SCALAR_NAMES = [f.name for f in MEDIA_SCALARS]

# superset of the info variant (with formats) and the download variant (file fields)
MEDIA_INFO = T.StructType(MEDIA_SCALARS + [
    T.StructField("formats", T.ArrayType(FORMAT)),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_extension", T.StringType()),
])

MEDIA_INFO_WITH_CORRUPT = T.StructType(MEDIA_INFO.fields + [T.StructField("_corrupt_record", T.StringType())])

OBJECT_LISTING = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("size", T.LongType()),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
