"""Object-catalogue expressions: key layout, file kinds, content types, URLs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat.functions.urls import _col


def object_key(processing_id: Column | str, file_name: Column | str) -> Column:
    """``videos/{processing_id}/{file_name}``."""
    return F.concat_ws("/", F.lit(K.KEY_ROOT), _col(processing_id), _col(file_name))


def standard_object_keys(processing_id: Column | str, video_id: Column | str, ext: Column | str,
                         thumb_ext: Column | str) -> Column:
    """Keys of the standard path: downloaded files named ``{video id}.{ext}`` under the task prefix."""
    vid = _col(video_id)
    return F.struct(
        object_key(processing_id, F.concat(vid, F.lit("."), _col(ext))).alias("video"),
        object_key(processing_id, F.concat(vid, F.lit(K.METADATA_SUFFIX))).alias("metadata"),
        object_key(processing_id, F.concat(vid, F.lit("."), _col(thumb_ext))).alias("thumbnail"),
    )


def direct_object_keys(processing_id: Column | str, video_id: Column | str, thumb_ext: Column | str) -> Column:
    """Keys written by the direct path: ``{id}_{video id}.mp4``, ``{id}_info.json``,
    ``{id}_thumbnail.{ext}`` (``jpg`` when the thumbnail URL has no extension)."""
    pid = _col(processing_id)
    ext = F.coalesce(_col(thumb_ext), F.lit(K.DEFAULT_THUMBNAIL_EXT))
    return F.struct(
        object_key(pid, F.concat(pid, F.lit("_"), _col(video_id), F.lit(K.DIRECT_VIDEO_EXT))).alias("video"),
        object_key(pid, F.concat(pid, F.lit(K.DIRECT_METADATA_SUFFIX))).alias("metadata"),
        object_key(pid, F.concat(pid, F.lit(K.DIRECT_THUMBNAIL_INFIX), ext)).alias("thumbnail"),
    )


def key_processing_id(key: Column | str) -> Column:
    """Second path part of ``videos/{id}/...`` keys (at least three parts); null otherwise.

    Plain string functions (no array allocation): the key must start with the
    root folder and have another ``/`` after the id.
    """
    k = _col(key)
    root = K.KEY_ROOT + "/"
    rest = F.substring(k, len(root) + 1, 1 << 30)
    return F.when(k.startswith(root) & (F.instr(rest, "/") > 0), F.substring_index(rest, "/", 1))


def base_name(key: Column | str) -> Column:
    return F.substring_index(_col(key), "/", -1)


def file_extension(key: Column | str) -> Column:
    """Last extension of the base name, with its dot, lower-cased ('' when none).

    Leading dots of the name do not start an extension (``.mp4`` has none, like
    a hidden file), so they are trimmed before looking for the last dot.
    """
    name = F.ltrim(base_name(key), F.lit("."))
    return F.when(F.instr(name, ".") > 0, F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))) \
        .otherwise(F.lit(""))


def content_type_map() -> Column:
    """The 13-entry extension -> content type map as a literal map column."""
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(K.CONTENT_TYPES)])


def content_type(key: Column | str) -> Column:
    """Content type from the lower-cased last extension; null for unknown ones."""
    return content_type_map()[file_extension(key)]


def file_kind(path: Column | str) -> Column:
    """Kind of a downloaded file by its (case-sensitive) suffix."""
    p = _col(path)
    thumb = F.lit(False)
    for suffix in K.THUMBNAIL_SUFFIXES:
        thumb = thumb | p.endswith(suffix)
    return (F.when(p.endswith(K.METADATA_SUFFIX), F.lit("metadata"))
            .when(thumb, F.lit("thumbnail"))
            .otherwise(F.lit("video")))


def listed_file_type(file_type: Column | str) -> Column:
    """File type as listed: the metadata value, ``unknown`` when missing."""
    return F.coalesce(_col(file_type), F.lit(K.UNKNOWN_FILE_TYPE))


def object_url(key: Column | str, base_url: str, bucket: str) -> Column:
    """Public access URL ``{base}/storage/v1/object/public/{bucket}/{key}``."""
    return F.concat(F.lit(f"{base_url.rstrip('/')}{K.PUBLIC_URL_PATH}{bucket}/"), _col(key))
