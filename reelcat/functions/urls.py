"""URL identity as Column expressions (JVM-side, whole-stage codegen).

All helpers take and return ``Column`` so they compose inside any select,
filter, join condition or streaming query.  No Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelcat import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (tabs and newlines too, unlike ``trim``)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def normalize_url(c: Column | str) -> Column:
    """Lower-case, then strip surrounding whitespace."""
    return strip_ws(F.lower(_col(c)))


def url_hash(c: Column | str, length: int = 8) -> Column:
    """First ``length`` hex digits of md5 over the normalised URL."""
    return F.substring(F.md5(normalize_url(c)), 1, length)


def composite_id(base_id: Column | str, url: Column | str) -> Column:
    """``{base_id}-{url_hash}``: the task identity of one (id, url) submission."""
    return F.concat(_col(base_id), F.lit("-"), url_hash(url))


def id_parts(task_id: Column | str) -> Column:
    return F.size(F.split(_col(task_id), "-"))


def is_composite(task_id: Column | str, min_parts: int = 5) -> Column:
    """A task id counts as composite when it has at least ``min_parts`` dash-separated parts."""
    return id_parts(task_id) >= F.lit(min_parts)


def processing_id(task_id: Column | str, min_parts: int = 5) -> Column:
    """Drop the trailing hash part of a composite id; other ids are returned unchanged."""
    t = _col(task_id)
    return F.when(is_composite(t, min_parts), F.regexp_replace(t, r"-[^-]*$", "")).otherwise(t)


def task_id_matches_url(task_id: Column | str, url: Column | str, min_parts: int = 5) -> Column:
    """True when the id is not composite, or its last part equals the URL hash."""
    t = _col(task_id)
    check = F.substring_index(t, "-", -1) == url_hash(url)
    return F.when(~is_composite(t, min_parts), F.lit(True)).otherwise(F.coalesce(check, F.lit(False)))


def video_id(url: Column | str) -> Column:
    """First capture of the video-id patterns, tried in order; null when none matches."""
    u = _col(url)
    return F.coalesce(*[F.nullif(F.regexp_extract(u, p, 1), F.lit("")) for p in K.VIDEO_ID_PATTERNS])


def domain(url: Column | str) -> Column:
    """Host part after ``://`` without one leading ``www.``/``m.``; the whole URL when absent."""
    u = _col(url)
    host = F.regexp_extract(u, K.DOMAIN_PATTERN, 1)
    return F.when(host != "", F.regexp_replace(host, K.DOMAIN_PREFIX_PATTERN, "")).otherwise(u)


def url_match(original: Column | str, processed: Column | str, case_sensitive: bool = False) -> Column:
    """Do two URLs name the same video?  Video ids when both have one, else domains.

    By default both URLs are lower-cased first (the service's behaviour, so ids
    that differ only in case compare equal); ``case_sensitive=True`` only strips
    whitespace.
    """
    o, p = _col(original), _col(processed)
    on, pn = (strip_ws(o), strip_ws(p)) if case_sensitive else (normalize_url(o), normalize_url(p))
    oid, pid = video_id(on), video_id(pn)
    present = o.isNotNull() & p.isNotNull() & (o != "") & (p != "")
    same = F.when(oid.isNotNull() & pid.isNotNull(), oid == pid).otherwise(domain(on) == domain(pn))
    return F.when(present, same).otherwise(F.lit(False))


def is_youtube(url: Column | str) -> Column:
    lowered = F.lower(_col(url))
    hit = F.lit(False)
    for marker in K.YOUTUBE_MARKERS:
        hit = hit | lowered.contains(marker)
    return F.coalesce(hit, F.lit(False))


def has_http_scheme(url: Column | str) -> Column:
    """Case-sensitive ``http://`` or ``https://`` prefix."""
    u = _col(url)
    cond = F.lit(False)
    for scheme in K.URL_SCHEMES:
        cond = cond | u.startswith(scheme)
    return F.coalesce(cond, F.lit(False))


def url_extension(url: Column | str) -> Column:
    """Extension of the last path segment of a URL, query removed, lower-cased; null without a dot."""
    u = _col(url)
    path = F.substring_index(u, "?", 1)
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))
