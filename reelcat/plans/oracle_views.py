"""The fixture views in DuckDB's dialect, for the SQL oracle.

Only the base tables are registered in the oracle, so each oracle query is
prefixed with the views it needs as CTEs (``with_views``).  The texts follow
``reelcat.sources.fixtures`` except where the dialects differ
(interval construction, timestamp formatting).
"""

from __future__ import annotations

from reelcat import constants as K

VIEWS = {
    "tasks": """
WITH u AS (
 SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice,
  md5(cast(o_orderkey as varchar)) AS h,
  CASE o_orderkey % 8
   WHEN 0 THEN 'https://www.youtube.com/watch?v=V' || cast(o_custkey as varchar)
   WHEN 1 THEN 'https://youtu.be/V' || cast(o_custkey as varchar)
   WHEN 2 THEN 'https://www.youtube.com/embed/V' || cast(o_custkey as varchar)
   WHEN 3 THEN 'https://m.youtube.com/v/V' || cast(o_custkey as varchar)
   WHEN 4 THEN 'https://www.tiktok.com/@u' || cast(o_custkey % 10 as varchar) || '/video/' || cast(o_custkey as varchar)
   WHEN 5 THEN 'https://tiktok.com/t/T' || cast(o_custkey as varchar)
   WHEN 6 THEN 'http://vimeo.com/' || cast(o_custkey as varchar) || '?ref=x'
   ELSE 'not-a-url-' || cast(o_custkey as varchar) END AS clean_url
 FROM orders),
b AS (SELECT *, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS base_id,
  substr(md5(lower(clean_url)),1,8) AS uh FROM u)
SELECT o_orderkey AS src_key, base_id,
 CASE WHEN o_orderkey % 10 = 9 THEN base_id
      WHEN o_orderkey % 10 = 8 THEN 'job' || cast(o_orderkey as varchar) || '-' || uh
      WHEN o_orderkey % 10 = 7 THEN base_id || '-deadbeef'
      ELSE base_id || '-' || uh END AS id,
 CASE WHEN o_custkey % 5 = 0 THEN chr(9) || upper(clean_url) || '  ' ELSE clean_url END AS video_url,
 CASE o_orderkey % 4 WHEN 0 THEN clean_url WHEN 1 THEN 'https://www.youtube.com/watch?v=V' || cast(o_custkey as varchar)
   WHEN 2 THEN 'https://vimeo.com/1' ELSE NULL END AS processed_url,
 CASE WHEN o_custkey % 3 = 0 THEN 'https://hooks.example.com/' || cast(o_custkey as varchar) END AS webhook_url,
 CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing'
   ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'completed' END END AS status,
 CASE WHEN o_orderstatus='F' AND o_orderpriority='5-LOW' THEN CASE o_orderkey % 3 WHEN 0 THEN 'VideoDownloadError'
   WHEN 1 THEN 'StorageError' ELSE 'Exception' END END AS error_class,
 CASE WHEN o_orderstatus='F' AND o_orderpriority='5-LOW' AND o_orderkey % 3 = 0 THEN CASE o_custkey % 3
   WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'FORMAT_ERROR' END END AS error_code,
 CASE WHEN o_orderstatus='F' AND o_orderpriority='5-LOW' THEN CASE o_custkey % 4 WHEN 0 THEN 'Timeout after 900s'
   WHEN 1 THEN 'Network unreachable' WHEN 2 THEN 'Processing timed out' ELSE 'HTTP 403' END END AS error_message,
 o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
 o_orderdate + to_seconds(o_orderkey % 86400 + cast(floor(o_totalprice) as bigint) % 3600) AS updated_at
FROM b""",
    "files": """
SELECT cast(l_orderkey as varchar) AS processing_id,
 'videos/' || cast(l_orderkey as varchar) || '/' || cast(l_linenumber as varchar) || '_' || cast(l_partkey as varchar)
  || '_' || cast(l_suppkey as varchar)
  || CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus='F' THEN '.mp4' ELSE '.webm' END WHEN 'N' THEN '.info.json'
     ELSE CASE WHEN l_linestatus='F' THEN '.jpg' ELSE '.webp' END END AS key,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 AND l_returnflag='R' THEN 'subtitle' WHEN l_returnflag='A' THEN 'video' WHEN l_returnflag='N' THEN 'metadata'
   ELSE 'thumbnail' END AS file_type,
 cast(round(l_extendedprice * 100) as bigint) AS size, l_shipdate AS last_modified
FROM lineitem""",
    "formats": """
SELECT l_orderkey AS video_id,
 cast(l_partkey as varchar) || '-' || cast(l_suppkey as varchar) || '-' || cast(l_linenumber as varchar) AS format_id,
 CASE l_linenumber WHEN 1 THEN 144 WHEN 2 THEN 240 WHEN 3 THEN 360 WHEN 4 THEN 480 WHEN 5 THEN 720 WHEN 6 THEN 1080 END AS height,
 CASE WHEN l_linestatus='F' THEN cast(round(l_extendedprice * 100) as bigint) END AS filesize,
 CASE l_returnflag WHEN 'A' THEN 'avc1' WHEN 'R' THEN 'none' END AS vcodec
FROM lineitem""",
    "task_events": """
SELECT event_id, ts, user_id AS task_id,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'progress'
   WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS event,
 cast(round(value * 1024) as bigint) AS bytes
FROM events""",
    "submissions": """
SELECT base_id, video_url AS url, created_at AS submitted_at FROM tasks
UNION ALL
SELECT base_id, upper(video_url) || ' ' AS url, updated_at AS submitted_at FROM tasks WHERE webhook_url IS NOT NULL
UNION ALL
SELECT CASE WHEN status = 'failed' THEN base_id END AS base_id,
 CASE WHEN status = 'queued' THEN 'ftp://x.example.com/' || base_id END AS url, created_at AS submitted_at
FROM tasks WHERE substr(base_id,1,1) = '0'""",
    "task_warnings": """
SELECT id, warning FROM (
 SELECT id, 'url_mismatch' AS warning, processed_url IS NULL AS hit FROM tasks WHERE status = 'completed'
 UNION ALL SELECT id, 'metadata_upload_failed', substr(md5(id),1,1) IN ('0','1') FROM tasks WHERE status = 'completed'
 UNION ALL SELECT id, 'thumbnail_upload_failed', substr(md5(id),1,1) IN ('1','2') FROM tasks WHERE status = 'completed'
 UNION ALL SELECT id, 'info_url_generation_failed', substr(md5(id),1,1) = '3' FROM tasks WHERE status = 'completed'
 UNION ALL SELECT id, 'subtitle_upload_failed', substr(md5(id),1,1) IN ('3','4') FROM tasks WHERE status = 'completed') x
WHERE hit""",
    "log_lines": """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' - src.tasks - '
 || CASE event WHEN 'failed' THEN 'ERROR' ELSE 'INFO' END || ' - ' ||
 CASE event WHEN 'queued' THEN '[' || cast(task_id as varchar) || '] Stage 1: Downloading video'
  WHEN 'processing' THEN 'Using proxy for request'
  WHEN 'progress' THEN '[' || cast(task_id as varchar) || '] Stage 2: Uploading files to storage'
  WHEN 'completed' THEN 'Task ' || cast(task_id as varchar) || ' completed successfully.'
  ELSE '[' || cast(task_id as varchar) || '] Timeout during video processing: ' END AS line
FROM task_events""",
}

# views a view reads from
_DEPENDS = {"submissions": ["tasks"], "task_warnings": ["tasks"], "log_lines": ["task_events"]}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and what they read), in dependency order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# --- SQL snippets shared by the oracle queries --------------------------------

def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_norm(x: str) -> str:
    return sql_strip(f"lower({x})")


def sql_hash(x: str) -> str:
    return f"substr(md5({sql_norm(x)}), 1, 8)"


def sql_video_id(x: str) -> str:
    parts = [f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in K.VIDEO_ID_PATTERNS]
    return "coalesce(" + ", ".join(parts) + ")"


def sql_domain(x: str) -> str:
    host = f"regexp_extract({x}, '{K.DOMAIN_PATTERN}', 1)"
    return f"CASE WHEN {host} <> '' THEN regexp_replace({host}, '{K.DOMAIN_PREFIX_PATTERN}', '') ELSE {x} END"


def sql_url_match(o: str, p: str) -> str:
    on, pn = sql_norm(o), sql_norm(p)
    oid, pid = sql_video_id(on), sql_video_id(pn)
    return (f"CASE WHEN {o} IS NULL OR {p} IS NULL OR {o} = '' OR {p} = '' THEN false "
            f"WHEN {oid} IS NOT NULL AND {pid} IS NOT NULL THEN {oid} = {pid} "
            f"ELSE {sql_domain(on)} = {sql_domain(pn)} END")


def sql_parts(x: str) -> str:
    return f"len(string_split({x}, '-'))"


def sql_processing_id(x: str, min_parts: int = 5) -> str:
    return f"CASE WHEN {sql_parts(x)} >= {min_parts} THEN regexp_replace({x}, '-[^-]*$', '') ELSE {x} END"


def sql_key_pid(key: str) -> str:
    return (f"CASE WHEN len(string_split({key}, '/')) >= 3 AND string_split({key}, '/')[1] = '{K.KEY_ROOT}' "
            f"THEN string_split({key}, '/')[2] END")


def sql_file_ext(key: str) -> str:
    base = f"regexp_extract({key}, '[^/]*$')"
    return f"lower(regexp_extract({base}, '^\\.*[^.].*(\\.[^.]*)$', 1))"


def sql_content_type(key: str) -> str:
    ext = sql_file_ext(key)
    whens = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in K.CONTENT_TYPES)
    return f"CASE {ext} {whens} END"


def sql_url_ext(url: str) -> str:
    name = f"regexp_extract(split_part({url}, '?', 1), '[^/]*$')"
    return f"CASE WHEN {name} LIKE '%.%' THEN lower(regexp_extract({name}, '[^.]*$')) END"


def sql_object_url(key: str, base_url: str, bucket: str) -> str:
    return f"'{base_url.rstrip('/')}{K.PUBLIC_URL_PATH}{bucket}/' || {key}"


def sql_error_text() -> str:
    """Error text of a failed task row (message plus labelled URL/provider and code)."""
    sep = K.ERROR_TEXT_SEPARATOR
    code = f"CASE WHEN error_code <> '' THEN '{K.ERROR_CODE_LABEL}' || error_code END"
    return (f"CASE error_class WHEN 'VideoDownloadError' THEN concat_ws('{sep}', error_message, "
            f"CASE WHEN video_url <> '' THEN '{K.ERROR_URL_LABEL}' || video_url END, {code}) "
            f"WHEN 'StorageError' THEN concat_ws('{sep}', error_message, "
            f"'{K.ERROR_PROVIDER_LABEL}{K.STORAGE_PROVIDER}', {code}) ELSE error_message END")
