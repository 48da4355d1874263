"""Registered catalogue queries (object listing, grouping, paging, upsert, delete)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat import constants as K
from reelcat.functions import objects as O
from reelcat.operators import catalog as C
from reelcat.operators.scan import page_by_bounds
from reelcat.plans.oracle_views import sql_content_type, sql_key_pid, sql_object_url, with_views
from reelcat.sources import fixtures as X

BASE_URL = "https://storage.example.com"
BUCKET = "media"
LISTING_PAGE = 1
LISTING_LIMIT = K.PAGE_DEFAULT_LIMIT
LIST_PREFIX = "videos/1"
SLOTS = (*K.FILE_TYPES, K.UNKNOWN_FILE_TYPE)


def q_video_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return C.video_catalog(X.files(spark, sf))


def q_video_listing(spark: SparkSession, sf: str) -> DataFrame:
    return C.video_listing(X.files(spark, sf), LISTING_PAGE, LISTING_LIMIT)


def q_video_details(spark: SparkSession, sf: str) -> DataFrame:
    return C.video_details(X.files(spark, sf), BASE_URL, BUCKET)


def q_list_objects(spark: SparkSession, sf: str) -> DataFrame:
    return C.list_objects(X.files(spark, sf), LIST_PREFIX, K.LIST_DEFAULT_LIMIT)


def incoming_objects(files: DataFrame) -> DataFrame:
    """A second upload batch derived from the listing (one scan): every video object is
    re-uploaded one day later with a new size, and every metadata object gets a
    second revision under a new key."""
    video = F.col("file_type") == "video"
    return (files.where(F.col("file_type").isin("video", "metadata"))
            .select(F.when(video, F.col("key")).otherwise(F.concat("key", F.lit(".v2"))).alias("key"),
                    F.when(video, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
                    F.when(video, F.col("last_modified") + F.expr("INTERVAL 1 DAY"))
                     .otherwise(F.col("last_modified")).alias("last_modified"),
                    "file_type"))


def q_upsert_objects(spark: SparkSession, sf: str) -> DataFrame:
    files = X.files(spark, sf)
    return C.upsert_objects(files, incoming_objects(files))


def delete_request(spark: SparkSession, sf: str) -> DataFrame:
    """Processing ids to delete: every failed task's source key, as text, plus
    ids that have no objects (the key times a large prime), in one scan."""
    t = X.tasks(spark, sf).where(F.col("status") == "failed")
    ids = F.array(F.col("src_key").cast("string"), (F.col("src_key") * 1000003).cast("string"))
    return t.select(F.explode(ids).alias("processing_id"))


def q_delete_videos(spark: SparkSession, sf: str) -> DataFrame:
    report, _, _ = C.delete_videos(X.files(spark, sf), delete_request(spark, sf))
    return report


def q_delete_remaining(spark: SparkSession, sf: str) -> DataFrame:
    _, remaining, _ = C.delete_videos(X.files(spark, sf), delete_request(spark, sf))
    return remaining


def _manifest_copy(spark: SparkSession, sf: str):
    """A table for a stored manifest of this query's own, which is going to be changed, and the listing for it."""
    from reelcat.sources import objects as SO
    from reelcat.sources.media import scratch_path
    table = SO.stored_manifest(spark, scratch_path(spark, "changing-manifest"))
    return table, X.files(spark, sf).select("processing_id", "key", "file_type", "size", "last_modified")


def q_stored_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The stored manifest after a second upload batch overwrote it by key."""
    from reelcat.sources import objects as SO
    table, listing = _manifest_copy(spark, sf)
    SO.create_manifest(table, listing)
    incoming = incoming_objects(X.files(spark, sf))
    SO.stored_upsert(table, incoming.withColumn("processing_id", O.key_processing_id("key")))
    return table.read().select("key", "size", "last_modified", "file_type")


def q_stored_delete(spark: SparkSession, sf: str) -> DataFrame:
    """The stored manifest after the objects of a batch of ids were deleted from it."""
    from reelcat.sources import objects as SO
    table, listing = _manifest_copy(spark, sf)
    table.create(listing)
    SO.stored_delete(table, delete_request(spark, sf))
    return table.read()


def q_deleted_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The keys that a deletion removes."""
    _, _, deleted = C.delete_videos(X.files(spark, sf), delete_request(spark, sf))
    return deleted.select("processing_id", "key")


def exists_probes(files: DataFrame) -> DataFrame:
    """Probe keys (one scan): every stored key, its extension-less prefix, and a
    sibling that does not exist (``key + '.bak'``)."""
    k = F.col("key")
    return files.select(F.explode(F.array(k, F.regexp_replace(k, r"\.[^./]*$", ""),
                                          F.concat(k, F.lit(".bak")))).alias("key"))


def q_object_exists(spark: SparkSession, sf: str) -> DataFrame:
    files = X.files(spark, sf)
    return C.object_exists(files, exists_probes(files))


QUERIES = {
    "video_catalog": q_video_catalog,
    "video_listing": q_video_listing,
    "video_details": q_video_details,
    "list_objects": q_list_objects,
    "upsert_objects": q_upsert_objects,
    "delete_videos": q_delete_videos,
    "delete_remaining": q_delete_remaining,
    "deleted_objects": q_deleted_objects,
    "stored_upsert": q_stored_upsert,
    "stored_delete": q_stored_delete,
    "object_exists": q_object_exists,
}


# --- oracle -------------------------------------------------------------------

_LASTS = """lasts AS (
 SELECT pid, ftype, key, size, content_type FROM parsed
 QUALIFY row_number() OVER (PARTITION BY pid, ftype ORDER BY last_modified DESC, key DESC) = 1)"""
_PARSED = f"""parsed AS (
 SELECT {sql_key_pid('key')} AS pid, key, size, last_modified, coalesce(file_type, 'unknown') AS ftype,
  {sql_content_type('key')} AS content_type
 FROM files)"""


def _slot_sql(t: str, fields) -> list[str]:
    best = f"max(CASE WHEN ftype = '{t}' THEN struct_pack(lm := last_modified, k := key, {', '.join(f'{f} := {f}' for f in fields)}) END)"
    return [f"({best}).{f} AS {t}_{f}" for f in fields]


def _catalog_sql() -> str:
    cols = []
    for t in SLOTS:
        cols += _slot_sql(t, C.SLOT_FIELDS)
    return (f"SELECT pid AS processing_id, min(last_modified) AS created_at, count(*) AS n_files,\n "
            + ",\n ".join(cols) + ",\n (SELECT to_json(list(struct_pack(file_type := ftype, key := key, size := size, content_type := content_type) "
            "ORDER BY ftype))::VARCHAR FROM lasts WHERE lasts.pid = parsed.pid) AS files"
            "\nFROM parsed WHERE pid IS NOT NULL GROUP BY pid")


def _details_sql() -> str:
    fields = ("key", "size", "last_modified", "content_type")
    cols = []
    for t in K.FILE_TYPES:
        cols += _slot_sql(t, fields)
    inner = ("SELECT pid AS processing_id,\n " + ",\n ".join(cols)
             + "\nFROM parsed WHERE pid IS NOT NULL AND ftype IN ('video','metadata','thumbnail') GROUP BY pid")
    outs = ["processing_id"]
    for t in K.FILE_TYPES:
        outs += [f"{t}_{f}" for f in fields]
        outs.append(f"CASE WHEN {t}_key IS NOT NULL THEN {sql_object_url(f'{t}_key', BASE_URL, BUCKET)} END AS {t}_url")
    return f"SELECT {', '.join(outs)} FROM ({inner}) d"


_INCOMING = """incoming AS (
 SELECT key, size + 1 AS size, last_modified + INTERVAL 1 DAY AS last_modified, file_type FROM files WHERE file_type = 'video'
 UNION ALL
 SELECT key || '.v2' AS key, size, last_modified, file_type FROM files WHERE file_type = 'metadata')"""

_DELETE_IDS = """req AS (
 SELECT DISTINCT pid FROM (
  SELECT cast(src_key as varchar) AS pid FROM tasks WHERE status = 'failed'
  UNION ALL SELECT cast(src_key * 1000003 as varchar) AS pid FROM tasks WHERE status = 'failed') r
 WHERE pid IS NOT NULL)"""

ORACLE = {
    "video_catalog": with_views(["files"], f"WITH {_PARSED}, {_LASTS}\n{_catalog_sql()}"),
    "video_listing": with_views(["files"], f"""WITH {_PARSED}, {_LASTS}, cat AS ({_catalog_sql()}),
 tot AS (SELECT count(*) AS total FROM cat)
SELECT cat.*, cast({(LISTING_PAGE - 1) * LISTING_LIMIT} + row_number() OVER (ORDER BY created_at DESC, processing_id) AS bigint) AS position,
 cast({LISTING_PAGE} AS bigint) AS page, cast({LISTING_LIMIT} AS bigint) AS page_limit, (SELECT total FROM tot) AS total,
 {LISTING_PAGE * LISTING_LIMIT} < (SELECT total FROM tot) AS has_next
FROM cat
ORDER BY created_at DESC, processing_id
LIMIT {LISTING_LIMIT} OFFSET {(LISTING_PAGE - 1) * LISTING_LIMIT}"""),
    "video_details": with_views(["files"], f"WITH {_PARSED}\n{_details_sql()}"),
    "list_objects": with_views(["files"], f"""
SELECT key, size, last_modified, {sql_content_type('key')} AS content_type, coalesce(file_type, 'unknown') AS file_type
FROM files WHERE starts_with(key, '{LIST_PREFIX}') ORDER BY key LIMIT {K.LIST_DEFAULT_LIMIT}"""),
    "upsert_objects": with_views(["files"], f"""WITH {_INCOMING},
 allv AS (SELECT key, size, last_modified, file_type, 0 AS version FROM files
          UNION ALL SELECT key, size, last_modified, file_type, 1 AS version FROM incoming)
SELECT key, (max(struct_pack(v := version, lm := last_modified, s := size, ft := file_type))).s AS size,
 (max(struct_pack(v := version, lm := last_modified, s := size, ft := file_type))).lm AS last_modified,
 (max(struct_pack(v := version, lm := last_modified, s := size, ft := file_type))).ft AS file_type,
 (max(struct_pack(v := version, lm := last_modified, s := size, ft := file_type))).v = 1 AS from_incoming,
 count(*) AS n_versions
FROM allv GROUP BY key"""),
    "delete_videos": with_views(["files", "tasks"], f"""WITH {_DELETE_IDS},
 f AS (SELECT {sql_key_pid('key')} AS pid FROM files),
 c AS (SELECT pid, count(*) AS n FROM f WHERE pid IN (SELECT pid FROM req) GROUP BY pid)
SELECT req.pid AS processing_id, cast(coalesce(c.n, 0) AS bigint) AS n_deleted, c.n IS NOT NULL AS found
FROM req LEFT JOIN c ON req.pid = c.pid"""),
    "stored_upsert": with_views(["files"], f"""WITH {_INCOMING},
 allv AS (SELECT key, size, last_modified, file_type, 0 AS version FROM files
          UNION ALL SELECT key, size, last_modified, file_type, 1 AS version FROM incoming)
SELECT key, size, last_modified, file_type FROM allv
QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, last_modified DESC, size DESC) = 1"""),
    "stored_delete": with_views(["files", "tasks"], f"""WITH {_DELETE_IDS}
SELECT processing_id, key, file_type, size, last_modified FROM files
WHERE {sql_key_pid('key')} IS NULL OR {sql_key_pid('key')} NOT IN (SELECT pid FROM req)"""),
    "delete_remaining": with_views(["files", "tasks"], f"""WITH {_DELETE_IDS}
SELECT processing_id, key, file_type, size, last_modified FROM files
WHERE {sql_key_pid('key')} IS NULL OR {sql_key_pid('key')} NOT IN (SELECT pid FROM req)"""),
    "deleted_objects": with_views(["files", "tasks"], f"""WITH {_DELETE_IDS}
SELECT processing_id, key FROM files WHERE {sql_key_pid('key')} IN (SELECT pid FROM req)"""),
    "object_exists": with_views(["files"], """WITH probes AS (
  SELECT key FROM files
  UNION ALL SELECT regexp_replace(key, '\\.[^./]*$', '') AS key FROM files
  UNION ALL SELECT key || '.bak' AS key FROM files)
SELECT DISTINCT p.key, p.key IN (SELECT key FROM files) AS "exists" FROM probes p"""),
}


# --- stored objects ------------------------------------------------------------

_STAGED: dict = {}


def page_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Three objects per page: its HTML as the video, an info document, its URL as the thumbnail.
    Ids are text with leading zeros."""
    from reelcat.sources.tables import read_table
    pid = F.concat(F.lit("00"), F.col("page_id").cast("string"))
    info = F.to_json(F.struct(pid.alias("id"), F.col("url").alias("webpage_url")), {"ignoreNullFields": "false"})

    def one(file_type: str, suffix: str, body) -> F.Column:
        meta = F.create_map(F.lit("processing_id"), pid, F.lit("file_type"), F.lit(file_type))
        return F.struct(F.concat(pid, F.lit(suffix)).alias("file_name"), body.cast("binary").alias("content"), meta.alias("metadata"))

    three = F.array(one("video", ".mp4", F.col("html")), one("metadata", K.METADATA_SUFFIX, info),
                    one("thumbnail", ".jpg", F.col("url")))
    return (read_table(spark, sf, "pages").select(pid.alias("processing_id"), F.explode(three).alias("o"))
            .select("processing_id", "o.*"))


def _stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The stored objects of all pages, written once per application and input folder."""
    from reelcat.sources import objects as SO
    from reelcat.sources.media import scratch_path
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STAGED:
        _STAGED[key] = SO.store_objects(SO.new_objects(page_objects(spark, sf), BUCKET), scratch_path(spark, "objects"))
    return spark.read.parquet(_STAGED[key])


MANIFEST = ("key", "processing_id", "bucket", "size", "content_type", "file_type")


def q_ingest_objects(spark: SparkSession, sf: str) -> DataFrame:
    from reelcat.sources import objects as SO
    return SO.manifest_of(_stored_pages(spark, sf)).select(*MANIFEST)


def q_read_objects(spark: SparkSession, sf: str) -> DataFrame:
    from reelcat.sources import objects as SO
    store = _stored_pages(spark, sf)
    # every stored key, plus one missing sibling per key
    keys = store.select(F.explode(F.array(F.col("key"), F.concat("key", F.lit(".missing")))).alias("key"))
    return SO.read_objects(store, keys).select("key", F.col("size").alias("length"), F.sha2("content", 256).alias("content_sha256"))


def q_manifest_table(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest, write the manifest as a Parquet table sorted by id, read it back."""
    from reelcat.sources import objects as SO
    from reelcat.sources.media import scratch_path
    path = SO.write_manifest(SO.manifest_of(_stored_pages(spark, sf)), scratch_path(spark, "manifest"))
    return spark.read.parquet(path).select(*MANIFEST)


QUERIES["ingest_objects"] = q_ingest_objects
QUERIES["manifest_table"] = q_manifest_table
QUERIES["read_objects"] = q_read_objects
_OBJECTS = f"""p AS (SELECT '00' || cast(page_id as varchar) AS pid, url, html FROM pages),
 o AS (SELECT pid, 'video' AS file_type, 'video/mp4' AS content_type, pid || '.mp4' AS name, html AS body FROM p
  UNION ALL SELECT pid, 'metadata', 'application/json', pid || '.info.json', to_json(struct_pack(id := pid, webpage_url := url))::VARCHAR FROM p
  UNION ALL SELECT pid, 'thumbnail', 'image/jpeg', pid || '.jpg', url FROM p),
 objects AS (SELECT 'videos/' || pid || '/' || name AS key, pid AS processing_id, '{BUCKET}' AS bucket,
  coalesce(strlen(body), 0)::BIGINT AS size, content_type, file_type, coalesce(body, '') AS body FROM o)"""
ORACLE["ingest_objects"] = f"WITH {_OBJECTS} SELECT {', '.join(MANIFEST)} FROM objects"
ORACLE["manifest_table"] = ORACLE["ingest_objects"]
ORACLE["read_objects"] = f"WITH {_OBJECTS} SELECT key, size AS length, sha256(body) AS content_sha256 FROM objects"


# --- stored chunks: objects of any length, reads by byte range ------------------

PAGE_CHUNK = 1024
#: start and number of bytes that are asked of every object
RANGE_START, RANGE_BYTES = 700, 2000


def _page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' objects as a stored table of chunks (written once per application and input)."""
    from reelcat.sources import chunks as SC
    from reelcat.sources.media import scratch_path
    key = ("chunks", spark.sparkContext.applicationId, sf)
    if key not in _STAGED:
        _STAGED[key] = SC.store_chunks(SC.frame_chunks(_stored_pages(spark, sf), PAGE_CHUNK), scratch_path(spark, "chunks"))
    return spark.read.parquet(_STAGED[key])


def q_stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk of every stored object, with the hash of its bytes."""
    return _page_chunks(spark, sf).select("key", "size", "chunk", "offset", "length", F.sha2(F.hex("bytes").cast("binary"), 256).alias("bytes_sha256"))


def q_read_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """One byte range of every stored object, and of a missing sibling of each."""
    from reelcat.sources import chunks as SC
    store = _page_chunks(spark, sf)
    keys = SC.objects_of(store).select(F.explode(F.array(F.col("key"), F.concat("key", F.lit(".missing")))).alias("key"))
    asked = keys.select("key", F.lit(RANGE_START).cast("bigint").alias("start"), F.lit(RANGE_BYTES).cast("bigint").alias("n"))
    return SC.read_ranges(store, asked, PAGE_CHUNK).select("key", "offset", F.octet_length("bytes").cast("bigint").alias("length"), F.sha2(F.hex("bytes").cast("binary"), 256).alias("bytes_sha256"))


QUERIES["stored_chunks"] = q_stored_chunks
QUERIES["read_ranges"] = q_read_ranges
_CHUNKS = f"""{_OBJECTS},
 c AS (SELECT key, size, hex(encode(body)) AS hexed, unnest(range(0, greatest(size, 1), {PAGE_CHUNK})) AS "offset" FROM objects)"""
ORACLE["stored_chunks"] = f"""WITH {_CHUNKS}
SELECT key, size, ("offset" // {PAGE_CHUNK})::BIGINT AS chunk, "offset"::BIGINT AS "offset", least({PAGE_CHUNK}, size - "offset")::BIGINT AS length,
 sha256(substr(hexed, 2 * "offset" + 1, {2 * PAGE_CHUNK})) AS bytes_sha256 FROM c"""
ORACLE["read_ranges"] = f"""WITH {_CHUNKS},
 r AS (SELECT key, hexed, greatest({RANGE_START}, "offset") AS lo, least({RANGE_START + RANGE_BYTES}, size, "offset" + {PAGE_CHUNK}) AS hi FROM c)
SELECT key, lo::BIGINT AS "offset", (hi - lo)::BIGINT AS length, sha256(substr(hexed, 2 * lo + 1, 2 * (hi - lo))) AS bytes_sha256 FROM r WHERE lo < hi"""


# --- paging (L2): a deeper page of the catalogue ------------------------------

PAGE_N, PAGE_LIMIT = 3, 50
DEEP_LIMIT = 5


def q_listing_page(spark: SparkSession, sf: str) -> DataFrame:
    cat = C.video_catalog(X.files(spark, sf)).select("processing_id", "created_at", "n_files")
    return C.listing_page(cat, ["-created_at", "processing_id"], PAGE_N, PAGE_LIMIT)


def deep_page(n_rows: int) -> int:
    """A page of five rows past the middle of the table."""
    return n_rows // 2 // DEEP_LIMIT + 1


def q_deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page in the middle of all objects, in order of size and key."""
    files = X.files(spark, sf)
    sliced, total = page_by_bounds(files.select("key", "size", "last_modified"), ["-size", "key"], (deep_page(files.count()) - 1) * DEEP_LIMIT, DEEP_LIMIT)
    return sliced.withColumn("total", F.lit(total).cast("bigint"))


QUERIES["listing_page"] = q_listing_page
QUERIES["deep_page"] = q_deep_page
ORACLE["deep_page"] = with_views(["files"], f"""WITH t AS (SELECT count(*) AS total FROM files),
 r AS (SELECT key, size, last_modified, row_number() OVER (ORDER BY size DESC NULLS LAST, key) AS position FROM files)
SELECT key, size, last_modified, cast(position AS bigint) AS position, total FROM r, t
WHERE position > total // 2 // {DEEP_LIMIT} * {DEEP_LIMIT} AND position <= (total // 2 // {DEEP_LIMIT} + 1) * {DEEP_LIMIT}""")
ORACLE["listing_page"] = with_views(["files"], f"""WITH {_PARSED},
 cat AS (SELECT pid AS processing_id, min(last_modified) AS created_at, count(*) AS n_files
         FROM parsed WHERE pid IS NOT NULL GROUP BY pid),
 tot AS (SELECT count(*) AS total FROM cat)
SELECT cat.*, cast(row_number() OVER (ORDER BY created_at DESC, processing_id) AS bigint) AS position,
 cast({PAGE_N} AS bigint) AS page, cast({PAGE_LIMIT} AS bigint) AS page_limit, (SELECT total FROM tot) AS total,
 {PAGE_N * PAGE_LIMIT} < (SELECT total FROM tot) AS has_next
FROM cat
QUALIFY position > {(PAGE_N - 1) * PAGE_LIMIT} AND position <= {PAGE_N * PAGE_LIMIT}""")


def q_list_stored_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix listing over the manifest of the stored objects."""
    from reelcat.sources import objects as SO
    manifest = SO.manifest_of(_stored_pages(spark, sf))
    return C.list_objects(manifest, STORED_PREFIX, K.LIST_DEFAULT_LIMIT).drop("last_modified")


STORED_PREFIX = "videos/001"
QUERIES["list_stored_objects"] = q_list_stored_objects
ORACLE["list_stored_objects"] = f"""WITH {_OBJECTS}
SELECT key, size, content_type, file_type FROM objects
WHERE starts_with(key, '{STORED_PREFIX}') ORDER BY key LIMIT {K.LIST_DEFAULT_LIMIT}"""
