"""Object catalogue: listing, grouping per video, paging, upsert, delete, existence.

Inputs are object listings with at least ``key, size, last_modified`` and an
optional ``file_type`` (from object metadata) and ``content_type``.

Scale notes
-----------
* Per-video grouping is a ``groupBy(processing_id)`` whose aggregates
  (``min``, ``max_by``, ``count``) combine map-side, so a video holding a third
  of all objects still collapses to one row per input partition before the
  shuffle.
* "Last wins" is made deterministic with ``(last_modified, key)`` as the
  ordering, so results do not depend on input order.
* Paging is a top-k (``orderBy().offset().limit()`` -> TakeOrderedAndProject)
  while ``page * limit`` is small; for deeper pages rows are counted per range of the
  order and only the range that holds the page is sorted (``scan.page_by_bounds``).
* Key lookups (delete) are equi/semi/anti joins; the broadcast choice
  is left to AQE, which checks the runtime size of each side against
  ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelcat import constants as K
from reelcat.functions import objects as O
from reelcat.operators.scan import Order, page_by_bounds

SLOT_FIELDS = ("key", "size", "content_type")


def listing_from_records(records: DataFrame) -> DataFrame:
    """Object-listing records (``schemas.OBJECT_LISTING``: key, size, last_modified,
    content_type, metadata map) as catalogue input: ``file_type`` comes from the
    object metadata; a missing content type falls back to the key's extension."""
    return records.select(
        "key", "size", "last_modified",
        F.coalesce(F.col("content_type"), O.content_type("key")).alias("content_type"),
        F.col("metadata").getItem("file_type").alias("file_type"))


def parse_listing(files: DataFrame, with_content_type: bool = True) -> DataFrame:
    """Add ``pid`` (parsed from the key) and ``ftype``; keep parseable keys.

    ``content_type`` is kept when the listing has it; otherwise it is derived
    from the key here, unless ``with_content_type`` is off (callers that only
    need it for a few winning keys derive it after aggregating).
    """
    cols = files.columns
    ftype = F.col("file_type") if "file_type" in cols else F.lit(None).cast("string")
    parsed = (files
              .withColumn("pid", O.key_processing_id("key"))
              .where(F.col("pid").isNotNull())
              .withColumn("ftype", O.listed_file_type(ftype)))
    if "content_type" not in cols and with_content_type:
        parsed = parsed.withColumn("content_type", O.content_type("key"))
    return parsed


def _last_slot(ftype: str, fields=SLOT_FIELDS) -> Column:
    """The newest object of one file type in a group: max by (last_modified, key)."""
    hit = F.col("ftype") == ftype
    value = F.struct(*[F.col(f).alias(f) for f in fields])
    order = F.struct(F.col("last_modified"), F.col("key"))
    return F.max_by(F.when(hit, value), F.when(hit, order))


def video_catalog(files: DataFrame, slots=(*K.FILE_TYPES, K.UNKNOWN_FILE_TYPE)) -> DataFrame:
    """One row per processing id: created_at, object count, the last object of each type
    in ``slots`` as columns, and ``files``: the last object of every type there is, as a JSON
    array in type order.

    Objects are first reduced to one row per id and type, with a map-side combine, so the
    second aggregation sees at most as many rows of an id as it has types.  When the
    listing carries no content type, it is derived once per winning key.
    """
    given = "content_type" in files.columns
    parsed = parse_listing(files, with_content_type=False)
    carried = SLOT_FIELDS if given else ("key", "size")
    last = F.max_by(F.struct(*carried), F.struct("last_modified", "key"))
    per_type = parsed.groupBy("pid", "ftype").agg(F.min("last_modified").alias("created_at"), F.count(F.lit(1)).alias("n"), last.alias("o"))
    kind = F.col("o.content_type") if given else O.content_type("o.key")
    entry = F.struct(F.col("ftype").alias("file_type"), "o.key", "o.size", kind.alias("content_type"))
    grouped = per_type.groupBy(F.col("pid").alias("processing_id")).agg(
        F.min("created_at").alias("created_at"), F.sum("n").alias("n_files"), F.sort_array(F.collect_list(entry)).alias("_files"))

    def slot(t: str) -> Column:
        return F.get(F.filter("_files", lambda f: f["file_type"] == t), F.lit(0))

    return grouped.select("processing_id", "created_at", "n_files",
                          *[slot(t)[f].alias(f"{t}_{f}") for t in slots for f in SLOT_FIELDS],
                          F.to_json("_files", {"ignoreNullFields": "false"}).alias("files"))


def check_page(page: int, limit: int, max_limit: int = K.PAGE_MAX_LIMIT) -> tuple[int, int]:
    """Page numbers start at 1; the limit is capped at ``max_limit``."""
    if page < 1:
        raise ValueError("page must be >= 1")
    if limit < 1:
        raise ValueError("limit must be >= 1")
    return page, min(limit, max_limit)


# pages that end within this many rows are one top-k over the table; others are found by the bounds of the order
TOPK_ROWS = 10_000


def listing_page(df: DataFrame, order: list[str], page: int = 1, limit: int = K.PAGE_DEFAULT_LIMIT,
                 max_limit: int = K.PAGE_MAX_LIMIT) -> DataFrame:
    """Slice page ``page`` of ``df`` in ``order`` and add page, limit, total, has_next, position.

    ``order`` (names, ``-name`` for falling) must be a total order (end with a unique key).  A page among the first
    ``TOPK_ROWS`` rows is a top-k (TakeOrderedAndProject), its total a scalar subquery.  A page beyond is found by
    counts per range of the order (``scan.page_by_bounds``), whose sum is the total: only
    the rows around the page are sorted, however deep it lies.
    """
    page, limit = check_page(page, limit, max_limit)
    start = (page - 1) * limit
    if start + limit <= TOPK_ROWS:
        by = Order(order).columns()
        # at most `limit` (<= 100) rows reach this window
        pos = F.row_number().over(Window.orderBy(*by)) + F.lit(start)
        sliced, total = df.orderBy(*by).offset(start).limit(limit).withColumn("position", pos.cast("bigint")), df.select(F.count(F.lit(1))).scalar()
    else:
        sliced, n = page_by_bounds(df, order, start, limit)
        total = F.lit(n).cast("bigint")
    return (sliced
            .withColumn("page", F.lit(page).cast("bigint"))
            .withColumn("page_limit", F.lit(limit).cast("bigint"))
            .withColumn("total", total)
            .withColumn("has_next", F.lit(page * limit) < total))


def video_listing(files: DataFrame, page: int = 1, limit: int = K.PAGE_DEFAULT_LIMIT) -> DataFrame:
    """Page of videos, newest first (ties by processing id), with totals."""
    catalog = video_catalog(files)
    return listing_page(catalog, ["-created_at", "processing_id"], page, limit)


def video_details(files: DataFrame, base_url: str, bucket: str) -> DataFrame:
    """The three fixed slots (video, metadata, thumbnail) per processing id.

    Other file types are ignored; a processing id with none of the three is
    absent (the reference's "not found").  As in ``video_catalog``, a content
    type missing from the listing is derived from each winning key.
    """
    given = "content_type" in files.columns
    fields = ("key", "size", "last_modified", "content_type")
    carried = fields if given else fields[:3]
    parsed = parse_listing(files, with_content_type=False).where(F.col("ftype").isin(K.FILE_TYPES))
    grouped = parsed.groupBy(F.col("pid").alias("processing_id")).agg(
        *[_last_slot(t, carried).alias(f"_{t}") for t in K.FILE_TYPES])
    out = ["processing_id"]
    for t in K.FILE_TYPES:
        out += [F.col(f"_{t}.{f}").alias(f"{t}_{f}") for f in fields[:3]]
        out.append((F.col(f"_{t}.content_type") if given else O.content_type(f"_{t}.key"))
                   .alias(f"{t}_content_type"))
        out.append(F.when(F.col(f"_{t}.key").isNotNull(), O.object_url(f"_{t}.key", base_url, bucket))
                   .alias(f"{t}_url"))
    return grouped.select(*out)


def list_objects(files: DataFrame, prefix: str = "", limit: int = K.LIST_DEFAULT_LIMIT) -> DataFrame:
    """Objects whose key starts with ``prefix``, in key order, first ``limit`` of them."""
    cols = files.columns
    listed = files.where(F.col("key").startswith(prefix))
    return (listed.select(
                "key", "size", "last_modified",
                (F.col("content_type") if "content_type" in cols else O.content_type("key")).alias("content_type"),
                O.listed_file_type(F.col("file_type") if "file_type" in cols else F.lit(None)).alias("file_type"))
            .orderBy("key").limit(limit))


def upsert_objects(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite-by-key: each key keeps its incoming version when one exists.

    Both sides carry ``key, size, last_modified, file_type``.  Rows are tagged
    with their write order (0 = current, 1 = incoming) and the latest write per
    key wins, ties broken by ``last_modified``.  The union is aggregated per
    key with a map-side combine, so repeated keys collapse before the shuffle.
    """
    cols = ["key", "size", "last_modified", "file_type"]
    both = (current.select(*cols).withColumn("version", F.lit(0))
            .unionByName(incoming.select(*cols).withColumn("version", F.lit(1))))
    winner = F.max_by(F.struct(*[F.col(c) for c in cols[1:]], F.col("version")),
                      F.struct(F.col("version"), F.col("last_modified"), F.col("size")))
    return (both.groupBy("key").agg(winner.alias("w"), F.count(F.lit(1)).alias("n_versions"))
            .select("key", "w.size", "w.last_modified", "w.file_type",
                    (F.col("w.version") == 1).alias("from_incoming"),
                    F.col("n_versions").cast("bigint").alias("n_versions")))


def delete_videos(files: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete all objects under ``videos/{id}/`` for a batch of processing ids.

    Returns ``(report, remaining, deleted)``: per requested id the number of
    deleted objects and a found flag; the surviving listing (anti join); and
    the deleted keys (semi join).
    """
    parsed = files.withColumn("pid", O.key_processing_id("key"))
    req = ids.select(F.col("processing_id").alias("pid")).where(F.col("pid").isNotNull()).distinct()
    deleted = parsed.join(req, "pid", "left_semi")
    remaining = parsed.join(req, "pid", "left_anti").drop("pid")
    counts = deleted.groupBy("pid").agg(F.count(F.lit(1)).alias("n_deleted"))
    report = (req.join(counts, "pid", "left")
              .select(F.col("pid").alias("processing_id"),
                      F.coalesce(F.col("n_deleted"), F.lit(0)).cast("bigint").alias("n_deleted"),
                      F.col("n_deleted").isNotNull().alias("found")))
    return report, remaining, deleted.drop("pid")


def object_exists(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Exact-key existence for each distinct probe key (no prefix matching).

    Objects and probes meet in one shuffle of the keys, each with two flags, and are grouped where they arrive.
    Nearly all keys differ, so a combine before the shuffle would hold a whole input split and spill; the rows of a
    key asked for again and again compress in the shuffle and are one group that is never held.
    """
    asked, stored = F.lit(1).cast("tinyint"), F.lit(2).cast("tinyint")
    met = probes.select("key", asked.alias("_met")).unionByName(files.where(F.col("key").isNotNull()).select("key", stored.alias("_met")))
    return (met.repartition("key").groupBy("key").agg(F.bit_or("_met").alias("_met"))
            .where(F.col("_met").bitwiseAND(F.lit(1)) != 0)
            .select("key", (F.col("_met").bitwiseAND(F.lit(2)) != 0).alias("exists")))
