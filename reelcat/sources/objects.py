"""Stored objects: bulk upload, manifest and reads by key.

A store is a Parquet table of objects (key, bucket, bytes, content type, metadata), range-partitioned
and sorted by key, so

* many small objects share a file, and none needs a folder that the driver would have to list;
* a manifest reads no object bytes (they are a column that is not selected);
* a key or a prefix reaches the scan as a filter, and row groups outside it are skipped;
* a bucket or id that holds a third of all objects is split over many files.

``object_files`` uploads real files of any kind: their bytes as they are, their names from their paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelcat import constants as K
from reelcat.functions import objects as O
from reelcat.sources.keyed_table import KeyedTable


def object_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """processing_id, file_name, content, metadata of the files at ``root/<id>/<name>``.

    The id is text taken from the path (``007`` stays ``007``); the file type follows
    the name, as for downloaded files.  Spark's file sources pass over files without bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    pid, name = F.element_at(F.split("path", "/"), -2), O.base_name("path")
    return reader.load(root).select(
        pid.alias("processing_id"), name.alias("file_name"), "content",
        F.create_map(F.lit("processing_id"), pid, F.lit("file_type"), O.file_kind(name)).alias("metadata"))


def new_objects(uploads: DataFrame, bucket: str) -> DataFrame:
    """Objects for uploads (processing_id, file_name, content, metadata): key, bucket, size,
    content type by the file name (null when unknown), upload time.  A null content is empty."""
    key = O.object_key("processing_id", "file_name")
    content = F.coalesce("content", F.lit("").cast("binary"))
    return uploads.select(
        key.alias("key"), F.lit(bucket).alias("bucket"), F.octet_length(content).cast("long").alias("size"),
        O.content_type("file_name").alias("content_type"), "metadata",
        F.current_timestamp().cast("timestamp_ntz").alias("last_modified"), content.alias("content"))


def store_objects(objects: DataFrame, path: str, mode: str = "append") -> str:
    """Write objects to the store at ``path``, sorted by bucket and key."""
    (objects.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.mode(mode).parquet(path))
    return path


def manifest_of(store: DataFrame) -> DataFrame:
    """The store without object bytes; the id and the file type as columns."""
    return store.select("key", O.key_processing_id("key").alias("processing_id"), "bucket", "size", "content_type",
                        F.col("metadata")["file_type"].alias("file_type"), "last_modified")


def read_objects(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored objects with the given keys (unknown keys are absent)."""
    return store.join(keys.select("key").distinct(), "key", "left_semi")


def write_manifest(manifest: DataFrame, path: str) -> str:
    """Store a manifest sorted by processing id, so a look-up by id skips other row groups."""
    (manifest.repartitionByRange("processing_id", "key").sortWithinPartitions("processing_id", "key")
     .write.mode("overwrite").parquet(path))
    return path


# ---- a stored manifest that changes ---------------------------------------------

def stored_manifest(spark: SparkSession, path: str) -> KeyedTable:
    """The changing manifest at ``path``: one row per key, in ranges of the key."""
    return KeyedTable(spark, path, "key")


def _newest(table: KeyedTable, first: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of the rows with one key the one that is greatest by ``first``, then ``(last_modified, size)``; rows without a key all stay.

    For ``settle``: the rows of a key have met in the shuffle that lays out the table, so no other one is needed.
    """
    def settle(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(table.key, "key").orderBy(*(F.col(c).desc() for c in (*first, "last_modified", "size"))))
        return rows.withColumn("_place", place).where((F.col("_place") == 1) | F.col("key").isNull()).drop("_place", *first)
    return settle


def create_manifest(table: KeyedTable, listing: DataFrame) -> int:
    """Store a listing as the first version, of rows with one key the newest by ``(last_modified, size)``; the version's number."""
    return table.create(listing, _newest(table, [])).number


def stored_upsert(table: KeyedTable, incoming: DataFrame) -> int:
    """Overwrite by key in the stored manifest: each key keeps its newest incoming record, by
    ``(last_modified, size)``.  Only the ranges that hold an incoming key are written anew.  Returns the new version's number.

    ``incoming`` has the manifest's columns; a null key isn't stored.  Without incoming rows nothing changes.
    It's read more than once and must give the same rows each time.  Stored and incoming rows meet in the one shuffle
    that lays out the new parts; a key that was stored twice in a range that is written comes out once.
    """
    v = table.version()
    fields = table.read(v).columns
    rows = incoming.where(F.col("key").isNotNull()).select(*fields)
    own = table.touched(rows.select("key"), F.col("key"), F.col("key"), v)
    if not own and (v.parts or rows.isEmpty()):
        return v.number
    both = table.read(v, own).select(*fields, F.lit(False).alias("_incoming")).unionByName(rows.withColumn("_incoming", F.lit(True)))
    return table.replace(own, both, v, settle=_newest(table, ["_incoming"])).number


def stored_delete(table: KeyedTable, ids: DataFrame) -> DataFrame:
    """Delete the objects under ``videos/{id}/`` of a batch of ids from the stored manifest; report per
    distinct id: processing_id, n_deleted, found.

    Only ranges that overlap an id's prefix are read and, if an object goes, written anew.
    """
    v = table.version()
    req = ids.select(F.col("processing_id").alias("pid")).where(F.col("pid").isNotNull()).distinct()
    under = F.concat(F.lit(K.KEY_ROOT + "/"), F.col("pid"))
    # the character after the slash ends the span of a prefix
    own = table.touched(req, F.concat(under, F.lit("/")), F.concat(under, F.lit("0")), v)
    held, pid = table.read(v, own), O.key_processing_id("key")
    counts = held.select(pid.alias("pid")).join(req, "pid").groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    report = (req.join(counts, "pid", "left").select(F.col("pid").alias("processing_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_deleted"),
                                                     F.col("n").isNotNull().alias("found")))
    if own:
        # the id is taken from the key where rows meet: it isn't shuffled beside it
        table.replace(own, held.join(req.select(F.col("pid").alias("_pid")), pid == F.col("_pid"), "left_anti"), v)
    return report
