"""Stored objects in chunks, for bodies of any length and reads by byte range.

A chunk store is a Parquet table with one row per chunk of an object (key, chunk number, offset, length,
bytes), sorted by key and chunk, so

* no cell holds more than one chunk, however long the object is;
* a read of a byte range meets only the chunks that hold it, found by an equi-join on (key, chunk);
* an object of a third of all bytes lies in as many rows, files and tasks as its length asks for.

An object without bytes has one chunk, number 0, of no bytes, so that no object is lost.

Real files are read by byte ranges (``file_chunks``): the listing of names and lengths is dealt out by key and
start, and each task reads its ranges and writes them, so bodies never cross the network.  Bodies in a
frame are cut by ``frame_chunks``, in expressions only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat.functions import objects as O

CHUNK_BYTES = 8 * 1024 * 1024
#: bytes of a file that one row of the listing stands for, read by one task one after the other
RANGE_BYTES = 64 * 1024 * 1024
#: columns of a store without the bytes
FIELDS = ["key", "bucket", "size", "content_type", "metadata", "chunk", "offset", "length"]


# ---- real files -------------------------------------------------------------------

def _file_system(root: str) -> tuple[afs.FileSystem, str]:
    """The file system of ``root`` and the path there; ``file:/x`` is ``/x``."""
    if root.startswith("file:"):
        root = "/" + root[len("file:"):].lstrip("/")
    return afs.FileSystem.from_uri(root)


def _folders(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fs, path = _file_system(root)
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in fs.get_file_info(afs.FileSelector(path)) if x.type == afs.FileType.Directory], pa.string())], names=["folder"])
    return run


def _files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = [x for x in fs.get_file_info(afs.FileSelector(folder)) if x.type == afs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([folder.rsplit("/", 1)[-1]] * len(found), pa.string()), pa.array([x.base_name for x in found], pa.string()),
                                                  pa.array([x.path for x in found], pa.string()), pa.array([x.size for x in found], pa.int64())],
                                                 names=["processing_id", "file_name", "path", "size"])
    return run


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """processing_id, file_name, path, size of the files at ``root/<id>/<name>``, empty ones too.

    One task lists the ids' folders, the folders are then listed in as many tasks as there are shuffle partitions; names don't pass the driver.
    """
    ids = spark.range(0, 1, 1, 1).mapInArrow(_folders(root), "folder string")
    return ids.repartition("folder").mapInArrow(_files(root), "processing_id string, file_name string, path string, size long")


_CHUNK_ROW = "key string, bucket string, size long, content_type string, metadata map<string,string>, chunk long, offset long, length long, bytes binary"


def _read(root: str, chunk: int, span: int):
    """The chunks of each listed range, in order; at most about two chunks are held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(root)
        for b in batches:
            at, chunks, offsets, bodies, held = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                own = b.take(pa.array(at, pa.int64()))
                kept = [own.column(b.schema.get_field_index(n)) for n in FIELDS[:5]]
                return pa.RecordBatch.from_arrays([*kept, pa.array(chunks, pa.int64()), pa.array(offsets, pa.int64()), pa.array([len(x) for x in bodies], pa.int64()),
                                                   pa.array(bodies, pa.binary())], names=[*FIELDS, "bytes"])

            named = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("path", "size", "start")}
            for k, (path, size, start) in enumerate(zip(named["path"], named["size"], named["start"])):
                with fs.open_input_file(path) as file:
                    for offset in range(start, max(min(start + span, size), start + 1), chunk):
                        body = file.read_at(min(chunk, size - offset), offset) if size else b""
                        if len(body) != min(chunk, size - offset):
                            raise OSError(f"{path} has fewer bytes than were listed")
                        for held_row, value in ((at, k), (chunks, offset // chunk), (offsets, offset), (bodies, body)):
                            held_row.append(value)
                        held += len(body)
                        if held >= chunk:
                            yield out()
                            at, chunks, offsets, bodies, held = [], [], [], [], 0
            if at:
                yield out()
    return run


def file_chunks(spark: SparkSession, root: str, bucket: str, chunk: int = CHUNK_BYTES, span: int = RANGE_BYTES) -> DataFrame:
    """The chunks of all files at ``root/<id>/<name>``, by key and chunk within tasks: a store's rows.

    A file that became shorter since it was listed raises; nothing is left out silently.
    """
    span = chunk * max(1, span // chunk)
    pid = F.col("processing_id")
    ranges = listed_files(spark, root).select(
        O.object_key("processing_id", "file_name").alias("key"), F.lit(bucket).alias("bucket"), "size", O.content_type("file_name").alias("content_type"),
        F.create_map(F.lit("processing_id"), pid, F.lit("file_type"), O.file_kind("file_name")).alias("metadata"), "path",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(span).cast("bigint"))).alias("start"))
    return ranges.repartitionByRange("key", "start").sortWithinPartitions("key", "start").mapInArrow(_read(root, chunk, span), _CHUNK_ROW)


# ---- bodies in a frame ------------------------------------------------------------

def frame_chunks(objects: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of objects (key, bucket, size, content_type, metadata, content), by key and chunk: a store's rows."""
    first = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk).cast("bigint"))
    rows = objects.select(*FIELDS[:5], "content", F.posexplode(first).alias("chunk", "offset"))
    rows = rows.select(*FIELDS[:5], F.col("chunk").cast("bigint").alias("chunk"), "offset", F.least(F.lit(chunk).cast("bigint"), F.col("size") - F.col("offset")).alias("length"),
                       F.substring("content", (F.col("offset") + 1).cast("int"), F.lit(chunk)).alias("bytes"))
    return rows.repartitionByRange("key", "chunk").sortWithinPartitions("key", "chunk")


# ---- the store --------------------------------------------------------------------

def store_chunks(chunks: DataFrame, path: str, mode: str = "append") -> str:
    """Write the chunks to the store at ``path``, in the order they are in."""
    chunks.write.mode(mode).parquet(path)
    return path


def chunks_of(store: DataFrame) -> DataFrame:
    """The chunk manifest of a store: no bytes are read."""
    return store.select("key", "size", "chunk", "offset", "length")


def objects_of(store: DataFrame) -> DataFrame:
    """One row per object, from its first chunk: no bytes are read."""
    return store.where("chunk = 0").select(*FIELDS[:5])


def read_ranges(store: DataFrame, requests: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The bytes of requests (key, start, n): key, start, n, offset, bytes, a row for each chunk that holds some of them.

    Put in the order of ``offset``, the rows' bytes are those from ``start`` on, at most ``n`` of them, up to the
    object's end.  Equal requests are answered once.  No rows come for an unknown key, a start before 0 or beyond
    the end, an ``n`` below 1, or a null.  ``chunk`` is the size that the store was written with.
    """
    asked = requests.select("key", "start", "n").where("key is not null and start >= 0 and n > 0").distinct()
    # the end first, so that a request beyond it asks for no further chunks
    ends = asked.join(objects_of(store).select("key", "size"), "key").where("start < size").select("key", "start", "n", F.expr("start + least(n, size - start)").alias("end"))
    wanted = ends.select("*", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))).alias("chunk"))
    met = wanted.join(store.select("key", "chunk", F.col("offset").alias("_from"), F.col("length").alias("_n"), "bytes"), ["key", "chunk"])
    lo = F.greatest(F.col("start"), F.col("_from"))
    hi = F.least(F.col("end"), F.col("_from") + F.col("_n"))
    return met.select("key", "start", "n", lo.alias("offset"), F.substring("bytes", (lo - F.col("_from") + 1).cast("int"), (hi - lo).cast("int")).alias("bytes"))
