"""Line deduplication by range-partitioned line hashes.

Every line's key (stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased)
is hashed to 128 bits.  (hash, document, position) rows are range-partitioned and
sorted by document and position inside; one pass over each partition streams
first occurrences.  The range is cut by (hash, document), so a line that a third
of all documents share is spread over many partitions; where a hash goes on in
the next partition, the document that holds it first is carried over: one row
per partition.  The partitions are written to the shared checkpoint folder
before they are streamed, so both passes see the same cuts after a lost executor.

What comes back is one compressed keep bitmap per document, not text.

Defined cases: null and empty texts are one empty line, which stays.  A null id
is smaller than any other.  Rows that repeat (same id and text) count as one
document and get the same bitmap; rows that share an id but not the text are the
same document with separate bitmaps.  Keys under ``min_chars`` code points are
left alone.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import NO_ID, SPACES, column, ordered_id, raw, rows, settle

MIN_CHARS = 10
_LINES = pa.schema([("_h1", pa.int64()), ("_h2", pa.int64()), ("_id", pa.int64()), ("_th", pa.int64()), ("_pos", pa.int32())])
_EDGE = pa.schema([(k, pa.int64()) for k in ("part", "f1", "f2", "l1", "l2", "owner")])
_DROPS = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("_pos", pa.int32())])


def _keyed(docs: DataFrame) -> DataFrame:
    """Input with the columns that identify a document's text."""
    return docs.withColumns({"_id": ordered_id(), "_th": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def _line_rows(min_chars: int):
    spaces = SPACES.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at, pos = [], [], []
            for k, text in enumerate(raw(b)):
                for p, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars:
                        key = line.strip(spaces).lower()
                        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                            hashes.append(xxhash.xxh3_128_digest(key))
                            at.append(k)
                            pos.append(p)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = pa.array(at, pa.int64())
            yield rows(_LINES, _h1=h[:, 0], _h2=h[:, 1], _id=column(b, "_id").take(at), _th=column(b, "_th").take(at), _pos=pos)

    return run


def _arrays(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [column(b, n).to_numpy(zero_copy_only=False) for n in names]


def _owners(batches: Iterator[pa.RecordBatch], carry: dict) -> Iterator[tuple]:
    """(batch, part, key columns, id of the document that holds each row's hash first)."""
    last = owner = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, ids, part = _arrays(b, "_h1", "_h2", "_id", "_part")
        if last is None:
            last, owner = carry.get(int(part[0]), (None, None))
        new = np.empty(len(h1), bool)
        new[0] = last != (h1[0], h2[0])
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(new)
        firsts = ids[at]
        if not new[0]:
            at, firsts = np.concatenate([[0], at]), np.concatenate([[owner], firsts])
        own = np.repeat(firsts, np.diff(np.append(at, len(h1))))
        last, owner = (h1[-1], h2[-1]), own[-1]
        yield b, part, h1, h2, ids, own


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = end = None
    for _, part, h1, h2, _, own in _owners(batches, {}):
        first = first or (int(part[0]), int(h1[0]), int(h2[0]))
        end = (int(h1[-1]), int(h2[-1]), int(own[-1]))
    if first:
        yield rows(_EDGE, **{k: [v] for k, v in zip(_EDGE.names, (*first, *end))})


def _drops(carry: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _, _, ids, own in _owners(batches, carry):
            gone = pa.array(np.flatnonzero(ids != own))
            yield pa.RecordBatch.from_arrays([column(b, n).take(gone) for n in _DROPS.names], schema=_DROPS)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dropped, maps = [], []
        for n, gone in zip(column(b, "n_lines").to_pylist(), column(b, "_gone").to_pylist()):
            keep = np.ones(n, bool)
            keep[gone] = False
            dropped.append(len(gone))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [column(b, "_id"), column(b, "_th"), column(b, "n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            names=["_id", "_th", "n_lines", "n_dropped", "keep_bitmap"])


def _bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    keyed = _keyed(docs.select("doc_id", "text"))
    lines = (keyed.select("_id", "_th", "text").mapInArrow(_line_rows(min_chars), "_h1 long, _h2 long, _id long, _th long, _pos int")
             .repartitionByRange("_h1", "_h2", "_id").sortWithinPartitions("_h1", "_h2", "_id", "_pos"))
    lines = settle(lines).withColumn("_part", F.spark_partition_id().cast("long"))
    carry, before = {}, None
    for e in sorted(lines.mapInArrow(_edges, ", ".join(f"{n} long" for n in _EDGE.names)).collect()):  # one row per partition
        if before and before[0] == (e.f1, e.f2):
            carry[e.part] = before
        goes_on = e.part in carry and (e.l1, e.l2) == (e.f1, e.f2)
        before = ((e.l1, e.l2), carry[e.part][1] if goes_on else e.owner)
    drops = lines.mapInArrow(_drops(carry), "_id long, _th long, _pos int")
    counts = keyed.select("_id", "_th", (F.length(F.coalesce("text", F.lit(""))) - F.length(
        F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.lit(None).cast("int").alias("_pos"))
    per_doc = (counts.unionByName(drops.withColumn("n_lines", F.lit(None).cast("long")))
               .groupBy("_id", "_th").agg(F.max("n_lines").alias("n_lines"), F.collect_set("_pos").alias("_gone")))
    return per_doc.mapInArrow(_pack, "_id long, _th long, n_lines long, n_dropped long, keep_bitmap binary")


def line_keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep_bitmap (zlib of packed bits) per distinct (id, text)."""
    return _bitmaps(docs, min_chars).select(
        F.nullif(F.col("_id"), F.lit(NO_ID)).alias("doc_id"), F.col("_th").alias("text_hash"), "n_lines", "n_dropped", "keep_bitmap")


def kept_lines(text: bytes, n: int, bitmap: bytes) -> bytes:
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n)
    return text if keep.all() else b"\n".join(x for x, k in zip(text.split(b"\n"), keep) if k)


def _kept(b: pa.RecordBatch) -> Iterator[bytes]:
    for x in zip(raw(b), column(b, "_lines").to_pylist(), column(b, "_map").to_pylist()):
        yield kept_lines(*x)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha = [hashlib.sha256(x).hexdigest() for x in _kept(b)]
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "_lines"), column(b, "_dropped"), pa.array(sha, pa.string())],
                                         names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        yield b.set_column(at, b.schema.field(at), pa.array([x.decode() for x in _kept(b)], b.schema.field(at).type))


def _with_bitmaps(docs: DataFrame, min_chars: int, *own) -> DataFrame:
    """Columns ``own``, text and the bitmap of each row."""
    maps = _bitmaps(docs, min_chars).select("_id", "_th", F.col("n_lines").alias("_lines"), F.col("n_dropped").alias("_dropped"), F.col("keep_bitmap").alias("_map"))
    return _keyed(docs.select("doc_id", "text", *own)).join(maps, ["_id", "_th"])


def dedup_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of what the bitmaps keep; one row per input row."""
    both = _with_bitmaps(docs, min_chars).select(F.col("doc_id").cast("long"), "text", "_lines", "_dropped", "_map")
    return both.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with only their kept lines (null texts become empty); other columns as they are."""
    both = _with_bitmaps(docs, min_chars, F.struct("*").alias("_row")).select("_row", "text", "_lines", "_map")
    return both.mapInArrow(_texts, both.schema).select(*((F.col("text") if c == "text" else F.col("_row")[c].alias(c)) for c in docs.columns))
