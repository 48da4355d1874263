"""Shards of near-equal bytes by histogram sort.

Documents are ordered by (hash of the text, hash of the id, hash of the row's number); the
keys are written before anything is counted, so the row's number is settled.  The cut points of
that order are found by counting exact bytes below candidate boundaries and
refining them (:mod:`reelcat.llm.histogram`); then every document goes through
one exchange to its place.  Equal texts are neighbours in the order: a group of
copies is parted only where keeping it whole would leave a shard more than
``group_tolerance`` off its share, so a group that is larger than a shard is
spread over several.  Each shard is cut further into pieces of about one shuffle
partition, whose exact first slots the histogram gives, so no task holds a whole
shard.

Defined cases: null text has no bytes and the checksum of an empty text; a null
id is a key like any other; rows that repeat (same id and text) are neighbours
with different slots, which may lie in different shards where they are many; an empty table gives an empty result.  Clashing extra
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelcat.llm.common import settle
from reelcat.llm.histogram import as_struct, find_cuts, ordered


#: low bits of the second key that come from the row's number, so that rows which repeat can be parted
ROW_BITS = 24


def _keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("_w"), F.crc32(text.cast("binary")).alias("_crc"),
                       F.xxhash64(text).alias("_k1"), F.expr(f"(xxhash64(4, doc_id) & {-1 << ROW_BITS}L) | (xxhash64(5, monotonically_increasing_id()) & {(1 << ROW_BITS) - 1}L)").alias("_k2"))


def _reached(key: Column, cuts: list[Column]) -> Column:
    """How many of the ascending cuts are not above the key."""
    return sum((F.when(key >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def histogram_shards(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.0005, group_tolerance: float = 0.01,
                     pieces: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    ``tolerance`` and ``group_tolerance`` are parts of a shard's share of bytes.
    ``pieces`` per shard: as many as the session's shuffle partitions need.
    """
    spark = docs.sparkSession
    pieces = pieces or -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards)
    keys = settle(_keys(docs))
    total = keys.agg(F.sum("_w")).first()[0] or 0
    share = total / n_shards
    parts = n_shards * pieces
    wanted = [(total * j / parts, *((tolerance * share, group_tolerance * share) if j % pieces == 0 else (0.1 * share / pieces,) * 2))
              for j in range(1, parts)]
    cuts = find_cuts(keys.withColumn("_g", F.lit(0).cast("long")), {0: wanted})[0]
    own = cuts[pieces - 1::pieces]
    key = F.struct(ordered(F.col("_k1")), ordered(F.col("_k2")))
    first = [0, *(c.rows for c in own)]
    inner, starts = [], []
    for s in range(n_shards):
        within = cuts[s * pieces:(s + 1) * pieces - 1]
        inner.append(F.array(*(as_struct(c) for c in within)) if within else F.array().cast("array<struct<col1:bigint,col2:bigint>>"))
        starts.append(F.array(*(F.lit(max(0, n - first[s])).cast("long") for n in [first[s], *(c.rows for c in within)])))
    placed = (keys.withColumn("shard", _reached(key, [as_struct(c) for c in own]).cast("int"))
              .withColumn("_piece", F.size(F.filter(F.element_at(F.array(*inner), F.col("shard") + 1), lambda c: c <= key))))
    place = Window.partitionBy("shard", "_piece").orderBy(ordered(F.col("_k1")), ordered(F.col("_k2")), "doc_id")
    start = F.element_at(F.element_at(F.array(*starts), F.col("shard") + 1), F.col("_piece") + 1)
    return placed.select("doc_id", F.col("_w").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
                         (start + F.row_number().over(place) - 1).cast("long").alias("slot"))
