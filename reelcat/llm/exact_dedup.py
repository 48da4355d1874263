"""Exact deduplication: 128-bit content hashes, smallest or largest id kept, bytes compared.

``exact_groups`` returns one row per input row.  Null text counts as empty, so
null and empty texts form one group.  Rows that repeat (same id, same text) are
members of the same group; a null id is smaller than any other id.  An empty
table gives an empty result.  Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import NO_ID, ordered_id, settle


def content_hash(text: Column) -> Column:
    """128 bits of a text as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, keep: str = "smallest", content: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by (hash, bytes): the grouping itself compares the bytes of
    all texts that share a hash, so a collision of the 128-bit hash ends up in two
    groups.  The aggregation is partial, so copies collapse to one row in every
    map task before the shuffle, however large their group is.  What goes back to
    the documents is keyed by hash and SHA-256; two different texts that agreed in
    both would stop the job instead of being merged.  Groups are written to the shared
    checkpoint folder, so that the join back is between two exchanges and a large
    group's rows can be split over tasks.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    base = docs.select(F.col("doc_id"), ordered_id().alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    base = base.withColumn("_hash", content(F.col("_text")))
    same_bytes = base.groupBy("_hash", "_text").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    groups = settle(same_bytes.select("_hash", F.sha2(F.col("_text"), 256).alias("text_sha256"), "_keep", "group_size")
                    .groupBy("_hash", "text_sha256")
                    .agg(F.max("_keep").alias("_keep"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("_n"))
                    .withColumn("_keep", F.when(F.col("_n") == 1, F.col("_keep")).otherwise(
                        F.raise_error(F.lit("two different texts agree in both hashes")).cast("long"))))
    rows = base.select("doc_id", "_id", "_hash", F.sha2(F.col("_text"), 256).alias("text_sha256"))
    return rows.join(groups, ["_hash", "text_sha256"]).select(
        "doc_id", F.nullif(F.col("_keep"), F.lit(NO_ID)).alias("keep_id"), "group_size",
        (F.col("_id") == F.col("_keep")).alias("kept"), "text_sha256")
