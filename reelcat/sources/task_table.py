"""The task table as Parquet: written partitioned by status and creation month, sorted within files.

This stands in for the reference's indexes on ``(status, created_at)`` and
``(status, updated_at)``: a filter on ``status`` prunes folders, a range on
``created_at`` prunes folders by month and row groups by their min/max
statistics (files are sorted by ``created_at, id``).  Months, not days, keep
the number of folders proportionate to the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat.operators.identity import dedupe_submissions


def write_task_table(tasks: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write ``tasks`` under ``path/status=<s>/created_month=<m>/`` sorted by (created_at, id).

    Rows are range-partitioned on the folder and the order within it, so a month with a
    third of all tasks is sorted and written by several tasks.
    """
    (tasks.withColumn("created_month", F.trunc(F.to_date("created_at"), "month"))
     .repartitionByRange("status", "created_month", "created_at", "id")
     .sortWithinPartitions("status", "created_month", "created_at", "id")
     .write.mode(mode).partitionBy("status", "created_month").parquet(path))
    return path


def append_submissions(spark: SparkSession, path: str, subs: DataFrame) -> str:
    """Append the tasks of new submissions to the table at ``path``: the first submission of
    each id that the table doesn't hold.  Columns that a new task lacks are null."""
    stored = read_task_table(spark, path).drop("created_month")
    fresh, _ = dedupe_submissions(subs, stored)
    rows = fresh.select("id", "base_id", "video_url", F.lit("queued").alias("status"), "created_at", F.col("created_at").alias("updated_at"))
    return write_task_table(stored.limit(0).unionByName(rows, allowMissingColumns=True), path, mode="append")


def read_task_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def queued_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Queued tasks created in ``[start, end)``: a status partition filter, a month
    partition filter and a pushed-down ``created_at`` range."""
    t = read_task_table(spark, path)
    lo, hi = F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))
    return t.where((F.col("status") == "queued")
                   & (F.col("created_month") >= F.trunc(F.to_date(lo), "month"))
                   & (F.col("created_month") <= F.to_date(hi))
                   & (F.col("created_at") >= lo) & (F.col("created_at") < hi))
