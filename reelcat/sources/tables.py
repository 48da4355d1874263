"""Readers for the driver's parquet tables.

Tables are read lazily; Catalyst prunes columns and pushes filters into the
Parquet scan, so a reader never materialises more than a query needs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# key each table is hash-partitioned on when its scan is too coarse to use the cluster
DISTRIBUTION_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, rebalance: bool = True) -> DataFrame:
    """Read one driver table as a DataFrame (no schema inference beyond parquet).

    A file with a single row group scans as one task, which would run all the
    per-row work after it on one core.  When the scan has fewer partitions
    than the cluster's default parallelism, it is hash-partitioned on the
    table key (deterministic on retry, unlike round-robin).  Large inputs
    already have more splits than cores and are left as they are.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = table_path(sf_dir, name)
    df = spark.read.parquet(path)
    if rebalance:
        target = spark.sparkContext.defaultParallelism
        if _scan_partitions(spark, path, df) < target:
            df = df.repartition(target, *DISTRIBUTION_KEYS[name])
    return df


_SPLITS: dict = {}


def _scan_partitions(spark: SparkSession, path: str, df: DataFrame) -> int:
    """Number of scan partitions of a table, planned once per application and path."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SPLITS:
        _SPLITS[key] = df.rdd.getNumPartitions()
    return _SPLITS[key]
