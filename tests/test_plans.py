"""Plan shapes the scale design relies on (checked with explain, not timings)."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from reelcat.plans import all_queries
from reelcat.sources import fixtures as X
from tests.conftest import SF_SMALL

QUERIES = all_queries()


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_nested_loop_or_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan, (name, bad)


def test_catalog_aggregates_partially_before_the_shuffle(spark):
    plan = plan_of(QUERIES["video_catalog"](spark, SF_SMALL))
    assert "partial_max_by" in plan and "partial_min" in plan and "partial_count" in plan
    assert "hashpartitioning(pid" in plan
    # the listing scan reads only the columns the keys and sizes need
    widths = [int(w) for w in re.findall(r"\(\d+\) Scan parquet.*?\nOutput \[(\d+)\]", plan, re.S)]
    assert widths and max(widths) <= 8


@pytest.mark.parametrize("name", ["list_objects", "claim_batch", "video_listing", "supported_sites"])
def test_limits_are_top_k(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan, name


def test_task_table_reads_are_pruned(spark):
    plan = plan_of(QUERIES["queued_between"](spark, SF_SMALL))
    assert re.search(r"PartitionFilters: \[.*status.*= queued.*created_month", plan)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(created_at.*LessThan\(created_at", plan)


def test_object_bytes_are_read_only_when_asked_for(spark):
    from reelcat.plans.catalog import _stored_pages
    from reelcat.sources import objects as SO
    store = _stored_pages(spark, SF_SMALL)
    assert "content:binary" not in plan_of(SO.manifest_of(store).where("processing_id = '003'"))
    one = store.where("key = 'videos/003/003.mp4'")
    assert "EqualTo(key,videos/003/003.mp4)" in plan_of(one)
    keys = SO.manifest_of(store).where(F.col("processing_id").isin("003", "0017")).select("key")
    assert SO.read_objects(store, keys).count() == 6


def test_segmented_scan_is_range_partitioned(spark):
    from reelcat.operators.scan import running
    ev = X.task_events(spark, SF_SMALL)
    df = running(ev, ["task_id"], ["ts", "event_id"], sums={"b": F.col("bytes")})
    plan = plan_of(df)
    # the row-level windows run per (range partition, key); the
    # per-partition carry table (one row per partition) is broadcast back
    assert re.search(r"row_number\(\) windowspecdefinition\(_part#\d+, task_id#\d+L?, ts#", plan)
    assert "BroadcastExchange" in plan


def test_result_documents_gather_ended_tasks_only(spark, tmp_path):
    """Orders that come twice, with other states too: the same documents as from all objects and records."""
    from reelcat.operators import catalog as C
    from reelcat.operators import metrics as M
    from reelcat.plans import lifecycle as L
    from reelcat.plans import metrics as PM
    from reelcat.sources.media import media_records
    sf = str(tmp_path)
    orders = [(k, c, s, p) for k, c, s, p in [(1, 1, "F", "1-URGENT"), (4, 2, "F", "5-LOW"), (4, 2, "O", "5-LOW"), (5, 3, "O", "5-LOW"), (6, 3, "F", "2-HIGH"), (6, 3, "F", "2-HIGH"),
                                              (8, 5, "F", "1-URGENT"), (8, 5, "P", None), (9, 7, "F", None), (None, 1, "F", "5-LOW"), (12, None, "F", "1-URGENT")]]
    spark.createDataFrame([(*o, 100.0 + i) for i, o in enumerate(orders)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").withColumn(
        "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(k, 2, 3, n, 10.0, flag, "F") for k in (1, 4, 5, 6, 8, 9, 12, None) for n, flag in ((1, "A"), (2, "N"), (3, "R"), (7, "A"))],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string").withColumn(
        "l_shipdate", F.lit("1997-01-02").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{sf}/lineitem.parquet")
    tasks = X.tasks(spark, sf)
    videos = (media_records(spark, sf).select(F.col("id").alias("video"), F.struct("*").alias("record"))
              .join(tasks.select(F.concat(F.lit("v"), F.col("src_key").cast("string")).alias("video"), "id"), "video").select("id", "record"))
    want = M.result_documents(tasks, C.video_details(L.task_objects(spark, sf), PM.BASE_URL, PM.BUCKET), X.task_warnings(spark, sf), videos)
    got = PM.q_result_documents(spark, sf)
    assert got.columns == want.columns and got.count() > 12
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = plan_of(PM.q_result_documents(spark, SF_SMALL))
    # records aren't shuffled to find their tasks, and of the tasks only ended ones find theirs
    assert "LeftSemi" in plan and "[video#" not in plan
