"""Rows that a parser can't read give nulls; a job never fails for one value."""

import datetime

import pytest
from pyspark.sql import functions as F

from reelcat.operators import media as D
from reelcat.operators import metrics as M
from reelcat.plans import media as PD

ODD_LINES = [
    None, "", "Traceback (most recent call last):", '  File "x.py", line 3', "2024-01-02 03:04:05,006 - src.tasks - INFO",
    "2024-13-40 25:61:61,999 - src.tasks - ERROR - [t1] Stage 3: x", "2024-01-02 03:04:05,006 - src.tasks - ERROR - [t1] Stage 99999999999999999999999: x",
    "2024-01-02 03:04:05,006 - src.tasks - INFO - [t1] Stage 2: up", "2024-01-02 03:04:05,006 - src.tasks - WARNING - Retrying in 4.5 seconds...",
    "2024-01-02 03:04:06,000 - src.tasks - ERROR - [t1] Timeout during video processing: ", "9999999-01-01", "日本 - ü - INFO - x",
]


def test_log_lines_outside_the_format(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(ODD_LINES)], "event_id long, line string")
    got = {r.event_id: r for r in M.parse_log_lines(lines).collect()}
    assert len(got) == len(ODD_LINES)
    assert all((got[i].logged_at, got[i].level, got[i].stage, got[i].pattern) == (None,) * 4 for i in (0, 1, 2, 3, 4, 10, 11))
    assert (got[5].logged_at, got[5].level, got[5].stage, got[5].task_tag) == (None, "ERROR", 3, "t1")
    assert (got[6].logged_at, got[6].stage) == (datetime.datetime(2024, 1, 2, 3, 4, 5, 6000), None)
    assert (got[7].stage, got[8].pattern, got[9].pattern) == (2, "retry_attempt", "timeout")
    counts = {(r.pattern, r.level): r.n_lines for r in M.log_pattern_counts(M.parse_log_lines(lines)).collect()}
    assert sum(counts.values()) == len(ODD_LINES)
    stages = [tuple(r) for r in M.timeout_stage_counts(M.parse_log_lines(lines.where("event_id in (7, 9)"))).collect()]
    assert stages == [(datetime.datetime(2024, 1, 2), 2, 1)]


def test_upload_days_that_are_no_dates(spark):
    odd = ["20240229", "20230229", "NA", "20241399", "", None, "2024-01-02", "20240102 ", "99999999999"]
    row = {n: F.lit(None).cast("string") for n in D.S.SCALAR_NAMES if n != "upload_date"}
    df = spark.createDataFrame([(x,) for x in odd], "upload_date string").withColumns(row)
    got = {r.upload_date: r.upload_day for r in D.media_info(df).collect()}
    assert got["20240229"] == datetime.date(2024, 2, 29)
    assert all(got[x] is None for x in ("20230229", "NA", "20241399", "", None, "2024-01-02"))
    assert PD.QUERIES


@pytest.mark.parametrize("statuses", [[], ["queued", "processing"], [None, "queued"], ["completed"]])
def test_rates_of_tables_without_terminal_tasks(spark, statuses):
    tasks = spark.createDataFrame([(str(i), s) for i, s in enumerate(statuses)], "id string, status string")
    (r,) = M.completion_rates(tasks).collect()
    assert r.n_tasks == len(statuses)
    assert r.terminal_success_rate == (1.0 if "completed" in statuses else None)
    assert M.status_summary(tasks).count() == len(set(statuses))


@pytest.mark.parametrize("split", [64, 200, 1 << 20])
def test_records_over_file_splits(spark, tmp_path, split):
    """Tracebacks that begin in one split of a file and end in another, lines before the first header, two files."""
    def head(i, text):
        return f"2024-01-02 03:04:{i:02d},000 - src.tasks - {'ERROR' if i % 2 else 'INFO'} - [t{i}] {text}"

    want = []
    for name, n in (("a.log", 20), ("b.log", 7)):
        out = ["lost line", "  another"] if name == "a.log" else []
        if out:
            want.append((None, None, "\n".join(out)))
        for i in range(n):
            trailing = [f"  frame {k} of {i}" if k % 3 else "" for k in range(i % 5)]
            out += [head(i, f"Stage {i}: text"), *trailing]
            want.append((f"t{i}", i, "\n".join(trailing) if trailing else None))
        (tmp_path / name).write_text("\n".join(out) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = M.log_file_lines(spark, str(tmp_path))
        assert split > 1000 or lines.select("file", "block").distinct().count() > 4
        got = [(r.task_tag, r.stage, r.trailing) for r in M.log_records(lines).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=str) == sorted(want, key=str)
