"""Failure windows that keep late events: windows and late rows are together the input."""

import datetime as dt

import pytest

from reelcat.streaming import jobs as J

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2025, 3, 1, 12, tzinfo=dt.timezone.utc)
SCHEMA = "event_id long, task_id string, event string, ts timestamp"
BATCHES = [
    [(1, "a", "failed", T0), (2, "a", "queued", T0 + DAY), (3, "b", "completed", T0 + 2 * DAY)],
    # of the closed first day, of the day before the newest (closed too), of the newest day, of a day before all, without a time, no status
    [(4, "a", "failed", T0), (5, "b", "failed", T0 + DAY), (6, "c", "failed", T0 + 2 * DAY), (7, "c", "completed", T0 - 40 * DAY), (8, None, "queued", None),
     (9, "c", "progress", T0)],
    [(10, "d", "failed", T0 + 2 * DAY), (11, "d", "processing", T0 + 9 * DAY)],
    [(12, "e", "failed", T0 + 2 * DAY), (13, "e", "completed", T0 + 9 * DAY), (14, "e", "completed", dt.datetime(2025, 3, 10, tzinfo=dt.timezone.utc))],
]


def write(spark, folder, k):
    spark.createDataFrame(BATCHES[k], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, root, sink=None):
    events = spark.readStream.schema(SCHEMA).parquet(folder)
    return J.run_to_table(J.status_events(events), "", foreach_batch=sink or J.failure_windows_batch(), root=root)


def brute():
    """Windows and late ids, batch by batch."""
    windows, late, newest = {}, {}, None
    for k, batch in enumerate(BATCHES):
        rows = [r for r in batch if r[2] != "progress"]
        for i, _, event, ts in rows:
            day = ts and ts.date()
            if day is None or (newest and dt.datetime.combine(day, dt.time(), dt.timezone.utc) + DAY <= newest - dt.timedelta(minutes=10)):
                late[i] = k
            else:
                w = windows.setdefault(day, [0, 0, 0])
                w[0] += 1
                w[1] += event == "failed"
                w[2] += event == "completed"
        newest = max(x for x in [newest, *(r[3] for r in rows)] if x)
    return windows, late


@pytest.mark.parametrize("fails", [None, "late", "windows", "marks"])
def test_windows_and_late_rows_are_the_input(spark, tmp_path, fails, monkeypatch):
    folder, root = str(tmp_path / "in"), str(tmp_path / "job")
    plain = J.KeyedTable.append
    for k in range(len(BATCHES)):
        write(spark, folder, k)
        if fails and k == 1:  # the batch stops before this table has it, and is repeated
            def append(self, rows, epoch=None):
                if self.path.endswith(fails):
                    raise OSError("lost")
                return plain(self, rows, epoch)
            monkeypatch.setattr(J.KeyedTable, "append", append)
            with pytest.raises(Exception, match="lost"):
                run(spark, folder, root)
            monkeypatch.setattr(J.KeyedTable, "append", plain)
        out = run(spark, folder, root)
    windows, late = brute()
    found = J.failure_windows(spark, out).selectExpr("*", "unix_micros(window_start) as s").collect()
    got = {(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r.s)).date(): [r.n_events, r.n_failed, r.n_completed] for r in found}
    assert got == windows
    assert {r.event_id: r.epoch for r in J.late_events(spark, out).collect()} == late
    assert set(late) == {4, 5, 7, 8, 12}
    n = sum(1 for b in BATCHES for r in b if r[2] != "progress")
    assert sum(w[0] for w in windows.values()) + len(late) == n
    mark = J._mark_sums(J.window_tables(spark, out)[2].read()).first()
    assert (mark.n_rows, mark.n_late) == (n, len(late))


def test_closed_windows_equal_the_watermarked_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    plain = str(tmp_path / "plain")
    for k in range(len(BATCHES)):
        write(spark, folder, k)
        out = run(spark, folder, str(tmp_path / "job"))
        events = spark.readStream.schema(SCHEMA).parquet(folder)
        rates = J.run_to_table(J.stream_failure_rate(events), "", root=plain)
    cols = ["window_start", "window_end", "n_events", "n_failed", "n_completed", "failure_rate", "alert"]
    closed = J.failure_windows(spark, out).where("closed").select(cols).collect()
    assert closed and sorted(closed) == sorted(spark.read.parquet(rates).select(cols).collect())


def test_no_events(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", "progress", T0), (2, "a", "failed", None)], SCHEMA).coalesce(1).write.parquet(folder)
    out = run(spark, folder, str(tmp_path / "job"))
    assert J.failure_windows(spark, out).count() == 0
    assert [r.event_id for r in J.late_events(spark, out).collect()] == [2]
