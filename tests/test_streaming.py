"""Streams (availableNow) equal their batch twins on the rows the watermark closed."""

import pytest
from pyspark.sql import functions as F

from reelcat.operators import identity as I
from reelcat.operators import lifecycle as L
from reelcat.operators import metrics as M
from reelcat.plans import streaming as PS
from reelcat.sources import fixtures as X
from reelcat.streaming import jobs as J
from tests.conftest import SF_MID, SF_SMALL


def _same(a, b):
    """Multiset equality of two small results (rows compared on the driver in tests only)."""
    cols = sorted(a.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted(a.select(*cols).collect(), key=key) == sorted(b.select(*cols).collect(), key=key)


def test_stream_timeouts_equal_batch_up_to_watermark(spark):
    stream = PS.q_stream_timeouts(spark, SF_MID).select("task_id", "event_id")
    batch = L.timeouts(X.task_events(spark, SF_MID))
    last = stream.agg(F.max("event_id")).first()[0]
    assert stream.count() == 1933
    assert batch.count() == 1939
    assert _same(stream, batch.where(F.col("event_id") <= last).select("task_id", "event_id"))


def test_stream_failure_rate_equals_batch_on_closed_windows(spark):
    stream = PS.q_stream_failure_rate(spark, SF_MID)
    batch = M.failure_rate_windows(X.task_events(spark, SF_MID))
    cols = ["n_events", "n_failed", "n_completed", "failure_rate", "alert"]
    s = stream.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), *cols)
    b = batch.join(s.select("window_start"), "window_start", "left_semi").select("window_start", *cols)
    assert s.count() == batch.count() - 1  # the last day is still open
    assert _same(s, b)


def test_stream_task_state_equals_batch(spark):
    stream = PS.q_stream_task_state(spark, SF_MID).select("task_id", "status", "event_id")
    batch = L.latest_task_state(X.task_events(spark, SF_MID)).select("task_id", "status", "event_id")
    assert _same(stream, batch)


def test_stream_outbox_equals_batch(spark):
    stream = PS.q_stream_outbox(spark, SF_MID).select("task_id", "event_id", "attempt", "delay_s")
    batch = M.event_outbox(X.task_events(spark, SF_MID)).select("task_id", "event_id", "attempt", "delay_s")
    assert _same(stream, batch)


def test_stream_submissions_equal_batch_ids(spark):
    stream = PS.q_stream_submissions(spark, SF_MID).select("id")
    accepted, _ = I.dedupe_submissions(X.submissions(spark, SF_MID), X.tasks(spark, SF_MID))
    assert _same(stream, accepted.select("id"))


def test_stream_progress_equals_batch_on_closed_windows(spark):
    stream = PS.q_stream_progress(spark, SF_MID)
    batch = M.progress_windows(X.task_events(spark, SF_MID))
    s = stream.select("task_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "bytes", "n_chunks")
    b = batch.join(s.select("task_id", "window_start"), ["task_id", "window_start"], "left_semi").select(
        "task_id", "window_start", "bytes", "n_chunks")
    assert s.count() >= batch.count() - 2
    assert _same(s, b)


def test_snapshot_merge_over_epochs_and_replay(spark):
    from reelcat.streaming import jobs as J
    ev = J.stream_task_state(X.task_events(spark, SF_MID))
    first, second = ev.where(F.col("event_id") < 5000), ev.where(F.col("event_id") >= 5000)
    out = J.scratch(spark, "snapshot-test")
    J.snapshot_merge_batch(first, 0, out)
    J.snapshot_merge_batch(second, 1, out)
    J.snapshot_merge_batch(second, 1, out)  # a replayed epoch rewrites its own version only
    got = J.latest_snapshot(spark, out).select("task_id", "status", "event_id")
    want = L.latest_task_state(X.task_events(spark, SF_MID)).select("task_id", "status", "event_id")
    assert _same(got, want)


def test_new_tasks_batch_keeps_primary_key_across_epochs(spark):
    from reelcat.streaming import jobs as J
    queued = I.submit_tasks(X.submissions(spark, SF_MID)).dropDuplicates(["id"])
    known = J.write_known_tasks(X.tasks(spark, SF_MID), J.scratch(spark, "known-test"))
    out = J.scratch(spark, "new-tasks-test")
    body = J.new_tasks_batch(known)
    body(queued, 0, out)
    body(queued, 1, out)  # the same ids again: nothing new
    body(queued, 1, out)  # replay of epoch 1
    table = J.task_table(spark, out)
    accepted, _ = I.dedupe_submissions(X.submissions(spark, SF_MID), X.tasks(spark, SF_MID))
    assert (table.version().epoch, table.version().rows) == (1, table.version(0).rows)
    assert _same(table.read().select("id"), accepted.select("id"))


# ---- input layout, broken state, session zone --------------------------------

def _layouts(spark, tmp_path, name):
    """The same table as one file, and as a folder of four files dealt by hash."""
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir(), many.mkdir()
    (one / f"{name}.parquet").symlink_to(f"{SF_SMALL}/{name}.parquet")
    spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(4).write.parquet(str(many / f"{name}.parquet"))
    return str(one), str(many)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_outbox_is_the_same_for_one_file_and_four(spark, tmp_path):
    found = []
    for sf, files in zip(_layouts(spark, tmp_path, "events"), (None, 1)):
        out = J.run_to_table(J.stream_outbox(J.task_event_stream(spark, sf, files)), "t-outbox", foreach_batch=J.outbox_batch)
        found.append(_rows(J.event_table(spark, out).read().select("event_id", "attempt", "send_after")))
    assert found[0] == found[1]
    assert len(found[0]) == M.event_outbox(X.task_events(spark, SF_SMALL)).count()


def test_submissions_are_the_same_for_one_file_and_four(spark, tmp_path):
    known = J.write_known_tasks(X.tasks(spark, SF_SMALL).limit(0), J.scratch(spark, "t-known"))
    found = []
    for sf, files in zip(_layouts(spark, tmp_path, "orders"), (None, 1)):
        out = J.run_to_table(J.stream_submissions(J.submission_stream(spark, sf, files)), "t-submissions", foreach_batch=J.new_tasks_batch(known))
        found.append(_rows(J.task_table(spark, out).read().select("id", "status")))
    assert found[0] == found[1]
    assert len({r[0] for r in found[0]}) == len(found[0])


def test_task_state_from_four_files_and_a_broken_version(spark, tmp_path):
    _, many = _layouts(spark, tmp_path, "events")
    out = J.run_to_table(J.stream_task_state(J.task_event_stream(spark, many, 1)), "t-state", foreach_batch=J.snapshot_merge_batch)
    state = J.latest_snapshot(spark, out)
    batch = L.latest_task_state(X.task_events(spark, SF_SMALL))
    assert _rows(state.select("task_id", "event_id")) == _rows(batch.select("task_id", "event_id"))
    bad = tmp_path / "state" / "versions"
    bad.mkdir(parents=True)
    (bad / f"{0:020d}").write_text("not a version")
    with pytest.raises(ValueError):
        J.snapshot_merge_batch(state.limit(1), 1, str(tmp_path / "state"))


def test_failure_rate_does_not_follow_the_session_zone(spark):
    want = _rows(PS.q_stream_failure_rate(spark, SF_SMALL))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert _rows(PS.q_stream_failure_rate(spark, SF_SMALL)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# ---- jobs that go on -----------------------------------------------------------

def _parts(spark, tmp_path, name, n=4):
    """The files of a table, one after another into the folder that a stream watches."""
    spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(n, F.col(spark.read.parquet(f"{SF_SMALL}/{name}.parquet").columns[0])).write.parquet(str(tmp_path / "dealt"))
    files = sorted((tmp_path / "dealt").glob("*.parquet"))
    folder = tmp_path / "live" / f"{name}.parquet"
    folder.mkdir(parents=True)

    def give(k):
        files[k].rename(folder / f"part-{k}.parquet")

    return str(tmp_path / "live"), len(files), give


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    sf, n, give = _parts(spark, tmp_path, "events")
    roots = {k: str(tmp_path / k) for k in ("state", "outbox")}
    versions = []
    for k in range(n):
        give(k)
        state = J.run_to_table(J.stream_task_state(J.task_event_stream(spark, sf)), "", foreach_batch=J.snapshot_merge_batch, root=roots["state"])
        sent = J.run_to_table(J.stream_outbox(J.task_event_stream(spark, sf)), "", foreach_batch=J.outbox_batch, root=roots["outbox"])
        versions.append(J.event_table(spark, sent).version().epoch)
    assert versions == list(range(n))  # one batch of new input each time, none read again
    batch = L.latest_task_state(X.task_events(spark, SF_SMALL))
    assert _rows(J.latest_snapshot(spark, state).select("task_id", "event_id", "status")) == _rows(batch.select("task_id", "event_id", "status"))
    assert _rows(J.event_table(spark, sent).read().select("event_id", "attempt")) == _rows(M.event_outbox(X.task_events(spark, SF_SMALL)).select("event_id", "attempt"))
    again = J.run_to_table(J.stream_outbox(J.task_event_stream(spark, sf)), "", foreach_batch=J.outbox_batch, root=roots["outbox"])
    assert J.event_table(spark, again).version().epoch == n - 1


@pytest.mark.parametrize("late", [False, True])
def test_a_batch_that_fails_is_applied_once(spark, tmp_path, late):
    """The sink fails before it writes, or after its version is there and before the stream knows."""
    sf, n, give = _parts(spark, tmp_path, "events", 2)
    fail = {1}

    def sink(batch, epoch, out):
        if epoch in fail and not late:
            raise RuntimeError("lost")
        J.outbox_batch(batch, epoch, out)
        if epoch in fail:
            raise RuntimeError("lost")

    run = lambda: J.run_to_table(J.stream_outbox(J.task_event_stream(spark, sf)), "", foreach_batch=sink, root=str(tmp_path / "job"))
    give(0)
    run()
    give(1)
    with pytest.raises(Exception, match="lost"):
        run()
    fail.clear()
    out = run()
    want = M.event_outbox(X.task_events(spark, SF_SMALL)).select("event_id", "attempt")
    assert _rows(J.event_table(spark, out).read().select("event_id", "attempt")) == _rows(want)


def test_success_marks_do_not_matter(spark):
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        out = J.scratch(spark, "no-marks")
        batch = J.stream_outbox(X.task_events(spark, SF_SMALL))
        J.outbox_batch(batch, 0, out)
        J.outbox_batch(batch, 1, out)
        J.snapshot_merge_batch(J.stream_task_state(X.task_events(spark, SF_SMALL)), 0, out + "-state")
        assert J.event_table(spark, out).read().count() == batch.count()
        assert J.latest_snapshot(spark, out + "-state").count() == L.latest_task_state(X.task_events(spark, SF_SMALL)).count()
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_snapshot_batches_write_what_they_hold(spark):
    out = J.scratch(spark, "follow")
    rows = spark.range(40_000).selectExpr("concat('t', id) AS task_id", "'queued' AS status", "timestamp_micros(id) AS updated_at", "id AS event_id")
    J.snapshot_merge_batch(rows, 0, out)
    state = J.KeyedTable(spark, out, "task_id")
    first = {p.folder for p in state.version().parts}
    added = 0
    for k in range(1, 9):
        some = spark.range(50).selectExpr(f"concat('t', id * {k}) AS task_id", "'processing' AS status", f"timestamp_seconds({k} * 1000) AS updated_at", f"50000 + {k} * 100 + id AS event_id")
        before = {p.folder for p in state.version().parts}
        J.snapshot_merge_batch(some, k, out)
        added += sum(p.rows for p in state.version().parts if p.folder not in before)
    assert first <= {p.folder for p in state.version().parts}  # the large run is never written again
    assert added <= 8 * 50 * 4
    assert len({p.run for p in state.version().parts}) <= 5
    got = {r.task_id: r.status for r in J.latest_snapshot(spark, out).collect()}
    assert len(got) == 40_000 and got["t0"] == got["t392"] == "processing" and got["t393"] == "queued"


def test_submissions_read_only_parts_that_may_hold_their_ids(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    known = J.write_known_tasks(spark.range(0, 100_000, 1, 8).selectExpr("lpad(cast(id as string), 8, '0') AS id", "1 AS x"), J.scratch(spark, "known"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = []
    whole = J.KeyedTable.read
    monkeypatch.setattr(J.KeyedTable, "read", lambda self, version=None, parts=None: seen.append(parts) or whole(self, version, parts))
    batch = spark.createDataFrame([("00000005", "u", 1), ("zz", "u", 1)], "id string, video_url string, created_at long")
    out = J.scratch(spark, "added")
    J.new_tasks_batch(known)(batch, 0, out)
    assert len(seen) == 1 and len(seen[0]) <= 2 < len(J.task_table(spark, known).version().parts)
    assert [r.id for r in J.task_table(spark, out).read().collect()] == ["zz"]


def test_kept_attempts_equal_the_log(spark):
    from reelcat.operators.lifecycle import event_attempts
    events = X.task_events(spark, SF_MID).withColumn("ts", J.utc_instant("ts"))
    out = J.scratch(spark, "attempts")
    starts = J.attempt_starts(events)
    for k in range(5):  # in another order than that of time
        J.attempt_starts_batch(starts.where(F.col("event_id") % 5 == (3 * k) % 5), k, out)
    J.attempt_starts_batch(starts, 4, out)  # replayed
    asked = starts.where("event_id % 7 = 0").select("task_id", "event_id", F.col("ts").alias("started_at"))
    got = J.kept_attempts(asked, out).join(asked.select("event_id"), "event_id", "left_semi")
    want = event_attempts(X.task_events(spark, SF_MID)).join(asked.select("event_id"), "event_id", "left_semi")
    assert _rows(got.select("event_id", "attempt")) == _rows(want.select("event_id", "attempt"))
