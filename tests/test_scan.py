"""The segmented scan equals a plain per-key window, also when one key holds
most rows and is split across many range partitions."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelcat.operators.scan import running
from reelcat.sources.tables import read_table
from tests.conftest import SF_MID


def _reference(df, key, order, value):
    w = Window.partitionBy(*key).orderBy(*order)
    return df.select("event_id", F.row_number().over(w).cast("bigint").alias("rn"),
                     F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                     F.lag("ts").over(w).alias("prev_ts"))


def _check(df, key, n_parts):
    val = F.col("user_id") % 7
    got = running(df, key, ["ts", "event_id"], sums={"s": val}, lags=["ts"], n_parts=n_parts)
    got = got.select("event_id", "rn", "s", "prev_ts")
    ref = _reference(df.withColumn("_v", val), key or [F.lit(0)], ["ts", "event_id"], "_v")
    diff = got.exceptAll(ref).count() + ref.exceptAll(got).count()
    assert diff == 0


def test_hot_key_split_across_partitions(spark):
    ev = read_table(spark, SF_MID, "events").select("event_id", "ts", "user_id")
    # two thirds of all rows on one key
    hot = ev.withColumn("k", F.when(F.col("user_id") % 3 != 0, F.lit(-1)).otherwise(F.col("user_id")))
    _check(hot, ["k"], 16)


def test_global_order_without_key(spark):
    ev = read_table(spark, SF_MID, "events").select("event_id", "ts", "user_id")
    _check(ev, [], 8)


def test_many_small_keys(spark):
    ev = read_table(spark, SF_MID, "events").select("event_id", "ts", "user_id")
    _check(ev.withColumn("k", F.col("user_id")), ["k"], 8)


def test_exact_percentiles_match_builtin(spark):
    from reelcat.operators.scan import exact_percentiles
    ev = read_table(spark, SF_MID, "events").select("event_id", "value", F.col("event_type").alias("k"))
    ps = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_percentiles(ev, ["k"], "value", "event_id", ps)
    ref = ev.groupBy("k").agg(*[F.percentile("value", p).alias(n) for n, p in ps.items()])
    g = {r.k: r for r in got.collect()}
    for r in ref.collect():
        for n in ps:
            assert abs(g[r.k][n] - r[n]) < 1e-9, (r.k, n, g[r.k][n], r[n])


def test_null_keys_and_null_values_equal_a_plain_window(spark):
    rows = [(None if i % 3 == 0 else "k" if i % 3 == 1 else f"u{i}", i, None if i < 600 or i % 5 == 0 else i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = running(df, ["k"], ["i"], sums={"s": F.col("v")}, lags=["v"], n_parts=9)
    w = Window.partitionBy("k").orderBy("i")
    want = df.select("k", "i", "v", F.row_number().over(w).cast("bigint").alias("rn"), F.sum("v").over(w).alias("s"), F.lag("v").over(w).alias("prev_v"))
    cols = ["k", "i", "rn", "s", "prev_v"]
    key = lambda r: r["i"]
    assert sorted(got.select(*cols).collect(), key=key) == sorted(want.select(*cols).collect(), key=key)


# ---- bounds as literals ----------------------------------------------------------

def _odd_rows(spark):
    import datetime
    rows = [(None if i % 7 == 0 else i % 5, None if i % 11 == 0 else datetime.datetime(2024, 3, 31, 0, i % 60, i % 50, i), f"k{i}'\\", (i * 37) % 100 / 8) for i in range(3000)]
    return spark.createDataFrame(rows, "a int, t timestamp_ntz, s string, d double")


def test_ranges_follow_the_sort_order(spark):
    from reelcat.operators.scan import Order, range_bounds, range_of
    df = _odd_rows(spark)
    zoned = df.withColumn("z", F.col("t").cast("timestamp"))
    for names in (["a", "s"], ["-a", "t", "s"], ["t", "-s"], ["-d", "-t", "s"], ["-z", "s"], ["s"]):
        by = Order(names)
        bounds = range_bounds(zoned, by, 12)
        assert len(bounds) == 11
        got = [r.r for r in zoned.orderBy(*by.columns()).select(range_of(by, bounds).alias("r")).collect()]
        assert got == sorted(got) and got[-1] == len(bounds)
        assert max(got.count(r) for r in set(got)) <= 3 * 3000 / 12


def test_a_range_is_the_same_in_every_pass(spark):
    from reelcat.operators.scan import Order, range_bounds, range_of
    df, by = _odd_rows(spark), Order(["t", "s"])
    bounds = range_bounds(df, by, 9)
    one, two = ({r.s: r.r for r in d.select("s", range_of(by, bounds).alias("r")).collect()} for d in (df, df.repartition(7)))
    assert one == two


def test_falling_order_and_no_checkpoint(spark, monkeypatch):
    from pyspark.sql import DataFrame
    monkeypatch.setattr(DataFrame, "checkpoint", None)
    df = _odd_rows(spark).where("t is not null")
    got = running(df, ["a"], ["-t", "s"], sums={"x": F.col("d")}, n_parts=10).select("a", "s", "rn", "x")
    w = Window.partitionBy("a").orderBy(F.col("t").desc(), "s")
    want = df.select("a", "s", F.row_number().over(w).cast("bigint").alias("rn"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
    key = lambda r: r["s"]
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)  # eighths add up exactly


def test_pages_by_bounds(spark):
    from reelcat.operators.scan import page_by_bounds
    df = _odd_rows(spark).select("a", "s", "d")
    for order in (["-a", "s"], ["d", "-s"], ["s"]):
        from reelcat.operators.scan import Order
        whole = df.orderBy(*Order(order).columns()).collect()
        for start, limit, within in ((0, 5, 10), (1498, 7, 10), (1498, 7, 10_000), (2990, 50, 1), (5000, 5, 1)):
            page, total = page_by_bounds(df, order, start, limit, within)
            got = page.orderBy("position").collect()
            assert total == 3000 and [r[:3] for r in got] == [tuple(r) for r in whole[start:start + limit]], (order, start)
            assert [r.position for r in got] == list(range(start + 1, min(3000, start + limit) + 1))
    empty, total = page_by_bounds(df.where("s = ''"), ["s"], 0, 5)
    assert (empty.collect(), total) == ([], 0)


def test_a_deep_page_sorts_the_rows_around_it_only(spark):
    from reelcat.operators.scan import page_by_bounds
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    page, _ = page_by_bounds(spark.range(200_000).withColumn("x", F.col("id")), ["-x"], 150_000, 10, within=1000)
    assert [r.id for r in page.collect()] == list(range(49_999, 49_989, -1))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    offset = int(plan.split("Offset ")[1].split()[0].rstrip("\n"))
    assert offset <= 1000
