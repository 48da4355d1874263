"""Running aggregates per key that stay balanced when one key is huge.

``Window.partitionBy(key)`` sends every row of a key to one task, so a task
that owns a third of the event log would be sorted by a single core.
``running`` computes the same results (row number, running sums, previous-row
values) as a segmented scan:

1. bounds of about equal ranges of ``(key, order)`` from a bounded sample of rows -- a hot key spans
   several ranges, because the bounds include the order columns; they are
   collected once, so each row's range is a comparison with literals, the same in every pass and after a lost executor;
2. local windows inside each (range, key) slice;
3. per-range boundary summaries (at most two rows per range) give,
   for the first key of each range, the count, sums and last row of that
   key in earlier ranges -- the "carry";
4. the carry table (at most one row per range, a proven bound) is
   broadcast and added to the local results.

Both passes read the source; nothing is copied.  ``page_by_bounds`` uses the same bounds to read
one page of an order: rows are counted per range, and only the range that holds the page is looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: sampled rows per range, and the most ranges (a range's bound is a literal of the plan)
SAMPLED, MOST_RANGES = 32, 1024


class Order:
    """Columns to sort by, each a name or ``-name`` for falling order; nulls come first in rising order and last in falling."""

    def __init__(self, names: list[str]):
        self.names = [n.removeprefix("-") for n in names]
        self.falls = [n.startswith("-") for n in names]

    def columns(self) -> list[Column]:
        return [F.col(n).desc() if d else F.col(n).asc() for n, d in zip(self.names, self.falls)]

    def before(self, bound: list[Column | None]) -> Column:
        """Does a row come before a bound (None: null)?"""
        out = F.lit(False)
        for n, falls, b in reversed(list(zip(self.names, self.falls, bound))):
            c = F.col(n)
            if b is None:
                less, same = (c.isNotNull() if falls else F.lit(False)), c.isNull()
            else:
                less, same = (c > b if falls else c.isNull() | (c < b)), c == b
            out = F.coalesce(less, F.lit(False)) | (F.coalesce(same, F.lit(False)) & out)
        return out


def range_bounds(df: DataFrame, order: Order, n: int) -> list[list[Column | None]]:
    """At most ``n`` - 1 rising bounds that cut ``df`` into ranges of about equal size, as literals.

    From the ``SAMPLED * n`` rows with the smallest hashes of the order columns: one pass over these columns.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    named = Order([("-" if d else "") + f"_o{i}" for i, d in enumerate(order.falls)])
    own = df.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order.names)))
    picked = own.orderBy(F.xxhash64(*own.columns), *own.columns).limit(SAMPLED * n)
    place = F.row_number().over(Window.orderBy(*named.columns()))

    def text(c: str, t: str) -> Column:
        return (F.unix_micros(c) if t == "timestamp" else F.col(c)).cast("string").alias(c)

    def literal(v: str | None, t: str) -> Column | None:
        if v is None:
            return None
        return F.timestamp_micros(F.lit(v).cast("bigint")) if t == "timestamp" else F.lit(v).cast(t)

    kinds = [types[c] for c in order.names]
    rows = picked.withColumn("_n", place).where((F.col("_n") % SAMPLED == 0) & (F.col("_n") < SAMPLED * n)).select("_n", *(text(c, t) for c, t in zip(own.columns, kinds))).orderBy("_n").collect()
    return [[literal(v, t) for v, t in zip(r[1:], kinds)] for r in rows]


def range_of(order: Order, bounds: list[list[Column | None]]) -> Column:
    """Number of the range a row falls in, by a tree of comparisons."""
    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order.before(bounds[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    return within(0, len(bounds))


def _ranges(df: DataFrame, n: int | None = None) -> int:
    return min(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)


def page_by_bounds(df: DataFrame, order: list[str], start: int, limit: int, within: int = 10_000) -> tuple[DataFrame, int]:
    """Rows ``start`` to ``start + limit`` of ``df`` in ``order`` with their ``position`` (from 1), and the number of all rows.

    Rows are counted per range; the ranges that hold the page are cut again until the page begins at most ``within`` rows after their
    beginning (or a range can't be cut).  Only these rows, picked by comparisons with literals, are then sorted, and of them no more than that.
    """
    by, part, before, total = Order(order), df, 0, None
    while True:
        bounds = range_bounds(part, by, _ranges(df))
        number = range_of(by, bounds)
        counts = dict(part.groupBy(number.alias("r")).count().collect())
        if total is None:
            total = sum(counts.values())
        first, skipped = 0, 0
        while first < len(bounds) and skipped + counts.get(first, 0) <= start - before:
            skipped += counts.get(first, 0)
            first += 1
        last, held = first, counts.get(first, 0)
        while last < len(bounds) and before + skipped + held < start + limit:
            last += 1
            held += counts.get(last, 0)
        if first > 0:
            part = part.where(~by.before(bounds[first - 1]))
        if last < len(bounds):
            part = part.where(by.before(bounds[last]))
        before += skipped
        if start - before <= within or not bounds or (first, last) == (0, len(bounds)):
            break
    sliced = part.orderBy(*by.columns()).offset(start - before).limit(limit)
    # at most ``limit`` rows reach this window
    place = F.row_number().over(Window.orderBy(*by.columns())) + F.lit(start)
    return sliced.withColumn("position", place.cast("bigint")), total


def running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None,
            lags: list[str] | None = None, n_parts: int | None = None,
            rn_col: str = "rn") -> DataFrame:
    """Add ``rn`` (1-based row number per key in ``order``), a running sum column
    for each entry of ``sums`` (rows from the start of the key up to the current
    row) and ``prev_<c>`` for each column in ``lags``.

    ``order`` must make rows unique within a key and hold no nulls; its entries
    are column names, ``-name`` for falling order (names only when ``lags`` are used).
    ``key`` may be empty for a global order (e.g. queue positions).  ``df`` is read
    twice and must give the same rows each time.
    """
    sums = sums or {}
    lags = lags or []
    kcols = list(key) if key else ["_gk"]
    base = df if key else df.withColumn("_gk", F.lit(0))
    base = base.select("*", *[expr.alias(f"_v_{name}") for name, expr in sums.items()])
    by = Order([*kcols, *order])
    ranged = base.withColumn("_part", range_of(by, range_bounds(base, by, _ranges(df, n_parts))))
    ostruct = F.struct(*order) if lags else None
    order = Order(order).columns()

    w = Window.partitionBy("_part", *kcols).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "*", F.row_number().over(w).alias("_lrn"),
        *[F.sum(f"_v_{s}").over(upto).alias(f"_ls_{s}") for s in sums],
        *[F.lag(c).over(w).alias(f"_lg_{c}") for c in lags])

    kstruct = F.struct(*[F.col(c) for c in kcols])
    totals = ranged.groupBy("_part", *kcols).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums],
        *[F.max_by(F.col(c), ostruct).alias(f"_last_{c}") for c in lags])
    # first and last key of each partition, from the (much smaller) per-key totals
    bounds = totals.groupBy("_part").agg(F.min(kstruct).alias("_first"), F.max(kstruct).alias("_lastk"))
    # bounds has exactly one row per partition: a proven broadcast bound
    edge = (totals.join(F.broadcast(bounds), "_part")
            .where((kstruct == F.col("_first")) | (kstruct == F.col("_lastk"))))
    before = Window.partitionBy(*kcols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    byk = Window.partitionBy(*kcols).orderBy("_part")
    carry = (edge.select(
                "_part", *kcols, (kstruct == F.col("_first")).alias("_is_first"),
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c_n"),
                *[F.sum(f"_t_{s}").over(before).alias(f"_c_{s}") for s in sums],
                *[F.lag(f"_last_{c}").over(byk).alias(f"_cl_{c}") for c in lags])
             .where("_is_first").drop("_is_first"))

    # keys are matched null-safely: rows without a key are one key, as in a window
    carry = carry.select(*[F.col(c).alias(f"_k_{c}") if c in ("_part", *kcols) else F.col(c) for c in carry.columns])
    same = F.col("_part") == F.col("_k__part")
    for c in kcols:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = local.join(F.broadcast(carry), same, "left")

    def total(s: str) -> Column:
        """Local sum plus carry; null only while no row so far had a value."""
        return F.coalesce(F.col(f"_ls_{s}") + F.col(f"_c_{s}"), F.col(f"_ls_{s}"), F.col(f"_c_{s}"))

    out = joined.select(
        *[c for c in df.columns],
        (F.col("_lrn") + F.coalesce(F.col("_c_n"), F.lit(0))).cast("bigint").alias(rn_col),
        *[total(s).alias(s) for s in sums],
        *[F.when(F.col("_lrn") == 1, F.col(f"_cl_{c}")).otherwise(F.col(f"_lg_{c}")).alias(f"prev_{c}")
          for c in lags])
    return out


def exact_percentiles(df: DataFrame, key: list[str], value: str, tie: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles of ``value`` per ``key`` with linear interpolation
    (the same definition as Spark's ``percentile``), without holding a group's
    values in one task.

    Rows are ranked per key with ``running`` (range-partitioned, ``tie`` makes
    the order unique); for each requested fraction ``p`` the rows at 0-based
    ranks ``floor(p*(n-1))`` and ``ceil(p*(n-1))`` are picked and interpolated.
    Returns one row per key with a column per entry of ``ps``.
    """
    vals = df.select(*key, value, tie).where(F.col(value).isNotNull())
    ranked = running(vals, key, [value, tie], rn_col="_rn")
    counts = vals.groupBy(*key).agg(F.count(F.lit(1)).alias("_cnt"))
    # the (key, rank) pairs that are needed, two per fraction: a join on both columns spreads a
    # key with most of the rows over all tasks
    picks = []
    for name, p in ps.items():
        pos = (F.col("_cnt") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (pos - F.floor(pos)).alias("frac"),
                                  (rank.cast("bigint") + 1).alias("rank")))
    wanted = counts.select(*key, F.explode(F.array(*picks)).alias("_w")).select(*key, F.col("_w.rank").alias("_rn"), "_w")
    found = ranked.join(wanted, [*key, "_rn"])
    aggs = []
    for name in ps:
        own = F.col("_w.name") == name
        v_lo = F.max(F.when(own & (F.col("_w.side") == "lo"), F.col(value)))
        v_hi = F.max(F.when(own & (F.col("_w.side") == "hi"), F.col(value)))
        frac = F.max(F.when(own, F.col("_w.frac")))
        aggs.append((v_lo + (v_hi - v_lo) * frac).cast("double").alias(name))
    return found.groupBy(*key).agg(*aggs)
