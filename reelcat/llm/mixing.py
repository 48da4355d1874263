"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document
belongs to).  Each pattern offers its words once at no cost, a second time at cost 1,
a third time at cost 2 ... (convex), up to ``max_repeats``; a min-cost flow routes them to the
sources' quotas.  The graph has a node per pattern and source, never per document.  A
pattern's documents are ordered by a seeded hash; the flow's parts are ranges of
that order, whose ends come from exact histograms, so the choice is the same in
every run and whole documents are taken.

Defined cases: a null text or one without words has size 0 and is never taken; a
null source is a source of its own, after all others; an empty membership gives
nothing; rows that repeat (same id, text and
sources) are taken alike, rows that differ in one of them each by itself; an empty table gives an empty
result.  ``max_patterns`` bounds what the driver holds.  Where there are more and each pattern is one source, there
is nothing to route: targets, and the part of every source that is taken once more, are computed as frames, with the same result.
More patterns that overlap stop the job.
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import settle, word_count
from reelcat.llm.histogram import Cut, as_longs, find_cuts, ordered
from reelcat.operators import scan

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 20_240_501
#: parts in which a source's rows meet its target, so that no task holds a large source
SALTS = 32
_LEAST = -(2 ** 63)


def source_order(sources) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def fair_targets(sizes: dict, weights: dict, total: float, cap: float = MAX_REPEATS) -> dict:
    """Shares of ``total`` by weight; none above ``cap`` times its size, the excess shared again by weight."""
    target = dict.fromkeys(sizes, 0.0)
    free, left = [s for s in sizes if sizes[s] > 0], float(min(total, cap * sum(sizes.values())))
    while free:
        unit = left / sum(weights[s] for s in free)
        full = [s for s in free if unit * weights[s] >= cap * sizes[s]]
        for s in full or free:
            target[s] = float(cap * sizes[s]) if full else unit * weights[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        free = [s for s in free if s not in full]
    return target


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) arc of a cheapest maximum flow, by shortest augmenting paths."""
    ends, left, cost, out = [], [], [], {}
    for a, b, cap, c in arcs:
        for x, y, n, d in ((a, b, cap, c), (b, a, 0, -c)):
            out.setdefault(x, []).append(len(ends))
            ends.append(y)
            left.append(n)
            cost.append(d)
    while True:
        far, via, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in out.get(x, ()):
                y, d = ends[e], far[x] + cost[e]
                if left[e] > 0 and d < far.get(y, float("inf")):
                    far[y], via[y] = d, e
                    if y not in queued:
                        queue.append(y)
                        queued.add(y)
        if sink not in far:
            return [left[2 * i + 1] for i in range(len(arcs))]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = ends[via[x] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push


def route(sizes: dict[tuple, int], targets: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple, dict]:
    """Words each pattern gives to each of its sources."""
    patterns, names = list(sizes), source_order(targets)
    node = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    arcs = [(0, 2 + i, sizes[p], e) for i, p in enumerate(patterns) for e in range(max_repeats)]
    links = [(i, s) for i, p in enumerate(patterns) for s in p]
    arcs += [(2 + i, node[s], sizes[patterns[i]] * max_repeats, 0) for i, s in links]
    arcs += [(node[s], 1, round(targets[s]), 0) for s in names]
    flow = min_cost_flow(arcs, 0, 1)[len(patterns) * max_repeats:]
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for (i, s), f in zip(links, flow):
        out[patterns[i]][s] = f
    return out


def _edge(times: int, cut: Cut | None) -> tuple[int, int, int]:
    """A position of a pattern's endlessly repeated order: whole passes, and the key under which documents have one more."""
    return (times, *(as_longs(cut.key) if cut else (_LEAST, _LEAST)))


def _members(sources: Column | None) -> Column:
    return F.array(F.col("source").cast("string")) if sources is None else F.array_sort(F.array_distinct(F.coalesce(sources, F.array())))


def _source_targets(sizes: DataFrame, weights: tuple, total: float, cap: float) -> DataFrame:
    """``_target`` for rows of _null (1: no name), _name and _size: ``fair_targets`` with one aggregation of all sources per round."""
    ranked = scan.running(sizes, [], ["_null", "_name"])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    own = settle(ranked.select("_null", "_name", "_size", weight.cast("double").alias("_weight"), (F.col("_size") * F.lit(cap)).cast("double").alias("_most")))
    total = float(min(total, cap * (own.agg(F.sum("_size")).first()[0] or 0)))
    unit, n_full = 0.0, -1
    while True:  # the unit rises, so a source that is full stays full
        full = F.lit(unit) * F.col("_weight") >= F.col("_most")
        r = own.where("_size > 0").agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0.0)).alias("taken"),
                                       F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)).alias("free")).first()
        if r.n == n_full:
            break
        n_full = r.n
        unit = (total - r.taken) / r.free if r.free else float("inf")
    return own.withColumn("_target", F.when(F.col("_size") == 0, 0.0).otherwise(F.when(full, F.col("_most")).otherwise(F.lit(unit) * F.col("_weight"))))


def _mix_by_source(base: DataFrame, weights: tuple, share: float, max_repeats: int) -> DataFrame:
    """The mix where no row belongs to two sources, for any number of sources."""
    own = base.withColumn("_source", F.try_element_at("_in", F.lit(1)))
    own = own.withColumn("_null", F.col("_source").isNull().cast("int")).withColumn("_name", F.coalesce("_source", F.lit("")))
    sourced = own.where(F.size("_in") == 1)
    words = base.agg(F.sum("_w")).first()[0] or 0
    targets = settle(_source_targets(sourced.groupBy("_null", "_name").agg(F.sum("_w").alias("_size")), weights, share * words, max_repeats))
    most = F.least(F.bround("_target").cast("long"), F.col("_size") * max_repeats)
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    targets = targets.select("_null", "_name", "_size", "_target", F.expr("nullif(_size, 0)").alias("_some"), most.alias("_most_words"), parts)
    targets = targets.select("_null", "_name", "_salt", "_size", "_target", F.expr("coalesce(_most_words div _some, 0)").alias("_n"), F.expr("coalesce(_most_words % _some, 0)").alias("_rest"))
    salt = F.pmod(F.col("_k1").bitwiseXOR(F.col("_k2")), F.lit(SALTS)).cast("int").alias("_salt")
    place = ["_null", "_name", "_salt"]
    # rows of one key are taken alike; a key is taken once more if that brings its source nearer to its target
    keys = (sourced.where("_w > 0").groupBy("_null", "_name", "_k1", "_k2").agg(F.sum("_w").alias("_w"))
            .withColumn("_o1", ordered(F.col("_k1"))).withColumn("_o2", ordered(F.col("_k2"))))
    summed = scan.running(settle(keys), ["_null", "_name"], ["_o1", "_o2"], sums={"_upto": F.col("_w")})
    over = F.col("_upto") - F.col("_rest")
    more = (summed.select("*", salt).join(targets, place).where((over <= 0) | (F.col("_w") - over > over))
            .select("_null", "_name", "_k1", "_k2", F.lit(1).alias("_more")))
    both = (own.select("*", F.when(F.size("_in") == 1, salt).otherwise(F.lit(None)).alias("_salt")).join(targets, place, "left")
            .join(more, ["_null", "_name", "_k1", "_k2"], "left"))
    times = F.when((F.col("_w") > 0) & (F.size("_in") == 1), F.col("_n") + F.coalesce("_more", F.lit(0))).otherwise(0).cast("long")
    one = F.struct(F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("_size").alias("source_size"), times.alias("times"))
    return both.select("doc_id", F.col("_k2").alias("text_hash"), F.col("_w").alias("size"), F.col("_in").alias("sources"),
                       F.filter(F.array(one), lambda x: F.size("_in") == 1).alias("shares"), times.alias("times"), (times * F.col("_w")).alias("taken"))


def mix_sources(docs: DataFrame, sources: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE,
                max_repeats: int = MAX_REPEATS, seed: int = SEED, max_patterns: int = 20_000) -> DataFrame:
    """doc_id, text_hash, size, sources, shares, times, taken for every row.

    ``sources``: array of the sources a row belongs to; by default its ``source`` alone.  A source's
    size counts all rows that belong to it; targets are ``share`` of all words, split by ``weights``
    repeated over the sources in order.  ``shares`` has for each of the row's sources its target, its
    size and how often the row is taken for it; ``times`` is their sum and ``taken`` the words of that.
    """
    spark = docs.sparkSession
    base = settle(docs.select("doc_id", word_count(F.col("text")).alias("_w"), _members(sources).alias("_in"),
                              F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_k1"), F.xxhash64(F.col("text")).alias("_k2")))
    found = base.groupBy("_in").agg(F.sum("_w").alias("w")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        if base.where(F.size("_in") > 1).limit(1).count():
            raise ValueError(f"more than {max_patterns} overlapping membership patterns")
        return _mix_by_source(base, weights, share, max_repeats)
    sizes = {tuple(r._in): int(r.w) for r in sorted(found, key=lambda r: [(x is None, x or "") for x in r._in])}
    names = source_order({s for p in sizes for s in p})
    per_source = {s: sum(n for p, n in sizes.items() if s in p) for s in names}
    targets = fair_targets(per_source, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(sizes.values()), max_repeats)
    flows = route(sizes, targets, max_repeats)

    ends = {p: list(accumulate(flows[p][s] for s in p)) for p in sizes}
    number = {p: g for g, p in enumerate(sizes)}
    index = spark.createDataFrame([(list(p), g) for p, g in number.items()], "_in array<string>, _g long")
    keyed = base.join(F.broadcast(index), "_in")
    cuts = find_cuts(keyed, {number[p]: [(float(e % n), 0.0, 0.0) for e in ends[p]] for p, n in sizes.items() if n})
    plans = []
    for p, n in sizes.items():
        edges = [_edge(0, None), *(_edge(e // n, c) if n else _edge(0, None) for e, c in zip(ends[p], cuts.get(number[p], p)))]
        plans.append((list(p), [(s, targets[s], per_source[s], *edges[k + 1], *edges[k]) for k, s in enumerate(p)]))
    one = "struct<source:string,target:double,source_size:bigint,n:bigint,k1:bigint,k2:bigint,n0:bigint,k10:bigint,k20:bigint>"
    plan = spark.createDataFrame(plans, f"_in array<string>, _plan array<{one}>")
    key = F.struct(ordered(F.col("_k1")), ordered(F.col("_k2")))

    def below(n: Column, k1: Column, k2: Column) -> Column:
        return n + F.when(key < F.struct(k1, k2), 1).otherwise(0)

    def share_of(x: Column) -> Column:
        times = F.when(F.col("_w") > 0, below(x["n"], x["k1"], x["k2"]) - below(x["n0"], x["k10"], x["k20"])).otherwise(0)
        return F.struct(x["source"].alias("source"), x["target"].alias("target"), x["source_size"].alias("source_size"), times.alias("times"))

    return (base.join(F.broadcast(plan), "_in").withColumn("shares", F.transform("_plan", share_of))
            .withColumn("times", F.aggregate("shares", F.lit(0).cast("long"), lambda n, x: n + x["times"]))
            .select("doc_id", F.col("_k2").alias("text_hash"), F.col("_w").alias("size"), F.col("_in").alias("sources"), "shares", "times",
                    (F.col("times") * F.col("_w")).alias("taken")))


def mixed_documents(docs: DataFrame, sources: Column | None = None, **options) -> DataFrame:
    """The documents with each row repeated as often as the mix takes it; rows not taken go."""
    plan = (mix_sources(docs, sources, **options).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), F.col("sources").alias("_from"))
            .agg(F.max("times").cast("int").alias("_times")))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_h"), _members(sources).alias("_in"))
    both = rows.join(plan.where("_times > 0"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")) & (F.col("_in") == F.col("_from")))
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
