"""Lexical search, the recurrent language model and periodic runs against brute force, on the table with odd rows and on random ones."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import ROWS, SCHEMA, as_rows, expect, order, tokens

from reelcat.llm import lexical_search, periodic_runs, queries, recurrent_lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "c"][k % 4], 7, 99, 3, True, 5, "x", "y") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# periodic runs


def brute_runs(w, exponent=4, least=6):
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            start, length = i, j - i + p
            if j > i and length >= max(least, exponent * p) and not any(all(w[start + k] == w[start + k + q] for k in range(length - q)) for q in range(1, p)):
                out.append((start, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), max_size=50)


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS, st.lists(st.sampled_from([b"a", b"b", b"e"]), min_size=1, max_size=5), st.integers(0, 30))
def test_runs_equal_brute_force(before, after, root, length):
    w = before + (root * length)[:length] + after
    assert periodic_runs.runs_of_words(w) == brute_runs(w)
    numbers = [{b"a": 3, b"b": 1, b"c": 2, b"dd": 5, b"e": 4}[x] for x in w]
    assert periodic_runs.runs_of_numbers(numbers, 2, 2) == brute_runs(w, 2, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.data())
def test_extensions_and_lyndon_words(numbers, data):
    tree = periodic_runs.SuffixTree(numbers)
    ahead = periodic_runs.Extensions(tree)
    i, j = (data.draw(st.integers(0, len(numbers))) for _ in range(2))
    if i != j:
        want = next((k for k in range(len(numbers)) if max(i, j) + k >= len(numbers) or numbers[i + k] != numbers[j + k]), 0)
        assert ahead.of(np.array([i]), np.array([j])).tolist() == [want]
    suffixes = sorted(range(len(numbers) + 1), key=lambda k: numbers[k:])
    assert tree.ranks() == [suffixes.index(k) for k in range(len(numbers) + 1)]
    falling = sorted(range(len(numbers) + 1), key=lambda k: [-x for x in numbers[k:]])
    assert tree.ranks(True) == [falling.index(k) for k in range(len(numbers) + 1)]
    lyndon = [max(n for n in range(1, len(numbers) - k + 1) if all(numbers[k:k + n] < numbers[k + m:k + n] for m in range(1, n))) for k in range(len(numbers))]
    assert periodic_runs.longest_lyndon(tree.ranks()).tolist() == lyndon


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=120), st.data())
def test_range_minimum(values, data):
    a, b = (np.array(data.draw(st.lists(st.integers(0, len(values) - 1), min_size=8, max_size=8))) for _ in range(2))
    assert periodic_runs.RangeMin(np.array(values)).of(a, b).tolist() == [min(values[min(x, y):max(x, y) + 1]) for x, y in zip(a.tolist(), b.tolist())]


def test_a_long_text_of_one_word_and_a_long_period():
    assert periodic_runs.runs_of_words([b"x"] * 100_000) == [(0, 100_000, 1)]
    rng = random.Random(1)
    w = [str(rng.randrange(400)).encode() for _ in range(5000)] * 4
    assert (0, 20_000, 5000) in periodic_runs.runs_of_words(w)
    assert periodic_runs.runs_of_words(w[1:]) == []  # 3.9998 periods


def test_periodic_runs_of_documents(docs):
    want = []
    for i, t in ROWS:
        w = tokens(t)
        runs = brute_runs(w) if len(w) < 5000 else []
        kept = [x for k, x in enumerate(w) if not any(s + p <= k < s + n for s, n, p in runs)]
        want.append((i, len(w), len(runs), " ".join(kept)))
    got = periodic_runs.periodic_runs(docs)
    assert as_rows(got.select("doc_id", "n_words", F.size("runs").alias("n"), "collapsed"), "doc_id", "n_words", "n", "collapsed") == expect(want)


def test_registered_periodic_runs(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d", "e", "f"], k=rng.randrange(0, 60)))) for i in range(300)] + [(300, None), (301, " \n"), (None, "z " * 9), (5, "a b " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = tokens(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        kept = [x for k, x in enumerate(w) if not any(s + p <= k < s + n for s, n, p in runs)]
        text = " ".join(w) if h % 10 == 0 or runs else None
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     *(hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(kept)))))
        assert text is None or tokens(text) == w
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert as_rows(got, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == expect(want)


# lexical search


def brute_search(rows, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    counts = [(i, collections.Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        asked = collections.Counter(terms(text))
        scored = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m)) for w, q in asked.items() if w in c)
            if s > 0:
                scored.append((-s, order(i), i))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return out


ITEMS = [(1, "Kax kara LON. miq, same"), (2, None), (3, ""), (4, "nowhere to be found zzz"), (5, "token abcdef0123456789abcd ß té日本 日本 😀"), (6, "shared LINE of Some length line"), (6, "ab"), (1, "Kax kara LON. miq, same"),
         (None, "same"), (8, "w " * 50), (9, " ".join(tokens(ROWS[0][1])))]


def test_ranked_search(docs, spark):
    items = spark.createDataFrame([(*x, 1, "x") for x in ITEMS], "item_id long, text string, doc_id int, score string")
    got = lexical_search.ranked_search(docs, items)
    assert as_rows(got, "item_id", "rank", "doc_id", "score") == expect(brute_search(ROWS, [x for x in ITEMS if x[1]]))
    in_blocks = lexical_search.ranked_search(docs, items, k=3, block_bytes=64)
    assert as_rows(in_blocks, "item_id", "rank", "doc_id", "score") == expect(brute_search(ROWS, [x for x in ITEMS if x[1]], 3))


def test_ranked_search_of_many_documents_through_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BUCKET_ROWS", 40)
    monkeypatch.setattr(lexical_search, "FIRST_ROWS", 8)
    rng = random.Random(17)
    vocab = [f"t{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(0, 90)))) for i in range(3000)] + [(4000 + i, "t1 t2 t250") for i in range(500)]
    items = [(i, " ".join(rng.choices(vocab, [w ** 0.5 for w in weights], k=rng.randrange(1, 25)))) for i in range(40)]
    got = lexical_search.ranked_search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert as_rows(got, "item_id", "rank", "doc_id", "score") == expect(brute_search(rows, items))


def test_buckets_are_passed_over():
    root = np.sqrt(np.array([900.0, 100.0]))
    weights = np.array([900, 100])

    def bucket(ids, vectors):
        own = np.array([t for v in vectors for t in v], np.int64)
        impact = np.array([x for v in vectors for x in v.values()], np.int64)
        ends = np.cumsum([0, *map(len, vectors)])
        length = np.sqrt(np.add.reduceat((impact * root[own]) ** 2, ends[:-1]))
        return lexical_search.Bucket(np.array(ids), length, ends, own, impact, root)

    item, dense = lexical_search.Item({0: 1, 1: 1}, weights, root), np.zeros(2, np.int64)
    bucket([1, 2], [{0: 500, 1: 500}, {0: 400}]).search(item, dense, 2)
    assert item.best.tolist() == [[500_000, 1], [360_000, 2]]
    short = bucket([3, 4], [{1: 90}, {0: 5}])
    short.row = None  # a pruned bucket's postings are never read
    short.search(item, dense, 2)
    assert item.best.tolist() == [[500_000, 1], [360_000, 2]]


# the recurrent language model


def brute_base(rows):
    def own(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), ""]

    def out(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

    c = collections.Counter(w for i, t in rows if not out(i) for w in own(t))
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(own(t)), sum(c[w] > 0 for w in own(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own(t)), 6)) for i, t in rows]


@pytest.mark.parametrize("head,soft", [(recurrent_lm.HEAD, recurrent_lm.SOFT), (12, 5)])
def test_base_scores(docs, monkeypatch, head, soft):
    monkeypatch.setattr(recurrent_lm.vocabulary, "__defaults__", (head,))
    monkeypatch.setattr(recurrent_lm.Shape.__init__, "__defaults__", (soft, 3, 8))
    got = recurrent_lm.score_documents(docs)
    found = got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("b"), "score").collect()
    assert expect([tuple(r)[:6] for r in found]) == expect(brute_base(ROWS))
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_no_training_documents(spark, none):
    assert recurrent_lm.score_documents(none).collect() == []
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = recurrent_lm.score_documents(rows, training=F.lit(False)).orderBy("doc_id").collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0), (True, 1, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in got)


def toy(dtype=np.float64):
    vocab = recurrent_lm.Vocabulary([b"", *(b"w%d" % k for k in range(29))], np.array([10, *(50 - k for k in range(29))]), 1500, 45, 2)
    shape = recurrent_lm.Shape(vocab, soft=20, classes=4, hidden=5)
    rng = np.random.default_rng(0)
    flat = shape.first().astype(dtype)
    flat[:len(flat) // 2] += rng.normal(0, 0.3, len(flat) // 2)
    return vocab, shape, flat, rng


def test_gradients_against_differences():
    _, shape, flat, rng = toy()
    x, y, keep = rng.integers(0, 31, (6, 3)), rng.integers(0, 31, (6, 3)), np.ones((6, 3))
    keep[2, 1] = keep[0] = 0

    class Probe(recurrent_lm.Network):
        def step(self, k, own, gradient):
            self.found.setdefault(k, np.zeros_like(self.value[k]))[own] += gradient

    def loss(flat):
        net = recurrent_lm.Network(shape, flat)
        return -net.output(net.forward(x, keep, np.zeros((5, 3)))[0].reshape(5, -1), y.ravel())[0].sum()

    net = Probe(shape, flat.copy())
    net.found = {}
    net.learn(x, y, keep, np.zeros((5, 3)))
    at = 0
    for k, s in shape.parts().items():
        own = net.found[k].ravel()
        for i in rng.choice(len(own), min(len(own), 15), replace=False):
            up, down = flat.copy(), flat.copy()
            up[at + i] += 1e-2
            down[at + i] -= 1e-2
            assert own[i] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=2e-2, abs=5e-3), k
        at += math.prod(s)


def test_all_words_have_probability_one():
    vocab, shape, flat, rng = toy()
    net = recurrent_lm.Network(shape, flat)
    state = rng.normal(0, 1, (5, 1))
    inside = np.exp(net.output(np.repeat(state, 31, 1), np.arange(31))[0])
    # the last is the band of all words outside the head: its inner probabilities are (c + 0.5) / rest, which sum to 1
    assert inside.sum() == pytest.approx(1)
    n_outside, distinct = 1500 - int(vocab.counts.sum()), 45 - 30
    assert vocab.rest == n_outside + 0.5 * (distinct + 1)


def test_lanes_score_like_one_document_at_a_time():
    _, shape, flat, rng = toy(np.float32)
    net = recurrent_lm.Network(shape, flat)
    docs = [np.append(rng.integers(1, 31, n), 0).astype(np.int32) for n in (0, 1, 700, 3, 40, 16, 15, 17, 2, 90, 0, 5)]
    alone = []
    for d in docs:
        h, total = np.zeros((5, 1), np.float32), 0.0
        for x, y in zip([0, *d[:-1]], d):
            states, h = net.forward(np.array([[x]]), np.ones((1, 1), np.float32), h)
            total += net.output(states.reshape(5, 1), np.array([y]))[0][0]
        alone.append(total)
    for lanes in (1, 3, 64):
        assert recurrent_lm.log_probabilities(net, docs, lanes) == pytest.approx(alone, rel=1e-4)


def test_layouts_join_and_cut_batches(monkeypatch):
    monkeypatch.setattr(recurrent_lm, "LAYOUT", 10)
    sizes = [3, 1, 1, 12, 2, 2, 2, 2, 2, 1, 30, 1]
    ids = [np.full(n, k, np.int32).tobytes() for k, n in enumerate(sizes)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(ids, pa.binary())], names=["_row", "ids"])
    for cuts in ([0, 12], [0, 1, 4, 4, 9, 12], list(range(13))):
        found = list(recurrent_lm._layouts(whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])))
        assert [[r["_row"] for r in b.to_pylist()] for b, _ in found] == [[0, 1, 2, 3], [4, 5, 6, 7, 8], [9, 10], [11]]
        assert [[len(d) for d in docs] for _, docs in found] == [[3, 1, 1, 12], [2] * 5, [1, 30], [1]]


def test_one_very_long_document_beside_short_ones():
    _, shape, flat, rng = toy(np.float32)
    docs = [np.append(rng.integers(1, 31, n), 0).astype(np.int32) for n in (60_000, *range(200))]
    net = recurrent_lm.Network(shape, flat)
    tracemalloc.start()
    got = recurrent_lm.log_probabilities(net, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1000 * sum(map(len, docs))  # bytes follow the tokens, not the longest times the lanes
    assert got == pytest.approx(np.concatenate([recurrent_lm.log_probabilities(net, [d]) for d in docs]), rel=1e-4)


def test_the_model_learns_what_follows_what(spark):
    rng = random.Random(5)
    cycle = [f"v{k}" for k in range(12)]
    rows = []
    for i in range(1500):
        at = rng.randrange(12)
        rows.append((i, " ".join(cycle[(at + k) % 12] for k in range(rng.randrange(5, 60)))))
    got = recurrent_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out")
    r = got.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.5  # the next word is certain but for the first and the end
