"""Language-model scoring with a gated recurrent network.

Words of all training documents are counted (partial counts per task, one shuffle).  The
``HEAD`` most frequent words are known to every task; all others go through a join with the
counts.  The output is factored by classes: P(word) = P(class | state) * P(word | class, state).
Words are put into classes by falling frequency, with equal sums of the root of the counts.  The ``SOFT`` most
frequent words have a softmax of their own inside their class; rarer words form bands of doubling
rank, whose inner probability comes from the counts: (c + 0.5) over the band's sum.  The last band
holds the words outside the head and the unknown, (c + 0.5) / (N' + 0.5 * (V' + 1)), so that
all words together have probability 1.  Biases start at the counts, so training starts at a unigram model.

Training goes once over all training documents, in ``ROUNDS`` rounds.  In a round each task
reads its documents of that round as parallel lanes and takes Adagrad steps by truncated
backpropagation through windows of ``WINDOW`` words, the state being carried from window to window; then the
tasks' models are averaged by the words they saw, in two steps of sums by block of parameters, so
that no task holds many models.  The driver holds one model, whose size is fixed.

Scoring carries a document's state across its windows from its first word to its end, however long it is.

Defined cases: a null text is empty, so it has the end token alone; a null id counts as the empty
string in the held-out rule (crc32 0: not held out) and stays null; rows that repeat are scored (and counted) each;
rows that share an id are documents of their own; without training documents every probability comes from the starting
values; an empty table gives an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heapreplace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import column, raw, rows, written

#: words that every task knows, and the longest of them in bytes
HEAD, HEAD_BYTES = 262_144, 64
#: words with a softmax of their own, and the classes they form
SOFT, CLASSES = 3072, 28
HIDDEN = 16
ROUNDS = 3
#: documents side by side in training and in scoring, and steps between updates
LANES, SCORED_LANES, WINDOW = 768, 1024, 16
RATE = 0.2
#: tokens that are laid out in lanes together
LAYOUT = 4_000_000
#: different words a task holds before it hands on its counts
COUNTED = 400_000
#: parameters in a row while models are averaged, and models that one task adds up
BLOCK, FAN = 8192, 64
END = b""
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def words(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case; the end token isn't among them."""
    return text.translate(_LOWER).split()


# counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)

    for b in batches:
        for text in raw(b):
            found.update(words(text))
            found[END] += 1
            if len(found) > COUNTED:
                yield out()
                found.clear()
    if found:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all ``docs``; the end token is the empty word."""
    return docs.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """The head by falling count, the end token first, and the sums of the rest."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    least: int

    @property
    def rest(self) -> float:
        """Denominator of the words outside the head."""
        return self.total - int(self.counts.sum()) + 0.5 * (self.distinct - int((self.counts > 0).sum()) + 1)

    @property
    def all(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The words above a count that at most ``head`` words reach; the count comes from a histogram of 16 steps per power of two."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = counts.where(F.octet_length("word") <= HEAD_BYTES).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).collect()
    taken, least = 0, 2 ** 62
    for r in sorted(steps, key=lambda r: -r.step):
        taken += r.n
        if taken > head:
            break
        least = r.least
    found = counts.where((F.col("n") >= least) & (F.octet_length("word") <= HEAD_BYTES)).collect()
    known = {r.word.encode(): r.n for r in found}
    end = known.pop(END, None)
    if end is None:  # an end token rarer than the head's words, or no training documents
        end = (counts.where(F.col("word") == "").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    order = sorted(known, key=lambda w: (-known[w], w))
    return Vocabulary([END, *order], np.array([end, *(known[w] for w in order)], np.int64), total, distinct, least)


def outside(counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Counts of the words outside the head."""
    return counts.where(((F.col("n") < vocab.least) | (F.octet_length("word") > HEAD_BYTES)) & (F.col("word") != ""))


# the network


class Shape:
    """Classes of the output and rows of the input for a vocabulary."""

    def __init__(self, vocab: Vocabulary, soft: int = SOFT, classes: int = CLASSES, hidden: int = HIDDEN):
        n = len(vocab.words)
        self.n, self.hidden, self.soft = n, hidden, min(soft, n)
        mass = vocab.counts + 0.5
        part = np.cumsum(np.sqrt(mass[:self.soft]))
        cls = np.minimum((part - np.sqrt(mass[:self.soft]) / 2) * classes / part[-1], classes - 1).astype(np.int64)
        self.bounds = np.flatnonzero(np.concatenate([[True], np.diff(cls) > 0, [True]]))
        inner = np.cumsum(np.concatenate([[0], np.diff(cls) > 0]))
        self.n_soft = len(self.bounds) - 1
        band = np.floor(np.log2(np.arange(self.soft, n) / max(self.soft, 1))).astype(np.int64)
        self.bands = int(band[-1]) + 1 if len(band) else 0
        self.n_classes = self.n_soft + self.bands + 1
        # the id after the head's is any word outside
        self.cls = np.concatenate([inner, self.n_soft + band, [self.n_classes - 1]]).astype(np.int32)
        self.row = np.concatenate([np.arange(self.soft), self.soft + band, [self.soft + self.bands]]).astype(np.int32)
        self.n_rows = self.soft + self.bands + 1
        self.mass = np.append(np.bincount(self.cls[:-1], mass, self.n_classes)[:-1], vocab.rest)
        self.start = np.log(mass[:self.soft] / self.mass[self.cls[:self.soft]])
        #: natural log of the inner probability where it is fixed; a word outside adds its own part later
        self.fixed = np.concatenate([np.zeros(self.soft), np.log(mass[self.soft:] / self.mass[self.cls[self.soft:n]]), [0.0]])

    def parts(self) -> dict[str, tuple]:
        """Parameters; the last row of ``classes`` and the last column of ``words`` are biases."""
        h = self.hidden
        return {"inputs": (self.n_rows, 3 * h), "state": (h, 3 * h), "classes": (h + 1, self.n_classes), "words": (self.soft, h + 1)}

    def first(self, seed: int = 7) -> np.ndarray:
        """Starting values of all parameters, then of their squared steps."""
        rng = np.random.default_rng(seed)
        v = {k: np.zeros(s) for k, s in self.parts().items()}
        v["inputs"] = rng.normal(0, 0.3, v["inputs"].shape)
        v["state"] = rng.normal(0, 1 / math.sqrt(self.hidden), v["state"].shape)
        v["classes"][-1], v["words"][:, -1] = np.log(self.mass / self.mass.sum()), self.start
        flat = np.concatenate([x.ravel() for x in v.values()]).astype(np.float32)
        return np.concatenate([flat, np.full(len(flat), 1.0, np.float32)])


class Network:
    """A gated recurrent unit with class-factored output, on views of one vector of parameters."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        self.value, self.square, at, half = {}, {}, 0, len(flat) // 2
        for k, s in shape.parts().items():
            n = math.prod(s)
            self.value[k] = flat[at:at + n].reshape(s)
            self.square[k] = flat[half + at:half + at + n].reshape(s)
            at += n

    def step(self, k: str, own, gradient: np.ndarray) -> None:
        """One Adagrad step of the part ``own`` of a parameter."""
        s = self.square[k][own] + gradient * gradient
        self.square[k][own] = s
        self.value[k][own] -= RATE * gradient / np.sqrt(s)

    def forward(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (unit, time, lane) after each of the inputs ``x`` (time, lane), from the states ``h`` (unit, lane); ``keep`` is 0 where a document begins."""
        H, U = self.shape.hidden, np.ascontiguousarray(self.value["state"].T)
        # lanes last, so that every gate of all lanes is one stretch of memory
        ahead = np.ascontiguousarray(self.value["inputs"].take(self.shape.row[x], 0).transpose(0, 2, 1))
        out = np.empty((H, *x.shape), np.float32)
        for t in range(len(x)):
            h = h * keep[t]
            g = U @ h
            zr, n = ahead[t, :2 * H], ahead[t, 2 * H:]
            zr += g[:2 * H]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:H], zr[H:]
            n += r * g[2 * H:]
            np.tanh(n, out=n)
            if trace is not None:
                trace.append((h, z, r, n, g[2 * H:]))
            h = h - n
            h *= z
            h += n
            out[:, t] = h
        return out, h

    def output(self, states: np.ndarray, y: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of the words ``y`` after ``states`` (unit, word); with ``learn`` also the gradient of the states (unit, word), and the output's own steps are taken."""
        s, H = self.shape, self.shape.hidden
        classes, inner = self.value["classes"], self.value["words"]
        # words by class, each state with a 1 for the biases
        by = np.argsort(s.cls[y].astype(np.uint16), kind="stable")
        cls, word, place = s.cls[y].take(by), y.take(by), np.arange(len(y))
        h = np.ones((len(y), H + 1), states.dtype)
        h[:, :H] = states.T.take(by, 0)
        # states lie between -1 and 1, so logits are at most the sums of the weights; beyond 60 the greatest is taken off
        far = max(np.abs(classes).sum(0).max(), np.abs(inner).sum(1).max()) > 60

        def exponentials(q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Exponentials of logits, their sums, and the log probability of each row's ``own``."""
            if far:
                q -= q.max(1, keepdims=True)
            mine = q[place[:len(q)], own].astype(np.float64)
            np.exp(q, out=q)
            total = q @ np.ones(q.shape[1], q.dtype)
            return q, total, mine - np.log(total)

        def gradient(q: np.ndarray, total: np.ndarray, own: np.ndarray) -> np.ndarray:
            q /= total[:, None]
            q[place[:len(q)], own] -= 1
            return q

        p, total, log = exponentials(h @ classes, cls)
        log += s.fixed[word]
        back, steps = None, []
        if learn:
            p = gradient(p, total, cls)
            back = p @ classes[:H].T
            steps.append(("classes", ..., h.T @ p))
        ends = np.searchsorted(cls, np.arange(s.n_soft + 1))
        for c in np.flatnonzero(np.diff(ends)).tolist():
            lo, hi = int(s.bounds[c]), int(s.bounds[c + 1])
            if hi - lo == 1:
                continue
            at = slice(ends[c], ends[c + 1])
            own = word[at] - lo
            q, total, mine = exponentials(h[at] @ inner[lo:hi].T, own)
            log[at] += mine
            if learn:
                q = gradient(q, total, own)
                back[at] += q @ inner[lo:hi, :H]
                steps.append(("words", slice(lo, hi), q.T @ h[at]))
        for x in steps:
            self.step(*x)
        in_order = np.empty(len(y))
        in_order[by] = log
        if not learn:
            return in_order, None
        ahead = np.empty_like(back)
        ahead[by] = back
        return in_order, np.ascontiguousarray(ahead.T)

    def backward(self, x: np.ndarray, keep: np.ndarray, trace: list, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the input rows (row numbers, values) and of the state matrix, through one window."""
        H, U = self.shape.hidden, self.value["state"]
        ahead = np.empty((len(x), 3 * H, x.shape[1]), np.float32)
        state, later = np.zeros_like(U), 0.0
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, g = trace[t]
            d = back[:, t] + later
            dz = d * z
            dn = (d - dz) * (1 - n * n)
            ahead[t, :H] = dz * (1 - z) * (h - n)
            inner = dn * r
            ahead[t, H:2 * H] = inner * g * (1 - r)
            ahead[t, 2 * H:] = dn
            own = np.concatenate([ahead[t, :2 * H], inner])
            later = (dz + U @ own) * keep[t]
            state += h @ own.T
        row = self.shape.row[x].ravel()
        by = np.argsort(row.astype(np.uint16) if self.shape.n_rows < 65_536 else row, kind="stable")
        row = row.take(by)
        first = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
        return row[first], np.add.reduceat(ahead.transpose(0, 2, 1).reshape(-1, 3 * H).take(by, 0), first), state

    def learn(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """Steps on one window; (state after it, its log probability before the steps)."""
        trace: list = []
        states, h = self.forward(x, keep, h, trace)
        log, back = self.output(states.reshape(self.shape.hidden, -1), y.ravel(), learn=True)
        own, inputs, state = self.backward(x, keep, trace, back.reshape(states.shape))
        self.step("inputs", own, inputs)
        self.step("state", ..., state)
        return h, float(log.sum())


def train(net: Network, docs: list[np.ndarray], lanes: int = LANES) -> int:
    """One pass over documents (ids with the end token last) as at most ``lanes`` equal parts of one stream; the number of tokens."""
    y = np.concatenate(docs)
    lanes = max(1, min(lanes, len(y) // WINDOW))
    steps = -(-len(y) // lanes)
    keep = np.ones(len(y), np.float32)
    keep[np.cumsum([0, *map(len, docs)])[:-1]] = 0
    x = np.concatenate([[0], y[:-1]])
    lost = lanes * steps - len(y)  # the stream's beginning again, to fill the last lane
    x, y, keep = (np.concatenate([v, np.resize(v, lost)]).reshape(lanes, steps).T for v in (x, y, keep))
    h = np.zeros((net.shape.hidden, lanes), np.float32)
    for t in range(0, steps, WINDOW):
        h, _ = net.learn(x[t:t + WINDOW], y[t:t + WINDOW], keep[t:t + WINDOW], h)
    return sum(map(len, docs))


def log_probabilities(net: Network, docs: list[np.ndarray], lanes: int = SCORED_LANES) -> np.ndarray:
    """Natural log probability of every document (ids with the end token last), its state carried from its first token to its last."""
    if not docs:
        return np.empty(0)
    # whole documents to the lane with the fewest tokens, the longest first; then lanes by falling length
    loads = [(0, k) for k in range(min(lanes, len(docs)))]
    heapify(loads)
    own: list[list[int]] = [[] for _ in loads]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        n, k = loads[0]
        own[k].append(d)
        heapreplace(loads, (n + len(docs[d]), k))
    order = sorted(loads, reverse=True)
    # one flat array, lane after lane: memory follows the tokens, however long one document is
    length = np.array([n for n, _ in order])
    start = np.cumsum(length) - length
    run = [d for _, k in order for d in own[k]]
    y = np.concatenate([docs[d] for d in run])
    x = np.append(np.int32(0), y[:-1])
    size = np.array([len(docs[d]) for d in run])
    begin = np.cumsum(size) - size
    keep = np.ones(len(y), np.float32)
    keep[begin] = 0
    log = np.empty(len(y))
    h = np.zeros((net.shape.hidden, len(order)), np.float32)
    t = 0
    while t < length[0]:
        busy = int(np.searchsorted(-length, -t, side="left"))
        # few lanes go on for longer, but not beyond the end of the shortest
        span = max(WINDOW, min(lanes * WINDOW // busy, int(length[busy - 1]) - t))
        step = t + np.arange(span)[:, None]
        at = np.minimum(start[:busy] + step, len(y) - 1)
        states, h = net.forward(x[at], keep[at], h[:, :busy])
        found, _ = net.output(states.reshape(net.shape.hidden, -1), y[at].ravel())
        used = step < length[:busy]
        log[at[used]] = found[used.ravel()]
        t += span
    out = np.empty(len(docs))
    out[run] = np.add.reduceat(log, begin)
    return out


# over Spark


def _encoded(known):
    """Ids of every document, with the words outside the head beside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(known.value)}
        other = len(number)
        for b in batches:
            ids, outer, n, ends = [], [], [], [0]
            for text in raw(b):
                own = words(text)
                found = np.fromiter(map(number.get, own, repeat(other)), np.int32, len(own))
                ids.append(np.append(found, np.int32(0)).tobytes())
                strange = Counter(own[k] for k in np.flatnonzero(found == other).tolist())
                outer += strange
                n += strange.values()
                ends.append(len(outer))
            each = pa.StructArray.from_arrays([pa.array(outer, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "held_out"), column(b, "_round"), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)],
                                             names=["doc_id", "held_out", "_round", "ids", "outer"])

    return run


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of one or more batches with about LAYOUT tokens, and their ids."""
    held: list[pa.RecordBatch] = []
    docs: list[np.ndarray] = []
    n = 0
    for b in batches:
        ids = [np.frombuffer(x, np.int32) for x in column(b, "ids").to_pylist()]
        rest, at = b.drop_columns(["ids"]), 0
        for k, d in enumerate(ids):
            n += len(d)
            docs.append(d)
            if n >= LAYOUT:
                yield pa.concat_batches([*held, rest.slice(at, k + 1 - at)]), docs
                held, docs, n, at = [], [], 0, k + 1
        if at < b.num_rows:
            held.append(rest.slice(at))
    if docs:
        yield pa.concat_batches(held), docs


def _trained(shape, flat, seed: int):
    """The model after a task's documents, as rows of BLOCK parameters, each multiplied by the number of tokens seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n, part = Network(shape.value, flat.value.copy()), 0, None
        rng = np.random.default_rng(seed)
        for b, docs in _layouts(batches):
            part = int(column(b, "_row")[0].as_py()) if part is None else part
            n += train(net, [docs[k] for k in rng.permutation(len(docs))])
        schema = pa.schema([("_block", pa.int32()), ("_fan", pa.int64()), ("n", pa.float64()), ("sums", pa.list_(pa.float32()))])
        if n:
            cut = range(0, len(net.flat), BLOCK)
            # one number per task: tasks begin at different rows
            yield rows(schema, _block=range(len(cut)), _fan=[part % (1 << 30)] * len(cut), n=[float(n)] * len(cut), sums=[net.flat[i:i + BLOCK] for i in cut])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    n = table.column("n").to_numpy()
    values = [np.array(x, np.float32) for x in table.column("sums").to_pylist()]
    mean = sum(v * (w / n.sum()) for v, w in zip(values, n))
    return pa.table({"_block": table.column("_block").slice(0, 1), "_fan": table.column("_fan").slice(0, 1), "n": [n.sum()], "sums": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})


def fit(encoded: DataFrame, vocab: Vocabulary, shape: Shape, rounds: int = ROUNDS) -> np.ndarray:
    """All parameters after one pass over the training documents of ``encoded``."""
    sc = encoded.sparkSession.sparkContext
    flat, said = shape.first(), sc.broadcast(shape)
    cols = "_block int, _fan long, n double, sums array<float>"
    for k in range(rounds):
        models = (encoded.where(~F.col("held_out") & (F.col("_round") == k)).select("_row", "ids").mapInArrow(_trained(said, sc.broadcast(flat), k), cols)
                  .withColumn("_fan", F.pmod(F.xxhash64("_fan"), F.lit(FAN))))
        found = models.groupBy("_block", "_fan").applyInArrow(_averaged, cols).groupBy("_block").applyInArrow(_averaged, cols).collect()
        if found:
            flat = np.concatenate([np.array(r.sums, np.float32) for r in sorted(found, key=lambda r: r._block)])
    return flat


def _scored(shape, flat, base):
    """Scores of every document but for its words outside the head.  ``base``: log10 of the base probabilities, and 1 if no training document has an end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, (log, never) = Network(shape.value, flat.value), base.value
        for b, docs in _layouts(batches):
            ends = np.cumsum([len(d) for d in docs])
            found = np.concatenate(docs)
            first = ends - np.array([len(d) for d in docs])
            known = np.add.reduceat(found < shape.value.n, first, dtype=np.int64) - never
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "held_out"), column(b, "_row"), pa.array(ends - first), pa.array(known),
                 pa.array(np.add.reduceat(log[found], first)), pa.array(log_probabilities(net, docs) / math.log(10))],
                names=["doc_id", "held_out", "_row", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, training: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) for every row.

    ``training``: rows to learn from, by default those whose id isn't held out.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    out = held_out(F.col("doc_id")) if training is None else ~training
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    counts = written(word_counts(own.where(~F.col("held_out"))))
    vocab = vocabulary(counts)
    shape = Shape(vocab)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).cast("int").alias("_round")
    coded = own.select("doc_id", "held_out", turn, "text").mapInArrow(
        _encoded(sc.broadcast(vocab.words)), "doc_id long, held_out boolean, _round int, ids binary, outer array<struct<word:string,n:bigint>>")
    encoded = written(coded.withColumn("_row", F.monotonically_increasing_id()))
    flat = fit(encoded, vocab, shape, rounds)
    base = np.append(np.log10((vocab.counts + 0.5) / vocab.all), 0.0)
    scored = encoded.select("doc_id", "held_out", "_row", "ids").mapInArrow(
        _scored(sc.broadcast(shape), sc.broadcast(flat), sc.broadcast((base, int(vocab.counts[0] == 0)))),
        "doc_id long, held_out boolean, _row long, n_tokens long, n_known long, base_score double, score double")
    # words outside the head: their counts by a join, their sums back by row
    outer = encoded.where(F.size("outer") > 0).select("_row", F.explode("outer").alias("o")).select("_row", "o.word", "o.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    log = F.log10(c + 0.5)
    sums = (outer.join(outside(counts, vocab).select("word", F.col("n").alias("c")), "word", "left").groupBy("_row")
            .agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_known"), F.sum("n").alias("_n"), F.sum(log * F.col("n")).alias("_log")))
    both = scored.join(sums, "_row", "left")

    def plus(name: str, total: float) -> Column:
        return F.col(name) + F.coalesce(F.col("_log") - F.col("_n") * F.lit(math.log10(total)), F.lit(0.0))

    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("_known"), F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
                       plus("base_score", vocab.all).alias("base_score"), plus("score", vocab.rest).alias("score"))
