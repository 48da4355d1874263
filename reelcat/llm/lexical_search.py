"""Ranked lexical search with norm buckets.

A document is a vector of impacts, an item a vector of weights; a score is their inner
product.  Vectors keep the terms that some item has, since no other counts.  A coordinate is
the impact times the root of its term's weight, and the item's is its count times that root.

Documents are range-partitioned by the length of their vectors and read longest first, in
buckets.  For an item with a 10th best score t so far, its coordinates are taken from the
largest on until what is left of the item, times the bucket's longest vector, is below t
(Cauchy-Schwarz).  Nothing taken: the whole bucket is passed over.  Otherwise only documents in the posting
lists of those coordinates can reach t, and of them those whose product so far plus (rest of the item) x
(rest of the document) does.  Survivors are scored anew in 64-bit integers from all terms; bounds have
a margin over the rounding of doubles, so they never cost a result.

Each task hands on its best ``k`` documents of an item; the best of these are the result, whatever
the partitions were.  Items are answered in blocks of bounded bytes, each block against all documents; only a block's terms and
weights go to the tasks.

Defined cases: null texts and texts without a term match nothing and count in no statistic; a null document id comes
before all others among equal scores and is returned as null; rows that share an id are documents of their own; items that
repeat as whole rows (same id and text) are answered once, and items that share only the id are each
answered; an item without a match has no rows; no documents or no items give an empty result.  Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelcat.llm.common import NO_ID, column, ordered_id, raw, settle, written

K = 10
#: bytes of item texts that are answered together
BLOCK_BYTES = 4 << 20
#: rows and postings of a bucket; a task's first bucket is small, so that bounds are there early
BUCKET_ROWS, FIRST_ROWS, BUCKET_POSTINGS = 8192, 256, 2_000_000
_MARGIN = 1 - 1e-9
#: what a byte is in a term: ASCII letters in lower case, digits, all beyond ASCII; everything else parts terms
_TABLE = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lists(lists: list[np.ndarray], dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype), *lists]).astype(dtype)))


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends with a leading 0) of a list column."""
    lists = column(batch, name)
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[ends[0]:ends[-1]], ends - ends[0]


def _vectors(number):
    """doc_id, number of terms, the block's terms in the text and how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for b in batches:
            ids, n, own, tf = column(b, "_id").to_numpy(), [], [], []
            for text in raw(b):
                found = terms(text)
                counts = Counter(filter(known.__contains__, found))
                n.append(len(found))
                own.append(np.fromiter(map(known.__getitem__, counts), np.int32, len(counts)))
                tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64()), _lists(own, np.int32), _lists(tf, np.int64)], names=["_id", "n", "terms", "tf"])

    return run


def _impacts(n_docs: int, n_terms: int, root):
    """Impacts in place of counts, and the length of each vector; every row has a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ends = _flat(b, "terms")
            tf, _ = _flat(b, "tf")
            m = 25 + 75 * column(b, "n").to_numpy() * n_docs // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends)))
            length = np.sqrt(np.add.reduceat((impact * root.value[own]) ** 2, ends[:-1])) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([column(b, "_id"), pa.array(length), column(b, "terms"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(impact))],
                                             names=["_id", "length", "terms", "impacts"])

    return run


class Item:
    """An item's coordinates from the largest on, what is left of it after each, and its best documents so far."""

    def __init__(self, counts: dict[int, int], weights: np.ndarray, root: np.ndarray):
        own = np.array([t for t in counts if weights[t] > 0], np.int64)
        count = np.array([counts[t] for t in own.tolist()], np.int64)
        by = np.lexsort((own, -(count * root[own])))
        self.terms, self.exact = own[by], (count * weights[own])[by]
        self.value = (count * root[own])[by]
        self.rest = np.sqrt(np.concatenate([np.cumsum(self.value[::-1] ** 2)[::-1], [0.0]]))
        self.best = np.empty((0, 2), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        both = np.concatenate([self.best, np.column_stack([scores, ids])])
        self.best = both[np.lexsort((both[:, 1], -both[:, 0]))][:k]

    def reached(self, k: int) -> int:
        return int(self.best[-1, 0]) if len(self.best) == k else 1


class Bucket:
    """Vectors of similar length, with a posting list for each term."""

    def __init__(self, ids, length, ends, own, impact, root):
        self.ids, self.length, self.ends, self.own, self.impact = ids, length, ends, own, impact
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        by = np.argsort(own, kind="stable")
        self.row, self.value = row[by], (impact * root[own])[by]
        self.ptr = np.searchsorted(own[by], np.arange(len(root) + 1))

    def search(self, item: Item, dense: np.ndarray, k: int) -> None:
        least = item.reached(k) * _MARGIN
        taken = int(np.searchsorted(-(item.rest * self.length.max()), -least, side="right"))
        taken = min(taken, len(item.terms))
        if not taken:
            return
        lists = [(self.ptr[t], self.ptr[t + 1]) for t in item.terms[:taken].tolist()]
        size = [int(j - i) for i, j in lists]
        if not any(size):
            return
        rows = np.concatenate([self.row[i:j] for i, j in lists])
        value = np.concatenate([self.value[i:j] for i, j in lists])
        seen = np.bincount(rows, minlength=len(self.ids)) > 0
        product = np.bincount(rows, np.repeat(item.value[:taken], size) * value, len(self.ids))
        square = np.bincount(rows, value * value, len(self.ids))
        rest = np.sqrt(np.maximum(self.length ** 2 * (1 + 1e-9) - square, 0.0)) * item.rest[taken]
        found = np.flatnonzero(seen & (product * (1 + 1e-9) + rest >= least))
        if not len(found):
            return
        dense[item.terms] = item.exact
        n = self.ends[found + 1] - self.ends[found]
        at = np.repeat(self.ends[found] - np.cumsum(n) + n, n) + np.arange(n.sum())
        scores = np.add.reduceat(dense[self.own[at]] * self.impact[at], np.cumsum(n) - n)
        dense[item.terms] = 0
        good = scores > 0
        item.add(scores[good], self.ids[found][good], k)


def _cuts(ends: np.ndarray, first: bool) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(ends) - 1
    while lo < n:
        rows = FIRST_ROWS if first else BUCKET_ROWS
        hi = max(lo + 1, min(n, lo + rows, int(np.searchsorted(ends, ends[lo] + BUCKET_POSTINGS, side="right")) - 1))
        yield lo, hi
        lo, first = hi, False


def _search(said, k: int):
    """The best documents of every item among a task's, which come longest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, root = said.value
        items = [Item(c, weights, root) for c in counts]
        dense, first = np.zeros(len(weights), np.int64), True
        for b in batches:
            own, ends = _flat(b, "terms")
            impact, _ = _flat(b, "impacts")
            ids, length = column(b, "_id").to_numpy(), column(b, "length").to_numpy()
            for lo, hi in _cuts(ends, first):
                i, j = ends[lo], ends[hi]
                bucket = Bucket(ids[lo:hi], length[lo:hi], ends[lo:hi + 1] - i, own[i:j].astype(np.int64), impact[i:j], root)
                for item in items:
                    bucket.search(item, dense, k)
                first = False
        best = [x.best for x in items]
        both = np.concatenate([np.empty((0, 2), np.int64), *best])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int64), [len(x) for x in best])), pa.array(both[:, 1].copy()), pa.array(both[:, 0].copy())],
                                         names=["_item", "_id", "score"])

    return run


def _block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """_item (place in ``texts``), rank, doc_id, score."""
    spark = docs.sparkSession
    found = [Counter(terms(t.encode())) for t in texts]
    number = {w: i for i, w in enumerate(sorted(set().union(*found)))}
    vectors = written(docs.select(ordered_id().alias("_id"), "text").mapInArrow(_vectors(spark.sparkContext.broadcast(number)), "_id long, n long, terms array<int>, tf array<long>")
                      .where("n > 0"))
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(number))], np.int64)
    root = np.sqrt(weights.astype(float))
    counts = [{number[w]: n for w, n in c.items()} for c in found]
    said, shared_root = spark.sparkContext.broadcast((counts, weights, root)), spark.sparkContext.broadcast(root)
    longest_first = (vectors.where(F.size("terms") > 0).mapInArrow(_impacts(n_docs, n_terms, shared_root), "_id long, length double, terms array<int>, impacts array<long>")
                     .repartitionByRange(F.desc("length"), "_id").sortWithinPartitions(F.desc("length")))
    best = longest_first.mapInArrow(_search(said, k), "_item long, _id long, score long")
    place = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), "_id"))
    return (best.withColumn("rank", place).where(F.col("rank") <= k)
            .select("_item", "rank", F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "score"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item with a score above 0, equal scores by id."""
    spark = docs.sparkSession
    asked = settle(items.select("item_id", "text").where(F.octet_length("text") > 0).distinct())
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) or 1
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        ids = spark.createDataFrame([(r.item_id, i) for i, r in enumerate(own)], f"item_id {items.schema['item_id'].dataType.simpleString()}, _item long")
        ranked = _block(docs, [r.text for r in own], k).join(F.broadcast(ids), "_item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
