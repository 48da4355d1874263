"""N-gram Jaccard join: MinHash banding with exact verification.

Each text is the set of its five-word shingles (all its words, if fewer).  Texts
with equal sets are copies: one representative (the smallest id) goes on, however
many copies there are.  Each representative has a MinHash prefix in each of ``TREES`` trees, as one
hashed label; two texts meet in a tree if their labels are equal, and a node is all texts of a label.
The length of the prefixes follows from the constants alone: the longest, from ``LONGEST`` hashes down, with
which two texts of exactly the wanted similarity meet in some tree with the target recall.  So this is
banding; no tries or sorted prefixes are built.

Every pair that meets is verified exactly, once, in the first tree where it meets.  A node of
many texts is cut into blocks; each pair of blocks is one group of bounded size, so no
task holds a node, and pairs stay inside the task: what leaves it is one row per text
(its number of links) and one link per text to the smallest text (by id and hash) it hangs together with.
Nothing is capped.

Defined cases: null and empty texts have no shingles and are copies of each other,
with no links; a null id is smaller than any other and returned as null; rows that
repeat are copies; rows that share an id (null too) but not the text are texts of their own, known by
the id and 64 bits of the text's hash, and are in one class only if links hang them together; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import BASES, NO_ID, U64, Rolling, WordHashes, column, mix, ordered_id, raw, runs_of, settle
from reelcat.llm.components import components

WORDS = 5
SIMILARITY = 0.8
TREES = 16
LONGEST = 10
RECALL = 0.995
#: texts in a block of a node
BLOCK = 256


def recall_at(depth: int, similarity: float = SIMILARITY, trees: int = TREES) -> float:
    """Chance that two texts of this similarity share a prefix of ``depth`` hashes in some tree."""
    return 1.0 - (1.0 - similarity ** depth) ** trees


def prefix_length(similarity: float, recall: float, trees: int = TREES) -> int:
    """Longest prefix that reaches the recall, shortening from LONGEST."""
    depth = LONGEST
    while depth > 1 and recall_at(depth, similarity, trees) < recall:
        depth -= 1
    return depth


def shingles(words: list[bytes], hasher: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    n = len(words)
    if not n:
        return np.empty(0, U64)
    rolling = Rolling(hasher.of(words)[:, 0], BASES[0])
    start = np.arange(max(1, n - WORDS + 1))
    return np.unique(rolling.of(start, np.minimum(start + WORDS, n)))


def _factors(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_111)
    a = rng.integers(0, 2 ** 64, trees * depth, dtype=U64) | U64(1)
    return a, rng.integers(0, 2 ** 64, trees * depth, dtype=U64)


def prefixes(found: np.ndarray, a: np.ndarray, b: np.ndarray, trees: int) -> np.ndarray:
    """One 64-bit label per tree: the tree and the smallest values under its hash functions."""
    with np.errstate(over="ignore"):
        least = np.full(len(a), ~U64(0))
        for i in range(0, len(found), 4096):
            part = found[i:i + 4096]
            for j in range(0, len(a), 16):
                least[j:j + 16] = np.minimum(least[j:j + 16], (part[None, :] * a[j:j + 16, None] + b[j:j + 16, None]).min(1))
        label = np.arange(1, trees + 1, dtype=U64)
        for column_ in least.reshape(trees, -1).T:
            label = mix(label * U64(BASES[1]) + column_)
    return label


def _signatures(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (a, b) = WordHashes(), _factors(trees, depth)
        for batch in batches:
            sets = [shingles(t.split(), hasher) for t in raw(batch)]
            same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            labels = [prefixes(s, a, b, trees).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "_th"), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(labels, pa.binary())],
                                             names=["_id", "_th", "_s1", "_s2", "_labels"])

    return run


class _Node:
    """A group of texts that meet: two blocks of a node, or one."""

    def __init__(self, t: pa.Table):
        labels = np.frombuffer(b"".join(t.column("_labels").to_pylist()), U64).reshape(t.num_rows, -1)
        self.rep, th = t.column("_rep").to_numpy(), t.column("_th").to_numpy()
        _, once = np.unique(np.stack([self.rep, th]), axis=1, return_index=True)  # a row that repeats counts once
        self.at = np.sort(once)  # rows come sorted by (_rep, _th)
        self.rep, self.th, labels, block = self.rep[self.at], th[self.at], labels[self.at], t.column("_block").to_numpy()[self.at]
        node = np.int64(t.column("_node")[0].as_py()).astype(U64)
        tree = int(np.flatnonzero(labels[0] == node)[0])
        self.pairs = np.triu(np.ones((len(self.at),) * 2, bool), 1)
        if t.column("_lo")[0].as_py() != t.column("_hi")[0].as_py():
            self.pairs &= block[:, None] != block
        for k in range(tree):  # these met in an earlier tree
            self.pairs &= labels[:, k][:, None] != labels[:, k]


_KEYS = ["_node", "_lo", "_hi"]


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each group that have a pair to verify there."""
    for t in runs_of(batches, _KEYS):
        if t.num_rows > 1:
            node = _Node(t)
            has = node.pairs.any(0) | node.pairs.any(1)
            if has.any():
                yield from t.take(pa.array(node.at[has])).combine_chunks().to_batches()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column_ = np.cumsum(first) - 1
    several = np.bincount(column_)[column_] > 1
    owner, column_ = owner[several], column_[several]
    _, column_ = np.unique(column_, return_inverse=True)
    out = np.zeros((len(sets),) * 2, np.float32)
    step = max(256, (1 << 21) // len(sets))
    for lo in range(0, int(column_.max()) + 1 if len(column_) else 0, step):
        i, j = np.searchsorted(column_, [lo, lo + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[i:j], column_[i:j] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], pairs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) whose exact Jaccard similarity is high enough."""
    i, j = np.nonzero(pairs)
    size = np.array([len(s) for s in sets])
    near = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
    i, j = i[near], j[near]
    if len(i) > 2 * len(sets):
        shared = shared_counts(sets)[i, j]
    else:
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    good = shared >= similarity * (size[i] + size[j] - shared) - 1e-9
    return i[good], j[good]


def _smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n texts, the first of them that it hangs together with by the links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        if (low == root[i]).all() and (low == root[j]).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
    return root


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for t in runs_of(batches, _KEYS):
            if t.num_rows < 2:
                continue
            node = _Node(t)
            texts = t.column("text").cast(pa.binary()).to_pylist()
            sets = [shingles(texts[k].split(), hasher) for k in node.at]
            i, j = linked(sets, node.pairs, similarity)
            n = np.bincount(np.concatenate([i, j]), minlength=len(sets))
            root = _smallest_reached(len(sets), i, j)
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (node.rep, node.th, n, node.rep[root], node.th[root])],
                                             names=["_rep", "_th", "_n", "_root", "_root_th"])

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "_rep", "_th")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _th, shingle hash) and copies (shingle hash, _rep and _th of the smallest, _copies, _links, _class).

    ``_class`` is the smallest (id, text hash) that a group of copies hangs together with; null without links.
    """
    depth = prefix_length(similarity, recall, trees)
    keyed = docs.select(ordered_id().alias("_id"), _text_hash().alias("_th"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = settle(keyed.select("_id", "_th", "text").mapInArrow(_signatures(trees, depth), "_id long, _th long, _s1 long, _s2 long, _labels binary"))
    classes = settle(signed.groupBy("_s1", "_s2").agg(F.min(F.struct("_id", "_th", "_labels")).alias("_m"), F.count(F.lit(1)).alias("_copies"))
                     .select("_s1", "_s2", F.col("_m._id").alias("_rep"), F.col("_m._th").alias("_th"), F.col("_m._labels").alias("_labels"), "_copies"))
    met = (classes.where("_labels is not null").select("_rep", "_th", "_labels").mapInArrow(_exploded, "_rep long, _th long, _node long"))
    sizes = met.groupBy("_node").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    rows = (met.join(sizes, "_node").withColumn("_blocks", blocks)
            .withColumn("_block", F.expr("cast(pmod(xxhash64(_rep, _th), _blocks) as int)"))
            .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
            .select("_node", F.least("_block", "_other").cast("long").alias("_lo"), F.greatest("_block", "_other").cast("long").alias("_hi"), "_block", "_rep", "_th")
            .join(classes.select("_rep", "_th", "_labels"), ["_rep", "_th"]))
    names = "_node long, _lo long, _hi long, _block int, _rep long, _th long, _labels binary"
    order = [x.split()[0] for x in names.split(", ")]
    meeting = settle(_grouped(rows.select(*order)).mapInArrow(_meeting, names))
    texts = keyed.select(F.col("_id").alias("_rep"), "_th", "text")
    verified = settle(_grouped(meeting.join(texts, ["_rep", "_th"]).select(*order, "text")).mapInArrow(_verified(similarity), "_rep long, _th long, _n long, _root long, _root_th long"))
    degrees = verified.groupBy("_rep", "_th").agg(F.sum("_n").alias("_links"))
    roots = components(verified.select(_node_of("_rep", "_th").alias("a"), _node_of("_root", "_root_th").alias("b")))
    roots = roots.select(F.col("node.id").alias("_rep"), F.col("node.th").alias("_th"), F.col("root").alias("_class"))
    return signed, (classes.drop("_labels").join(degrees, ["_rep", "_th"], "left").join(roots, ["_rep", "_th"], "left"))


def _node_of(rep: str, th: str) -> Column:
    return F.struct(F.col(rep).alias("id"), F.col(th).alias("th"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links, copy_of, n_copies for every row.

    ``class_id``: smallest id of the texts that hang together by links; ``n_links``: number of
    other texts (not counting copies) with at least the wanted similarity;
    ``copy_of``: smallest id with the same shingles, ``n_copies`` of them.  Different classes may have
    the same ``class_id`` where texts share an id; ``one_per_class`` tells them apart.
    """
    signed, known = _classes(docs, **options)
    known = known.select("_s1", "_s2", "_rep", "_copies", "_links", F.col("_class.id").alias("_class"))

    def real(c):
        return F.nullif(c, F.lit(NO_ID))

    return signed.select("_id", "_s1", "_s2").join(settle(known), ["_s1", "_s2"]).select(
        real(F.col("_id")).alias("doc_id"), real(F.coalesce("_class", "_rep")).alias("class_id"), F.coalesce("_links", F.lit(0)).alias("n_links"),
        real(F.col("_rep")).alias("copy_of"), F.col("_copies").alias("n_copies"))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and tree."""
    for b in batches:
        labels = np.frombuffer(b"".join(column(b, "_labels").to_pylist()), np.int64)
        trees = len(labels) // max(1, b.num_rows)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(column(b, n).to_numpy(), trees)) for n in ("_rep", "_th")), pa.array(labels)], names=["_rep", "_th", "_node"])


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The row of each class with the smallest id (and text hash); of rows that repeat its id and text, one stays."""
    _, known = _classes(docs.select("doc_id", "text"), **options)
    kept = known.where(F.col("_class").isNull() | (F.col("_class") == _node_of("_rep", "_th"))).select(F.col("_rep").alias("_id"), "_th")
    rows = docs.select(F.struct("*").alias("_row"), ordered_id().alias("_id"), _text_hash().alias("_th"))
    return rows.join(kept, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select("_row.*")
