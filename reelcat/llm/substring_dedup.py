"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are parsed against reference blocks.  A block is the stretch of words
around one anchor: the smallest hash of ``GRAM`` words within a window of ``WINDOW``
words, so equal windows have the same anchor at the same place wherever they
occur, and a document falls into the same blocks wherever a passage is repeated.
The index holds, for every block that several documents might share, the smallest
document with it; each is kept once however many documents repeat it.

* A block of a document that a smaller document holds as a whole is one factor: every
  window in it is a repeat.
* A block that no smaller document holds as a whole may still begin or end with a
  repeated passage: a factor boundary.  Its windows are looked up one by one among the windows of
  the other blocks with the same anchor.

Neighbouring factors join greedily into the longest spans.  Nothing is missed: any two equal
windows lie in blocks with the same anchor, which are either equal or both looked
up.  All look-ups are joins and partial aggregations on 128-bit hashes, so a passage in
a third of all documents is one row per map task; no task holds a passage's documents.  Blocks
are computed once and written; places are gathered as sets, so rows that repeat add nothing to a list.

Defined cases: a null text has no words; a null id is smaller than any other and is
returned as null; rows that repeat (same id and text) are one document and get the same
result; rows that share an id but not the text (told apart by 64 bits of its hash) are one document with separate spans
(a window they share is no repeat by that alone); texts under ``WINDOW`` words lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import BASES, U64, Rolling, WordHashes, column, mix, ordered_id, raw, release, written

WINDOW = 50
GRAM = 10
#: words hashed together
_BATCH = 200_000
#: a place in a text as one long: word position, and in the lowest bits the number of windows
_LEN = 6


def _place(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (pos << _LEN) | n


def _of_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> _LEN, place & ((1 << _LEN) - 1)


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, where its leftmost smallest value is."""
    v, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = v[step:] < v[:-step]
        v, at = np.where(right, v[step:], v[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def blocks(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of a batch of texts: (first word, number of windows, anchor, two hashes of the block).

    ``hashes``: (n, 2) of all words in order; ``doc``: the text each word belongs to.
    """
    n = len(hashes) - WINDOW + 1
    with np.errstate(over="ignore"):
        ends = np.arange(GRAM, len(hashes) + 1)
        grams = Rolling(hashes[:, 0], BASES[0]).of(ends - GRAM, ends)
        anchor = smallest_in_windows(grams, WINDOW - GRAM + 1)[:n]
        own = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
        if not len(own):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, U64),) * 3
        new = np.concatenate([[True], (np.diff(own) != 1) | (np.diff(anchor[own]) != 0) | (np.diff(doc[own]) != 0)])
        first = own[new]
        count = np.diff(np.append(np.flatnonzero(new), len(own)))
        both = [Rolling(hashes[:, k], BASES[k]).of(first, first + count + WINDOW - 1) + mix(count.astype(U64)) for k in (0, 1)]
    return first, count, grams[anchor[first]], both[0], both[1]


def _batches(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(number of the first text, words of texts) with about _BATCH words."""
    start, found, n = 0, [], 0
    for k, t in enumerate(texts):
        found.append(t.split())
        n += len(found[-1])
        if n >= _BATCH:
            yield start, found
            start, found, n = k + 1, [], 0
    if found:
        yield start, found


def _hashed(hasher: WordHashes, found: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, text of each word, first word of each text)."""
    lengths = np.array([len(w) for w in found])
    hashes = np.concatenate([np.empty((0, 2), U64), *(hasher.of(w) for w in found if w)])
    return hashes, np.repeat(np.arange(len(found)), lengths), np.cumsum(lengths) - lengths


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHashes()
    for b in batches:
        ids, th = column(b, "_id").to_numpy(), column(b, "_th").to_numpy()
        for start, found in _batches(raw(b)):
            hashes, doc, begin = _hashed(hasher, found)
            if len(hashes) < WINDOW:
                continue
            first, count, anchor, h1, h2 = blocks(hashes, doc)
            own = doc[first]
            place = _place(first - begin[own], count)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == U64 else x) for x in (anchor, ids[start + own], th[start + own], place, h1, h2)],
                                             names=["_anchor", "_id", "_th", "_place", "_h1", "_h2"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the blocks listed with each text."""
    hasher = WordHashes()
    for b in batches:
        ids, th, lists = column(b, "_id").to_numpy(), column(b, "_th").to_numpy(), column(b, "_places")
        for k, text in enumerate(raw(b)):
            pos, n = _of_place(np.unique(np.array(lists[k].as_py(), np.int64)))
            hashes = hasher.of(text.split())
            at = np.repeat(pos - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = [Rolling(hashes[:, c], BASES[c]).of(at, at + WINDOW).view(np.int64) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (both[0], both[1], np.full(len(at), ids[k]), np.full(len(at), th[k]), _place(at, np.int64(1)))],
                                             names=["_w1", "_w2", "_id", "_th", "_place"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id": ordered_id(), "_th": F.expr("xxhash64(coalesce(text, ''))")})


def repeated_places(docs: DataFrame) -> DataFrame:
    """_id, _th, _places: per text, the (position, number) of all its repeated windows."""
    keyed = _keyed(docs.select("doc_id", "text"))
    found = written(keyed.select("_id", "_th", "text").mapInArrow(_blocks, "_anchor long, _id long, _th long, _place long, _h1 long, _h2 long"))
    # anchors of at least two documents; tables to be joined back are written first, so that both
    # sides of each join are exchanges and a frequent key's rows can be split over tasks
    anchors = written(found.groupBy("_anchor").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).where("_a < _b").select("_anchor"))
    shared = written(found.join(anchors, "_anchor", "left_semi"))
    # the index: each distinct block once, with the smallest document that holds it
    index = written(shared.groupBy("_h1", "_h2", "_anchor").agg(F.min("_id").alias("_first")))
    several = index.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_anchor", F.lit(True).alias("_several"))
    index = index.join(written(several), "_anchor", "left").select("_h1", "_h2", "_first", "_several")
    parsed = written(shared.join(index, ["_h1", "_h2"]).where("_id > _first or _several").select("_id", "_th", "_place", (F.col("_id") > F.col("_first")).alias("_whole")))
    release(docs.sparkSession)
    whole = parsed.where("_whole").select("_id", "_th", "_place")
    edges = parsed.where("not _whole").groupBy("_id", "_th").agg(F.collect_set("_place").alias("_places"))
    windows = written(keyed.join(edges, ["_id", "_th"]).select("_id", "_th", "text", "_places")
                     .mapInArrow(_windows, "_w1 long, _w2 long, _id long, _th long, _place long"))
    firsts = written(windows.groupBy("_w1", "_w2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").select("_w1", "_w2", "_first"))
    release(docs.sparkSession)
    single = windows.join(firsts, ["_w1", "_w2"]).where("_id > _first").select("_id", "_th", "_place")
    return whole.unionByName(single).groupBy("_id", "_th").agg(F.collect_set("_place").alias("_places"))


def _covered(n_words: int, places: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of words covered by repeated windows."""
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pos, n = _of_place(np.array(places, np.int64))
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, pos, 1)
    np.add.at(steps, pos + n + WINDOW - 1, -1)
    inside = np.concatenate([[0], np.cumsum(steps[:-1]) > 0, [0]]).astype(np.int8)
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        places = column(b, "_places")
        n_words, removed, sha, spans = [], [], [], []
        for k, text in enumerate(raw(b)):
            words = text.split()
            starts, ends = _covered(len(words), places[k].as_py())
            kept, at = [], 0
            for s, e in zip(starts.tolist(), ends.tolist()):
                kept += words[at:s]
                at = e
            kept += words[at:]
            n_words.append(len(words))
            removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, one)],
                                         names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (array of start, end in words) for every row."""
    own = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return (own.join(repeated_places(docs), ["_id", "_th"], "left").select("doc_id", "text", "_places")
            .mapInArrow(_spans, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"))
