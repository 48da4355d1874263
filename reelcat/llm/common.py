"""Helpers shared by the operators: tables, checkpoints, word hashes, Arrow columns."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelcat.session import checkpoint_dir

#: what separates words everywhere in this subpackage; ``bytes.split()`` cuts at the same bytes
SPACES = " \t\n\x0b\x0c\r"
NO_ID = -(2 ** 63)
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``settle``, as a compressed Parquet table: a checkpoint's rows take about twice the space."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that written tables have replaced, instead of whenever the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ordered_id(col: str = "doc_id") -> Column:
    """Document id for comparisons; a null id counts as smaller than any other."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes:
    """Two independent 64-bit hashes for each word of a list, remembered between documents.

    Holds at most ``limit`` words and starts anew beyond that.
    """

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.both = np.empty((1 << 14, 2), U64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """(n, 2) array."""
        if len(self.ids) > self.limit:
            self._clear()
        ids = self.ids
        for w in set(words).difference(ids):
            k = ids[w] = len(ids)
            if k == len(self.both):
                self.both = np.concatenate([self.both, np.empty_like(self.both)])
            d = xxhash.xxh3_128_intdigest(w)
            self.both[k] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
        return self.both[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]


class Rolling:
    """Hash of any range of a sequence of 64-bit values, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        with np.errstate(over="ignore"):
            up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, x, U64)]), dtype=U64) for x in (base, pow(base, -1, 2 ** 64)))
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[:n], dtype=U64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in the JVM; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def per_worker(key, make):
    """Something costly to build, kept for all tasks of one Python worker."""
    kept = sys.modules.setdefault("_corpus_worker", types.SimpleNamespace(kept={})).kept
    if key not in kept:
        kept[key] = make()
    return kept[key]


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal (long) keys, as one table each; sorted input, groups may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([column(b, n).to_numpy() for n in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            own = tuple(k[:, i])
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = own
    if held:
        yield pa.Table.from_batches(held)
