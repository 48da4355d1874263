"""Keyed tables that change: versions over Parquet folders, cut into ranges of the key.

A table is a set of *parts*, each a folder with the rows of one range of the key, sorted by it.
A version is a small file that lists the parts, with the least and the greatest key and the
number of rows of each.  A change writes new parts beside the old ones and then a new version; nothing that a version
lists is ever written again, so the version before stays readable until ``vacuum``.  The file of a version is
created only if it isn't there: of two writers that start from the same version one fails.

* ``holding``: only the parts that may hold given keys are read.
* ``replace``: rows of touched parts are written anew, all other parts stay as they are.
* ``append``: new rows become parts of their own, so a change costs what it adds; ``compact`` folds parts
  that came together, the small ones first, so a row is written a logarithmic number of times.

The driver holds one entry per part.  Keys are compared as text; a null key counts as the empty text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


class ConcurrentChange(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Part:
    folder: str
    run: str
    low: str
    high: str
    rows: int


@dataclass(frozen=True)
class Version:
    number: int
    epoch: int
    schema: str
    parts: tuple[Part, ...]

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.parts)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers see them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def place_among(key: Column, lows: list[str]) -> Column:
    """How many of the ascending ``lows`` are not above the key, by a tree of comparisons."""
    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(lows[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    return within(0, len(lows))


class KeyedTable:
    """The table at ``path``, by the text of ``key`` (a column name or an expression over the rows)."""

    def __init__(self, spark: SparkSession, path: str, key: str | Column):
        self.spark, self.path = spark, path
        self.key = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))

    # versions

    def numbers(self) -> list[int]:
        """Numbers of all versions, ascending."""
        fs, p = hadoop(self.spark, f"{self.path}/versions")
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version, by default the newest; None if there is none.  A broken one raises."""
        found = self.numbers()
        if number is None and not found:
            return None
        number = found[-1] if number is None else number
        fs, p = hadoop(self.spark, f"{self.path}/versions/{number:020d}")
        stream = fs.open(p)
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, said["epoch"], said["schema"], tuple(Part(**x) for x in said["parts"]))

    def _commit(self, before: Version | None, schema: str, parts: list[Part], epoch: int | None) -> Version:
        number = before.number + 1 if before else 0
        last = before.epoch if before else -1
        made = Version(number, last if epoch is None else epoch, schema, tuple(sorted(parts, key=lambda x: (x.run, x.low))))
        fs, p = hadoop(self.spark, f"{self.path}/versions/{number:020d}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise ConcurrentChange(f"version {number} of {self.path} was made by another writer") from e
            raise
        try:
            out.write(json.dumps({"epoch": made.epoch, "schema": schema, "parts": [asdict(x) for x in made.parts]}).encode())
        finally:
            out.close()
        return made

    def applied(self, epoch: int) -> bool:
        """Is a stream's epoch in the table already?"""
        v = self.version()
        return v is not None and v.epoch >= epoch

    # reading

    def read(self, version: Version | None = None, parts: list[Part] | None = None) -> DataFrame:
        """All rows of a version (by default the newest), or of some of its parts."""
        v = version or self.version()
        if v is None:
            raise FileNotFoundError(f"no version of {self.path}")
        own = v.parts if parts is None else parts
        schema = StructType.fromJson(json.loads(v.schema))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p.folder}" for p in own)) if own else self.spark.createDataFrame([], schema)

    def touched(self, spans: DataFrame, low: Column, high: Column, version: Version) -> list[Part]:
        """The parts that may hold a key between ``low`` and ``high`` of any row of ``spans``."""
        runs: dict[str, list[Part]] = {}
        for p in version.parts:
            runs.setdefault(p.run, []).append(p)
        found = []
        for parts in runs.values():
            # parts of one run don't overlap: from the one that begins last at or before low to the one that does so before high
            lows = [p.low for p in parts]
            first, last = F.greatest(place_among(low, lows) - 1, F.lit(0)), place_among(high, lows) - 1
            hit = spans.select(F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("i")).distinct()
            found += [parts[r.i] for r in hit.collect()]
        return found

    def holding(self, keys: DataFrame, key: Column, version: Version | None = None) -> DataFrame:
        """The rows of those parts that may hold one of the keys."""
        v = version or self.version()
        k = F.coalesce(key.cast("string"), F.lit(""))
        return self.read(v, self.touched(keys.select(k.alias("_k")), F.col("_k"), F.col("_k"), v))

    # changing

    def _write(self, rows: DataFrame, run: str, among: Column, settle: Callable[[DataFrame], DataFrame] | None = None) -> list[Part]:
        """``rows`` as parts of ``run``; no part spans two values of ``among`` (which rises with the key), and a range is split as the shuffle splits it.

        The key isn't copied into the rows: what is shuffled and stored is the rows alone.  ``settle`` sees them when all rows of a key are
        in one partition and may leave some out.
        """
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        placed = rows.repartitionByRange(self.key)
        if settle:
            placed = settle(placed)
        # one number per value of ``among`` and partition: sorted by it first, as the writer asks, rows aren't sorted once more, which could lose their order
        part = F.shiftleft(among.cast("bigint"), 32) + F.spark_partition_id()
        placed.withColumn("_s", part).sortWithinPartitions("_s", self.key).write.partitionBy("_s").parquet(folder)
        schema = StructType.fromJson(json.loads(placed.schema.json())).add("_s", LongType())
        found = (self.spark.read.schema(schema).parquet(folder).groupBy("_s")
                 .agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count(F.lit(1)).alias("n")).collect())
        name = folder.rpartition("/")[2]
        return [Part(f"data/{name}/_s={r._s}", run, r.low, r.high, r.n) for r in found]

    def create(self, rows: DataFrame, settle: Callable[[DataFrame], DataFrame] | None = None) -> Version:
        """The first version."""
        return self.append(rows, settle=settle)

    def append(self, rows: DataFrame, epoch: int | None = None, settle: Callable[[DataFrame], DataFrame] | None = None) -> Version:
        """A version with ``rows`` added as a run of their own."""
        before = self.version()
        run = f"{before.number + 1 if before else 0:020d}"
        new = self._write(rows, run, F.lit(0), settle)
        return self._commit(before, before.schema if before else rows.schema.json(), [*(before.parts if before else ()), *new], epoch)

    def replace(self, parts: list[Part], rows: DataFrame, version: Version, epoch: int | None = None,
                settle: Callable[[DataFrame], DataFrame] | None = None) -> Version:
        """A version in which ``rows`` stand in the place of ``parts``; the others are as before.  For tables of one run."""
        own = {p.folder for p in parts}
        lows = [p.low for p in version.parts]
        # rows stay between the same neighbours: by the part they would have been in
        new = self._write(rows, version.parts[0].run if version.parts else f"{0:020d}", place_among(self.key, lows), settle)
        return self._commit(version, version.schema, [*(p for p in version.parts if p.folder not in own), *new], epoch)

    def compact(self, fold: Callable[[DataFrame], DataFrame], most: int = 4) -> Version:
        """Fold the newest runs together while each is at most twice as large as those after it; nothing below ``most`` runs."""
        v = self.version()
        size: dict[str, int] = {}
        for p in v.parts:
            size[p.run] = size.get(p.run, 0) + p.rows
        runs = sorted(size, reverse=True)
        if len(runs) < most:
            return v
        taken, n = [runs[0]], size[runs[0]]
        for r in runs[1:]:
            if size[r] > 2 * n and len(runs) - len(taken) < 4 * most:
                break
            taken.append(r)
            n += size[r]
        if len(taken) < 2:
            return v
        own = [p for p in v.parts if p.run in taken]
        new = self._write(fold(self.read(v, own)), min(taken), F.lit(0))
        return self._commit(v, v.schema, [*(p for p in v.parts if p.run not in taken), *new], None)

    def vacuum(self, keep: int = 2) -> int:
        """Remove the versions before the newest ``keep``, and the folders of parts that none of these lists; their number."""
        found = self.numbers()
        kept = {p.folder for n in found[-keep:] for p in self.version(n).parts}
        fs, root = hadoop(self.spark, f"{self.path}/data")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        gone = {p.folder for n in found[:-keep] for p in self.version(n).parts} - kept
        for folder in gone:
            fs.delete(path(f"{self.path}/{folder}"), True)
        for n in found[:-keep]:
            fs.delete(path(f"{self.path}/versions/{n:020d}"), False)
        return len(gone)
