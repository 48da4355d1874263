"""Exact cut points of a distributed order by repeated histograms.

``find_cuts`` looks for keys that leave a wanted weight below them.  Each round
counts the exact weight and rows of 256 times finer cells of the key space, only
inside cells that still hold a wanted weight too far from both their edges, with
one partial aggregation; the driver sees at most 256 rows per open cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 8
KEY = 128
_TOP = -(2 ** 63)
_MASK = 2 ** 64 - 1


@dataclass(frozen=True)
class Cut:
    """Everything with a 128-bit key under ``key`` lies below: exact weight and rows."""

    key: int
    weight: int
    rows: int


def ordered(col: Column) -> Column:
    """A 64-bit key as a signed long in unsigned order."""
    return col.bitwiseXOR(F.lit(_TOP))


def as_longs(key: int) -> tuple[int, int]:
    """A key as two signed longs in unsigned order."""
    key = min(key, 2 ** KEY - 1)
    return (key >> 64) + _TOP, (key & _MASK) + _TOP


def as_struct(cut: Cut) -> Column:
    """A cut, to be compared with struct(ordered(k1), ordered(k2))."""
    return F.struct(*(F.lit(x).cast("long") for x in as_longs(cut.key)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _long(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if _signed(x) == _TOP else f"{_signed(x)}L"


def _cells(df: DataFrame, bits: int, open_cells: dict) -> list:
    """Rows (group, cell prefix, weight, rows, lowest and highest key) of all open cells' parts with ``bits`` bits."""
    before = bits - BITS
    if open_cells and before:
        if before <= 64:
            said = ", ".join(f"({g}L, {_long(p)})" for g, p in open_cells)
            df = df.where(F.expr(f"(_g, shiftrightunsigned(_k1, {64 - before})) IN ({said})"))
        else:
            said = ", ".join(f"({g}L, {_long(p >> (before - 64))}, {_long(p & ((1 << (before - 64)) - 1))})" for g, p in open_cells)
            df = df.where(F.expr(f"(_g, _k1, shiftrightunsigned(_k2, {128 - before})) IN ({said})"))
    if bits <= 64:
        prefix = [F.expr(f"shiftrightunsigned(_k1, {64 - bits})").alias("p1"), F.lit(0).cast("long").alias("p2")]
    else:
        prefix = [F.col("_k1").alias("p1"), F.expr(f"shiftrightunsigned(_k2, {128 - bits})").alias("p2")]
    found = (df.groupBy("_g", *prefix).agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n"), F.min(F.col("_k1")).alias("a1"), F.max(F.col("_k1")).alias("b1"),
                                           F.min(F.col("_k2")).alias("a2"), F.max(F.col("_k2")).alias("b2")).collect())
    width = bits if bits <= 64 else bits - 64
    out = []
    for r in found:
        p = (r.p1 & _MASK) if bits <= 64 else ((r.p1 & _MASK) << width) | (r.p2 & _MASK)
        one = (((r.a1 & _MASK) << 64) | (r.a2 & _MASK)) if (r.a1, r.a2) == (r.b1, r.b2) else None
        out.append((r._g, p, int(r.w), r.n, r.a1 == r.b1, one))
    return sorted(out, key=lambda x: (x[0], x[1]))


def find_cuts(df: DataFrame, wanted: dict[int, list[tuple[float, float, float]]]) -> dict[int, list[Cut]]:
    """For every group, a cut for each (weight, tolerance, tolerance where one k1 would be parted).

    ``df`` has long columns _g (group), _k1 and _k2 (keys, compared as one unsigned
    128-bit number) and _w (weight >= 0); it is read once a round, so it should be
    small and written.  Cells are refined until one of a cell's edges is near
    enough to the wanted weight, or the cell holds equal keys only; then the
    nearer edge is the cut.  Where all rows of a cell share k1, its edges are
    taken within the third figure, so that rows of one k1 stay together.
    """
    todo = {(g, i): (0, 0, 0) for g, ws in wanted.items() for i in range(len(ws))}  # cell prefix, weight and rows below it
    found: dict[tuple[int, int], Cut] = {}
    for bits in range(BITS, KEY + BITS, BITS):
        if not todo:
            break
        cells = _cells(df, bits, {(g, todo[g, i][0]): 1 for g, i in todo})
        by_parent: dict = {}
        for c in cells:
            by_parent.setdefault((c[0], c[1] >> BITS), []).append(c)
        after = {}
        for (g, i), (parent, w0, n0) in todo.items():
            target, near, whole = wanted[g][i]
            own = by_parent.get((g, parent), [])
            below_w, below_n, cut = w0, n0, None
            for _, p, w, n, one_k1, one in own:
                if below_w + w > target:
                    left, right = target - below_w, below_w + w - target
                    start, end = p << (KEY - bits), (p + 1) << (KEY - bits)
                    limit = whole if one_k1 and bits <= 64 else near
                    if min(left, right) <= limit or one is not None or bits == KEY:
                        cut = Cut(start, below_w, below_n) if left <= right else Cut(end, below_w + w, below_n + n)
                    else:
                        after[g, i] = (p, below_w, below_n)
                        cut = 0
                    break
                below_w, below_n = below_w + w, below_n + n
            if cut is None:  # the wanted weight is all there is
                cut = Cut((parent + 1) << (KEY - bits + BITS), below_w, below_n)
            if cut:
                found[g, i] = cut
        todo = after
    return {g: [found[g, i] for i in range(len(ws))] for g, ws in wanted.items()}
