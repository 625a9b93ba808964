"""Vectors as exact integers, and exact sums of them, for the operators that cluster vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one step of vector code works on.
ROWS = 2048
#: Components below this are 64-bit integers, whose squared distances can't overflow; larger ones are Python's integers.
SMALL = 1 << 24
#: Sums are carried as signed digits of this many bits, so that adding them up natively never overflows.
DIGIT = 40
LONG = 2**63 - 1


def whole(column: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, none of them null, in double precision."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``ROWS`` rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, exactly; 64-bit integers if all are small, else Python's. ``scale`` is a power of two."""
    if not x.size or np.abs(x).max() < SMALL / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def by_size(x: np.ndarray, scale: int, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integers): small rows together, then the rest; all are Python's integers where ``others`` are."""
    large = np.abs(x).max(1) >= SMALL / scale
    for at in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(at):
            own = floors(x[at], scale)
            yield at, own.astype(object) if others.dtype == object else own


def array_of(values: list[list[int]]) -> np.ndarray:
    """Rows of integers, 64-bit if all are small."""
    out = np.array(values, object)
    return out.astype(np.int64) if all(abs(v) < SMALL for row in values for v in row) else out


def floats(x: np.ndarray) -> np.ndarray:
    """Integers as floating point, all divided by a power of two where they are too large for it."""
    return (x >> max(0, max((int(v).bit_length() for v in np.abs(x).ravel()), default=0) - 400)).astype(float)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances along the last axis."""
    d = x - y
    return (d * d).sum(-1)


def true(x: np.ndarray) -> np.ndarray:
    """A comparison's result as booleans, whatever was compared."""
    return x.astype(bool)


def longs(values: np.ndarray) -> list[int]:
    """Non-negative integers as longs; what is larger becomes the largest long."""
    return [min(int(v), LONG) for v in values]


def digits(values: list[int]) -> list[tuple[int, list[int]]]:
    """(place, digits) of the values, a row for each place that is needed."""
    out, place = [], 0
    while any(not -(1 << DIGIT - 1) <= v < 1 << DIGIT - 1 for v in values):
        out.append((place, [v & (1 << DIGIT) - 1 for v in values]))
        values, place = [v >> DIGIT for v in values], place + 1
    return [*out, (place, list(values))]


class Sums:
    """Counts and componentwise sums of vectors by cell, as one task gathers them."""

    def __init__(self, cells: int, dim: int) -> None:
        self.count = [0] * cells
        self.sums = [np.zeros(dim, object) for _ in range(cells)]

    def add(self, cell: np.ndarray, x: np.ndarray, first: int = 0) -> None:
        """Add the rows of ``x``, each to its cell; cells count from ``first`` on."""
        for c in np.unique(cell):
            own = x[cell == c]
            self.count[first + c] += len(own)
            self.sums[first + c] = self.sums[first + c] + own.sum(0).astype(object)

    def rows(self) -> list[dict]:
        """A row (cell, place, count, sums) for each place of each cell with vectors."""
        return [{"cell": c, "place": p, "count": 0 if p else n, "sums": d} for c, n in enumerate(self.count) if n for p, d in digits([int(v) for v in self.sums[c]])]


CELL = "struct<cell:int,place:int,count:long,sums:array<long>>"
CELL_ARROW = pa.struct([("cell", pa.int32()), ("place", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])


def totals(rows: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """(count, sums) by cell, of all tasks' rows. The driver gets a row per cell and place; there are a few hundred at most."""
    added = rows.groupBy("cell", "place").agg(F.sum("count").alias("count"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)))
    out: dict[int, tuple[int, list[int]]] = {}
    for cell, place, count, *sums in added.collect():
        n, s = out.get(cell, (0, [0] * dim))
        out[cell] = n + count, [a + (b << DIGIT * place) for a, b in zip(s, sums)]
    return out


def means(old: np.ndarray, found: dict[int, tuple[int, list[int]]], first: int = 0) -> np.ndarray:
    """Each row replaced by the floor of its vectors' mean; a row without vectors stays."""
    return array_of([[s // found[first + c][0] for s in found[first + c][1]] if first + c in found else [int(v) for v in own] for c, own in enumerate(old)])
