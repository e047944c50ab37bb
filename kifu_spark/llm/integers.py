"""Vectors as exact integers of any size, and their sums over all tasks.

Ordinary integers are held as doubles, where every product and sum that a distance needs stays below 2^53 and is exact;
vectors with larger ones are arrays of Python integers. Sums leave a task as digits of base 2^40, so that they stay
exact however many rows and tasks there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT_BITS = 40
DIGITS_SCHEMA = "size int, cell long, place int, digit long"
MOST_LONG = (1 << 63) - 1


def is_finite(vec: Column) -> Column:
    """Whether an array of doubles is there and holds neither nulls nor infinite or undefined components."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def limit(size: int) -> float:
    """Below this no distance of two vectors of that length leaves the exact integers of a double."""
    return math.sqrt(2**51 / max(size, 1))


def by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and components of the vectors of each length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield int(size), rows, vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def floors(vectors: np.ndarray, scale: int, ordinary: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floor(scale * x) of the rows with ordinary integers, then of the others, scale being a power of two.

    Without ordinary, because what they are compared with is not, all rows come as Python integers.
    """
    with np.errstate(over="ignore"):
        whole = np.floor(vectors * float(scale))
    plain = np.abs(whole).max(axis=1, initial=0) < limit(vectors.shape[1]) if ordinary else np.zeros(len(vectors), bool)
    if plain.any():
        yield np.flatnonzero(plain), whole[plain]
    if not plain.all():
        exact = np.empty((int((~plain).sum()), vectors.shape[1]), dtype=object)
        exact[:] = [[math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in row] for row in vectors[~plain].tolist()]
        yield np.flatnonzero(~plain), exact


def as_numbers(rows: list[list[int]], size: int) -> np.ndarray:
    """Integer vectors as doubles where all are ordinary, else as Python integers."""
    exact = np.empty((len(rows), size), dtype=object)
    if rows and size:
        exact[:] = rows
        if max(map(abs, exact.ravel())) < limit(size):
            return exact.astype(np.float64)
    return exact if rows and size else exact.astype(np.float64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis; both sides are ordinary, or one holds Python integers."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def as_longs(values: np.ndarray) -> pa.Array:
    """Exact integers as longs; null beyond their range."""
    return pa.array([int(v) if v <= MOST_LONG else None for v in values.tolist()], pa.int64())


def digits(size: int, totals: np.ndarray) -> pa.RecordBatch:
    """Totals, by cell, as rows of DIGITS_SCHEMA; zeros have none."""
    rows = []
    for cell, total in enumerate(totals.tolist()):
        sign, rest, place = (-1 if total < 0 else 1), abs(int(total)), 0
        while rest:
            if digit := rest & ((1 << DIGIT_BITS) - 1):
                rows.append((size, cell, place, sign * digit))
            rest >>= DIGIT_BITS
            place += 1
    columns = list(zip(*rows)) or [()] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["size", "cell", "place", "digit"])


def summed(parts: DataFrame) -> dict[int, dict[int, int]]:
    """By size and cell, the exact sums of all tasks' digits: as many rows reach the driver as there are cells and digits."""
    out: dict[int, dict[int, int]] = {}
    for size, cell, place, digit in parts.groupBy("size", "cell", "place").agg(F.sum("digit")).collect():
        cells = out.setdefault(size, {})
        cells[cell] = cells.get(cell, 0) + (digit << (DIGIT_BITS * place))
    return out
