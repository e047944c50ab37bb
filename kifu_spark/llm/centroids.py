"""Centroid clustering over exact integers, with Ptolemaic pivots.

Components become integers floor(scale * x). The centroids start as the vectors with the smallest hashes of their
identifiers; each round assigns every vector to the nearest one and replaces each centroid by the componentwise floor
of its vectors' mean. Ties go to the smaller number, and a centroid without vectors stays.

By Ptolemy's inequality a vector x, a centroid c and two pivots p, q have d(x,c) d(p,q) >= |d(x,p) d(c,q) - d(x,q) d(c,p)|.
The distances of every vector to the pivots are computed once and stored beside it; a round computes those of its few
centroids, and the largest bound over fixed pairs of pivots tells which centroids a vector need not be compared with.
The bound is rounded down by more than its error, what it does not exclude is compared in exact integers, and so the
result is that of a plain search.

Pivots are chosen far apart among the ``PIVOT_SAMPLE`` vectors of the smallest hashes, a documented bound; they change
the work, never the result. A round is one pass over the stored vectors; the driver holds centroids and pivots only, and
sums reach it added up, so a lost executor costs a repeated task.

Cases: vectors that are null, of another length, or hold a null or a non-finite component take no part. Every row is a
vector of its own, also where identifiers repeat; rows without identifier are never preferred as first centroids. With
fewer vectors than clusters there are fewer clusters, of an empty table none. Components of any finite size are exact;
distances and inertias above the range of a long are null, their clusters still right. Further columns never matter,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from kifu_spark.llm.integers import DIGITS_SCHEMA, MOST_LONG, as_longs, as_numbers, digits, floors, is_finite, squares, summed
from kifu_spark.session import stored

SIZE, SCALE = 64, 64
CLUSTERS, ROUNDS = 16, 3
PIVOTS, PIVOT_SAMPLE = 8, 256
#: Many times the relative error of a product of two rounded roots.
SLACK = 32 * np.finfo(float).eps


@dataclass(frozen=True)
class Clusters:
    """Assigned vectors (id, cluster, distance) and the final centroids as integers."""

    assigned: DataFrame
    centroids: list[list[int]]


def roots(values: np.ndarray) -> np.ndarray:
    """Square roots in double precision; infinite where the value is beyond it."""
    if values.dtype == object:
        return np.array([math.sqrt(v) if v < 10**300 else math.inf for v in values.ravel()]).reshape(values.shape)
    return np.sqrt(values)


def distances_to(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of each vector to each of a few others, rounded."""
    return np.stack([roots(squares(vectors, o)) for o in others], axis=1) if len(others) else np.zeros((len(vectors), 0))


def pick_pivots(rows: list[list[int]], size: int, pivots: int = PIVOTS) -> list[list[int]]:
    """Rows far apart from each other: the first, then each time the one farthest from those chosen."""
    numbers, chosen = as_numbers(rows, size), []
    least = np.full(len(rows), math.inf)
    at = 0
    while rows and len(chosen) < pivots and least[at] > 0:
        chosen.append(rows[at])
        least = np.minimum(least, roots(squares(numbers, numbers[at])))
        at = int(least.argmax())
    return chosen


def lower_bounds(near: np.ndarray, centroid_near: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """For each vector and centroid, what their squared distance surely reaches, from distances to neighbouring pivots."""
    out = np.zeros((len(near), len(centroid_near)))
    with np.errstate(all="ignore"):
        for p in range(near.shape[1]):
            q = (p + 1) % near.shape[1]
            if q != p and np.isfinite(apart[p]):
                one, other = np.outer(near[:, p], centroid_near[:, q]), np.outer(near[:, q], centroid_near[:, p])
                bound = (np.abs(one - other) - SLACK * (one + other)) / apart[p] * (1 - SLACK)
                out = np.fmax(out, np.where(np.isfinite(bound) & (bound > 0), bound * bound * (1 - SLACK), 0))
    return np.where(np.isfinite(out), out, 0)


def assign(vectors: np.ndarray, bounds: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid, exact squared distance, and how many distances were computed."""
    chosen = bounds.argmin(axis=1)
    best, compared = squares(vectors, centroids[chosen]), len(vectors)
    first = chosen.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((first != c) & (bounds[:, c] <= best))
        compared += len(rows)
        if len(rows):
            found = squares(vectors[rows], centroids[c])
            better = ((found < best[rows]) | ((found == best[rows]) & (c < chosen[rows]))).astype(bool)
            chosen[rows[better]], best[rows[better]] = c, found[better]
    return chosen, best, compared


def _components(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _with_pivots(pivots: list[list[int]], size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = as_numbers(pivots, size)
        for batch in batches:
            near = np.zeros((batch.num_rows, len(others)))
            for rows, numbers in floors(_components(batch["vec"], size), scale, others.dtype != object):
                near[rows] = distances_to(numbers, others)
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(others), pa.array(near.ravel()))
            yield pa.record_batch([batch["id"], batch["vec"], lists], ["id", "vec", "near"])

    return run


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], pivots: list[list[int]], size: int, scale: int) -> Iterator[tuple]:
    """Of each batch: the batch, row numbers, their integers, clusters and distances."""
    numbers, others = as_numbers(centroids, size), as_numbers(pivots, size)
    centroid_near = distances_to(numbers, others)
    apart = np.array([roots(squares(others[p : p + 1], others[(p + 1) % len(others)]))[0] for p in range(len(others))])
    for batch in batches:
        near = _components(batch["near"], len(others))
        for rows, vectors in floors(_components(batch["vec"], size), scale, numbers.dtype != object):
            yield batch, rows, vectors, *assign(vectors, lower_bounds(near[rows], centroid_near, apart), numbers)[:2]


def _sums(centroids: list[list[int]], pivots: list[list[int]], size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centroids), size + 1), dtype=object)  # the last column counts
        for _, _, vectors, chosen, _ in _assigned(batches, centroids, pivots, size, scale):
            for c in np.unique(chosen):
                mine = vectors[chosen == c]
                totals[c, :size] += mine.sum(axis=0) if mine.dtype == object else mine.sum(axis=0).astype(np.int64).astype(object)
                totals[c, size] += len(mine)
        yield digits(size, totals.ravel())

    return run


def _labels(centroids: list[list[int]], pivots: list[list[int]], size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _, chosen, best in _assigned(batches, centroids, pivots, size, scale):
            yield pa.record_batch([batch["id"].take(pa.array(rows)), pa.array(chosen, pa.int32()), as_longs(best)], ["id", "cluster", "distance"])

    return run


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    size: int = SIZE,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    seed: int = 1,
) -> Clusters:
    """Cluster the vectors of that length; the first centroids have the smallest sha256 of ``seed:id``."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).filter(
        (F.size("vec") == size) & is_finite(F.col("vec"))
    )
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "vec").limit(max(clusters, PIVOT_SAMPLE)).select("vec").collect()
    rows = [[int(x) for x in numbers[0]] for row in first for _, numbers in floors(np.array([row.vec]), scale)]
    centroids, chosen = rows[:clusters], pick_pivots(rows, size, pivots)
    fields = [kept.schema["id"], StructField("vec", ArrayType(DoubleType())), StructField("near", ArrayType(DoubleType()))]
    placed = stored(kept.mapInArrow(_with_pivots(chosen, size, scale), StructType(fields)))
    for _ in range(rounds if centroids else 0):
        totals = summed(placed.mapInArrow(_sums(centroids, chosen, size, scale), DIGITS_SCHEMA)).get(size, {})
        sums = [[totals.get(c * (size + 1) + i, 0) for i in range(size + 1)] for c in range(len(centroids))]
        centroids = [[s // own[size] for s in own[:size]] if own[size] else old for own, old in zip(sums, centroids)]
    out = StructType([kept.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])
    return Clusters(stored(placed.mapInArrow(_labels(centroids, chosen, size, scale), out)), centroids)


def whole_sum(value: str) -> Column:
    """Exact sum of longs of which none is null, as a decimal; null if one is."""
    return F.when(F.count(value) == F.count("*"), F.sum(F.col(value).cast("decimal(19,0)")))


def with_inertia(found: Clusters, id_col: str = "vec_id") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256: the report has one row for each cluster."""
    per = {r.cluster: r.total for r in found.assigned.groupBy("cluster").agg(whole_sum("distance").alias("total")).collect()}
    fits = lambda n: int(n) if n is not None and n <= MOST_LONG else None
    whole = None if None in per.values() else sum(per.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()
    rows = [(c, fits(total), fits(whole), digest(c)) for c, total in per.items()]
    spark = found.assigned.sparkSession
    report = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.withColumnRenamed("id", id_col).join(F.broadcast(report), "cluster")
