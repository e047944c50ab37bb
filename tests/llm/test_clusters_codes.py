"""Clusters and vector codes against plain searches over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifu_spark.llm import centroids, vector_codes
from kifu_spark.llm.integers import MOST_LONG, as_numbers, floors


def exact_floor(x, scale):
    return math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale


def usable(vec):
    return vec is not None and all(x is not None and math.isfinite(x) for x in vec)


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(vec, others):
    return min((squared(vec, o), i) for i, o in enumerate(others))


def mean_floor(rows):
    return [sum(col) // len(rows) for col in zip(*rows)]


def fits(n):
    return n if n <= MOST_LONG else None


def clusters_by_hand(rows, size, scale=64, k=16, rounds=3):
    kept = [(i, [exact_floor(x, scale) for x in v], v) for i, v in rows if usable(v) and len(v) == size]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    cents = [r[1] for r in order[:k]]
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(nearest(v, cents)[1], []).append(v)
        cents = [mean_floor(groups[c]) if c in groups else old for c, old in enumerate(cents)]
    found = [(i, *reversed(nearest(v, cents))) for i, v, _ in kept]
    sums = {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    whole = sum(sums.values())
    if any(d > MOST_LONG for _, _, d in found):
        sums = {c: (MOST_LONG + 1 if any(d > MOST_LONG for _, e, d in found if e == c) else s) for c, s in sums.items()}
        whole = MOST_LONG + 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, fits(d), fits(sums[c]), fits(whole), sha[c]) for i, c, d in found), key=str)


def clustered(df, **more):
    found = centroids.with_inertia(centroids.cluster_vectors(df, **more))
    columns = "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


def codes_by_hand(rows, scale=1024, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [exact_floor(x, scale) for x in v], v) for i, v, lab in rows if usable(v)]
    out, errors = [], {}
    for size in {len(r[2]) for r in kept}:
        mine = sorted((r for r in kept if len(r[2]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
        if size % parts:
            out += [(i, None, None, lab, None) for i, lab, _, _ in mine]
            continue
        w = size // parts
        cut = [[r[2][p * w : (p + 1) * w] for r in mine] for p in range(parts)]
        books = [c[:entries] for c in cut]
        for _ in range(rounds):
            for p in range(parts):
                groups = {}
                for v in cut[p]:
                    groups.setdefault(nearest(v, books[p])[1], []).append(v)
                books[p] = [mean_floor(groups[e]) if e in groups else old for e, old in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for at, (i, lab, _, _) in enumerate(mine):
            near = [nearest(cut[p][at], books[p]) for p in range(parts)]
            error = sum(d for d, _ in near)
            out.append((i, "".join(f"{e:02x}" for _, e in near), error, lab, sha))
    for _, _, error, lab, _ in out:
        if error is not None:
            errors[lab] = errors.get(lab, 0) + error if error <= MOST_LONG else math.inf
    return sorted(((i, c, None if e is None else fits(e), fits(errors[lab]) if lab in errors else None, s) for i, c, e, lab, s in out), key=str)


def coded(df, **more):
    found = vector_codes.with_label_error(vector_codes.code_vectors(df, label_col="label", **more))
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in found.collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>, label int"


def odd_rows(size, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 3, spread) for _ in range(size)], i % 3 or None) for i in range(120)]
    rows += [(500 + i, [0.5] * size, 1) for i in range(40)]  # copies, also of first centroids
    rows += [(7, [0.25] * size, None), (7, [0.25] * size, 2), (None, [0.1] * size, 2), (None, None, 1), (901, None, 1)]
    rows += [(902, [float("nan")] + [0.0] * (size - 1), 1), (903, [float("inf")] * size, 1), (904, [None] * size, 1), (905, [], 1), (906, [1.0] * (size + 1), 3)]
    return rows


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_clusters_by_hand(spark, spread):
    rows = odd_rows(6, 1, spread)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("clash")).withColumn("near", F.lit(1)).repartition(5)
    assert clustered(df, size=6) == clusters_by_hand([r[:2] for r in rows], 6)


def test_clusters_of_huge_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** (i % 40 * 7) for _ in range(5)]) for i in range(80)] + [(99, [1.7e308] * 5), (98, [-1.7e308, 5e-324, 0.0, -0.0, 1e15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clustered(df, size=5) == clusters_by_hand(rows, 5)


@pytest.mark.parametrize("n", [0, 1, 2, 17])
def test_few_and_equal_vectors(spark, n):
    rows = [(i, [0.5, -0.5], 1) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clustered(df, size=2) == clusters_by_hand([r[:2] for r in rows], 2)
    rows = [(i, [0.5, -0.5, 0.25, 0.0], None) for i in range(n)]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == codes_by_hand(rows)


@pytest.mark.parametrize("spread", [0.001, 0.05, 5.0])
def test_codes_by_hand(spark, spread):
    rows = odd_rows(8, 2, spread) + [(2000 + i, [i / 7] * 12, 1) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit(1)).withColumn("size", F.lit("clash")).repartition(5)
    assert coded(df, entries=20) == codes_by_hand(rows, entries=20)


def test_codes_of_huge_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** (i % 30 * 10) for _ in range(4)], i % 2) for i in range(60)] + [(99, [1.7e308] * 4, 1), (98, [2.0**21] * 4, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert coded(df, entries=16) == codes_by_hand(rows, entries=16)


def test_decoded_vectors_stand_for_their_codes(spark):
    rows = [(i, [i / 10, -i / 10, 0.0, 1.0], None) for i in range(30)]
    found = vector_codes.code_vectors(spark.createDataFrame(rows, SCHEMA))
    for i, vec in vector_codes.decoded(found).collect():
        assert vec == pytest.approx(rows[i][1], abs=1 / 1024)


def test_bounds_exclude_only_what_is_farther():
    rng = np.random.default_rng(3)
    middles = rng.integers(-400, 400, (12, 8))
    rows = (middles[rng.integers(0, 12, 3000)] + rng.integers(-20, 20, (3000, 8))).tolist()
    numbers, cents = as_numbers(rows, 8), as_numbers(middles.tolist(), 8)
    pivots = as_numbers(centroids.pick_pivots(rows[:256], 8), 8)
    apart = np.sqrt(((pivots - np.roll(pivots, -1, axis=0)) ** 2).sum(axis=1))
    bounds = centroids.lower_bounds(centroids.distances_to(numbers, pivots), centroids.distances_to(cents, pivots), apart)
    exact = ((numbers[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (bounds <= exact).all()
    chosen, best, compared = centroids.assign(numbers, bounds, cents)
    assert (chosen == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert compared < 0.25 * exact.size  # the bounds do exclude most of the others


def test_equal_average_search_stops_early():
    rng = np.random.default_rng(5)
    book = rng.integers(-500, 500, (256, 4)).tolist()
    parts = as_numbers(rng.integers(-500, 500, (4000, 4)).tolist(), 4)
    exact = ((parts[:, None] - np.array(book, float)[None]) ** 2).sum(axis=2)
    chosen, best, compared = vector_codes.nearest_entries(parts, vector_codes.SortedBook.of(book, 4))
    assert (chosen == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert compared < 0.6 * exact.size


def test_integers_beyond_doubles():
    values = np.array([[2.0**60, 1.0], [0.1, -0.1], [1.7e308, -3.0]])
    got = {int(r): [int(x) for x in v] for rows, found in floors(values, 1024) for r, v in zip(rows, found)}
    assert got == {i: [exact_floor(x, 1024) for x in row] for i, row in enumerate(values.tolist())}
