"""Few vectors, several lengths, huge components: every candidate is found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifu_spark.llm import neighbours


def by_hand(rows, k=5):
    out = {}
    for i, v in rows:
        if i % 50 == 0:
            near = []
            for j, w in rows:
                if j != i and len(v) == len(w):
                    a, b = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
                    near.append((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), j))
            out[i] = [j for _, j in sorted(near)[:k]]
    return {i: found for i, found in out.items() if found}


def lists(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 17, 50])
def test_all_candidates_of_few_vectors(spark, n):
    rng = random.Random(n)
    rows = [(50 * i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("clash")).withColumn("curve", F.lit(1))
    assert lists(neighbours.nearest(df, F.col("vec_id") % 50 == 0)) == by_hand(rows)


def test_lengths_are_apart_and_rare_ones_whole(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(200)]
    rows += [(1000 + 50 * i, [rng.gauss(0, 1) * 10.0**i for _ in range(3)]) for i in range(7)] + [(5000, [1.0] * 20_000), (5050, [2.0] * 19_999 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert lists(neighbours.nearest(df, F.col("vec_id") % 50 == 0)) == by_hand(rows)


def test_slices_give_the_ranks_of_one_order(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE_ROWS", 40)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    keyed = df.select(F.col("vec_id").alias("rep"), F.lit(4).alias("size"), F.lit(True).alias("asked"), neighbours._coded_column(F.col("embedding"), 3, 1).alias("c"))
    keyed = keyed.select("rep", "size", "asked", "c.keys", "c.code")
    keys = {r.rep: r["keys"] for r in keyed.collect()}
    got = {(r.curve, r.rep): r["rank"] for r in neighbours.ranked(keyed, 3).collect()}
    for curve in range(3):
        order = sorted(keys, key=lambda i: (keys[i][curve], i))
        assert [got[curve, i] for i in order] == list(range(300))
