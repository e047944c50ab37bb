"""Rows that share identifiers, repeated rows, written shards, balance and hubs."""

import heapq
import os
import random

import pytest
from pyspark.sql import functions as F

from kifu_spark.llm import components, sharding, simhash, skew

ROWS = [
    (7, "a b c d e f g h", "x"), (7, "quite another text of several words here", "y"), (7, "a b c d e f g h", "x"), (7, "a b c d e f g h", "b"),
    (8, "a b c d e f g h", "z"), (None, "nobody owns this text of some words", "u"), (None, "nobody owns this text of some words", "u"),
    (None, "nor this one which is quite different", "v"), (9, None, "w"), (10, "", "w"), (11, "word " * 40_000, "w"),
]
SCHEMA = "doc_id long, text string, row string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_one_row_of_each_component_and_no_other_loss(df):
    kept = simhash.keep_one_of_each(df)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == df.columns
    assert sorted(got, key=str) == sorted([ROWS[0][:2], ROWS[1][:2], ROWS[5][:2], ROWS[7][:2], (9, None), ROWS[10][:2]], key=str)
    assert sorted(map(str, kept.collect())) == sorted(map(str, simhash.keep_one_of_each(df.repartition(3)).collect()))


def test_written_shards_hold_each_row_once(spark, df, tmp_path):
    path = os.path.join(tmp_path, "out")
    sharding.write_shards(df, path, shards=3)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    homes = back.groupBy(F.coalesce("text", F.lit(""))).agg(F.count_distinct("shard").alias("n")).collect()
    assert all(r.n == 1 for r in homes)


def plain_lpt(sizes, shards):
    loads = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(loads)
        heapq.heappush(loads, (load + size, s))
    return sorted(load for load, _ in loads)


def test_shards_equal_plain_longest_first(spark):
    rng = random.Random(1)
    texts = ["x" * int(rng.paretovariate(1.1) * 20) for _ in range(150)] + ["hot copy " * 9] * 100
    texts = [t + str(k) if t[0] == "x" else t for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k % 9, t) for k, t in enumerate(texts)], "doc_id long, text string")
    by = sharding.shard_documents(df, shards=5).groupBy("shard").agg(F.sum("size").alias("load")).collect()
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + len(t) + 1
    assert sorted(r.load for r in by) == plain_lpt(groups.values(), 5)


def test_repeated_rows_spread_over_cells(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard_documents(df, shards=2, cells=16).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(2000))


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_counted_joins(spark, share):
    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(90)], "key long, x long")
    right = left.groupBy("key").agg(F.count("*").alias("copies"), F.sum("x").alias("total")).filter("key < 6")
    got = skew.join_counted(left, right, "key", 90, hot_share=share)
    assert sorted(map(str, got.select("key", "x", "total").collect())) == sorted(map(str, left.join(right, "key").select("key", "x", "total").collect()))


def test_components_of_hubs_that_meet(spark):
    edges = [(0, k) for k in range(1, 900)] + [(2000, k) for k in range(2001, 2600)] + [(899, 2599), (5000, 5001)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(got) == 1502 and {got[n] for n in got if n < 5000} == {0} and got[5001] == 5000
