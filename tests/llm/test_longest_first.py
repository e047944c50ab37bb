"""Dealing by sizes against plain longest-first scheduling, on many groups."""

import random

import pytest
from pyspark.sql import functions as F

from kifu_spark.llm import sharding


def loads_by_hand(sizes, shards):
    placed = sharding.longest_first(enumerate(sizes), shards)
    loads = [0] * shards
    for item, shard in placed.items():
        loads[shard] += sizes[item]
    return loads


@pytest.mark.parametrize("seed", range(6))
def test_dealt_sizes_give_the_same_loads(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 9), rng.randint(1, 1000), rng.randint(1, 10**6) if rng.random() < 0.05 else 7]) for _ in range(rng.choice([3, 50, 5000]))]
    shards = rng.choice([1, 2, 5, 16])
    counts = {s: sizes.count(s) for s in set(sizes)}
    loads = [0] * shards
    for size, count, upto in sharding.deal_sizes(counts.items(), shards):
        assert upto[-1] == count
        for shard, (low, high) in enumerate(zip([0, *upto], upto)):
            loads[shard] += size * (high - low)
    assert loads == loads_by_hand(sizes, shards)


def test_a_hundred_thousand_groups(spark):
    """Groups of 20 sizes and a hot one of two fifths of the rows: every shard has the load of plain longest-first."""
    text = F.when(F.col("id") % 5 < 2, "one text that very many rows share").otherwise(F.rpad(F.col("id").cast("string"), 10 + F.pmod(F.xxhash64("id"), F.lit(20)).cast("int"), "x"))
    df = spark.range(160_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("clash").alias("shard")).repartition(8)
    found = sharding.shard_documents(df)
    groups = [r[0] for r in df.groupBy("text").agg(F.sum(F.octet_length("text") + 1)).select(F.col("sum((octet_length(text) + 1))")).collect()]
    assert len(groups) == 96_001
    got = {r.shard: r for r in found.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).collect()}
    assert sorted(r.bytes for r in got.values()) == sorted(loads_by_hand(groups, 16))
    assert all(r["last"] + 1 == r.n == r.slots for r in got.values())
    assert found.groupBy("text_sha256").agg(F.count_distinct("shard").alias("n")).filter("n > 1").isEmpty()
