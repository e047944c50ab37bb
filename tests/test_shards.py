"""Shards by position: dense places, slices that wrap, few files read, checks from the table of shards, conversion reports."""

import json

import pytest
from pyspark.sql import functions as F

from kifu_spark.operators.ranking import seeded_key
from kifu_spark.sources import shards


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shards") / "s")
    rows = spark.range(2500).select(
        F.when(F.col("id") % 5 == 0, "val").when(F.col("id") < 2400, "train").alias("split"), seeded_key(3, F.col("id")).alias("key"), "id", F.lit("clash").alias("rows")
    )
    shards.write_shards(rows, path, "key", ["a", "b"], [3, 3, 2], 3, 200)
    kept = [r.id for r in rows.filter("split = 'train'").orderBy("key").collect()]
    return path, kept


def test_places_are_those_of_the_whole_shuffle(spark, store):
    path, kept = store
    opened = shards.open_shards(spark, path, "train")
    assert (opened.total, opened.features, opened.shape) == (len(kept), ["a", "b"], [3, 3, 2])
    rows = spark.read.parquet(f"{path}/rows").filter("split = 'train'").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(kept))) and [r.id for r in rows] == kept
    sizes = [r["rows"] for r in opened.table.collect()]
    assert len(sizes) == 10 and sum(sizes) == len(kept)


@pytest.mark.parametrize("position, n", [(0, 1), (5, 40), (190, 30), (1910, 20), (10**6, 7), (1915, 4000), (3, 1920), (0, 1921)])
def test_slices_wrap(spark, store, position, n):
    path, kept = store
    got = {r.at: r.id for r in shards.open_shards(spark, path, "train").read(position, n).collect()}
    assert got == {at: kept[at % len(kept)] for at in range(position, position + n)}


def test_a_slice_opens_only_its_files(spark, store):
    path, kept = store
    opened = shards.open_shards(spark, path, "train")
    whole = spark.read.parquet(f"{path}/rows").filter("split = 'train'").inputFiles()
    around_the_end = opened.read(opened.total - 10, 20)
    files = around_the_end.inputFiles()
    assert len(files) == 2 and {f.split("shard=")[1].split("/")[0] for f in files} == {"0", "9"} and len(whole) >= 10
    plan = around_the_end._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "pos" in plan.split("PushedFilters")[1].split("]")[0]
    for folder in opened.folders(0, opened.total):  # one sorted file a shard: its footer's smallest and largest place are its own
        assert len(spark.read.parquet(folder).inputFiles()) == 1


def test_first_places_are_at_most_all(spark, store):
    opened = shards.open_shards(spark, store[0], "val")
    assert sorted(r.pos for r in opened.first(10**9).collect()) == list(range(opened.total))


def test_stores_are_checked_by_their_table(spark, store, tmp_path):
    path, _ = store
    with pytest.raises(ValueError, match="no shards"):
        shards.open_shards(spark, path, "test")
    lines = [r.asDict() for r in spark.read.schema(shards.SHARDS).json(f"{path}/shards").filter("split = 'train'").orderBy("shard").collect()]
    for name, fault in {"gap": lines[:3] + lines[4:], "kind": [*lines[:-1], lines[-1] | {"features": "a"}]}.items():
        (tmp_path / name / "shards").mkdir(parents=True)
        (tmp_path / name / "shards" / "t.json").write_text("\n".join(map(json.dumps, fault)))
        with pytest.raises(ValueError, match="gaps" if name == "gap" else "differ"):
            shards.open_shards(spark, str(tmp_path / name), "train")


def test_writing_refuses_to_overwrite(spark, store):
    rows = spark.range(3).select(F.lit("train").alias("split"), seeded_key(1, F.col("id")).alias("key"), "id")
    with pytest.raises(Exception, match="(?i)already exists"):
        shards.write_shards(rows, store[0], "key", ["a"], [1], 1)


def test_conversion_report(spark, tmp_path):
    path = str(tmp_path / "c")
    games = spark.createDataFrame([("train", "g1", "p1", "normal", 30), ("train", "g2", "p2", "handicap", 20), ("val", "g3", "p3", "normal", 10), ("train", "g4", "p4", "normal", 5)], "split string, game string, path string, gtype string, declared long")
    kinds = [("train", "g1", 30), ("train", "g2", 20), ("val", "g3", 10)]
    rows = [(s, g, i, "pass" if i % 10 == 9 else "loss" if i % 7 == 6 else None) for s, g, n in kinds for i in range(n)]
    positions = spark.createDataFrame(rows, "split string, game string, move int, reason string").withColumn("key", seeded_key(1, F.col("game"), F.col("move")))
    shards.write_converted(positions, games, path, "key", ["train", "val"], ["pass", "loss", "cut"], ["f"], [2], 1, 20)
    got = {r.split: r for r in shards.read_report(spark, path).collect()}
    for split in ("train", "val"):
        mine = [r for r in rows if r[0] == split]
        dropped = {k: sum(r[3] == k for r in mine) for k in ("pass", "loss", "cut")}
        r = got[split]
        assert r.dropped == dropped and r.positions == len(mine) - sum(dropped.values())
        assert round(r.dropped_percent, 9) == round(100 * sum(dropped.values()) / len(mine), 9)
    assert (got["train"].games, got["train"].games_without_positions, got["train"].declared) == (3, 1, 55)
    sizes = [r["rows"] for r in shards.open_shards(spark, path, "train").table.collect()]
    assert (got["train"].shards, got["train"].smallest_shard, got["train"].largest_shard) == (len(sizes), min(sizes), max(sizes))
