"""Exact dedup and mixing: SQL oracles on the test tables, and the cases their docstrings state."""

import pytest
from pyspark.sql import functions as F

from kifu_spark.llm import exact_dedup, mixing, queries
from tests.oracle import duck_rows, spark_rows

ODD = [
    (1, "a  b", "s", 1), (2, "a b", "s", 2), (3, "a\tb", None, 3), (4, None, "s", 4), (5, "", "t", 5), (6, " ", "t", 6),
    (7, "x " * 5000, "t", 7), (7, "x " * 5000, "t", 7), (None, "a b", "s", 8), (None, None, None, None), (8, "ß é\n\n日本", "s", 9),
]
SCHEMA = "doc_id long, text string, source string, kept int"  # kept clashes with an output name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(queries.oracle_sql()[name], sf_dir)


def dedup_by_hand(rows):
    import hashlib
    import re

    groups = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or ""), []).append(row[0])
    out = []
    for norm, ids in groups.items():
        ordered = sorted(ids, key=lambda i: (i is None, i))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, ordered[0], len(ids), k == 0, sha) for k, i in enumerate(ordered)]
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [1 / 512, 0.2])
def test_exact_dedup_cases(spark, share):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = exact_dedup.exact_dedup(df, hot_share=share, hot_slices=3).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str) == dedup_by_hand(ODD)
    kept = exact_dedup.keep_first_copies(df)
    assert kept.columns == df.columns and kept.count() == len({r[4] for r in dedup_by_hand(ODD)})


def test_exact_dedup_of_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.exact_dedup(df)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 and keep_id = 0").count() == 1000


def test_exact_dedup_plan_is_native_and_shuffles_texts_once(spark):
    plan = exact_dedup.exact_dedup(spark.createDataFrame(ODD, SCHEMA))._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_mix_cases(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(df).collect()))


def test_mix_meets_targets(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "tiny").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
    )
    by = mixing.mix_sources(df).groupBy("source").agg(F.sum("size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert abs(sum(r.target for r in by) - sum(r["size"] for r in by)) < 1e-3
    for r in by:
        assert r.target <= 3 * r["size"] and abs(r.taken - r.target) <= max(64, 0.01 * r.target)


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 490)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 5, 2, 1, 5 of 2000: a stops at 30, then 1970 over 8: null may have 1231.25 of its 1470
    assert got["a"] == 30 and abs(got[None] - 1970 * 5 / 8) < 1e-9 and abs(got["b"] - 1970 * 2 / 8) < 1e-9 and abs(got["c"] - 1970 / 8) < 1e-9


def test_sainte_lague_by_hand(spark):
    parties = spark.createDataFrame([("x", 53.0, 99), ("y", 24.0, 99), ("z", 23.0, 99)], "party string, votes double, most long")
    got = {r.party: r.seats for r in mixing.sainte_lague(parties, [], ["party"], F.lit(7), "seats").collect()}
    quotients = sorted(((v / (2 * k + 1), p) for p, v in (("x", 53), ("y", 24), ("z", 23)) for k in range(7)), key=lambda q: (-q[0], q[1]))[:7]
    assert got == {p: sum(q[1] == p for q in quotients) for p in "xyz"}
