"""Operators on small tables with worked results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kifu_spark.operators import grids, ordered, ranking
from kifu_spark.operators.ratings import fit_ratings


def test_published_ratings():
    won = {("b20", "b15"): (25, 5), ("b20", "b10"): (22, 8), ("b20", "old"): (26, 4), ("b15", "b10"): (23, 7), ("b15", "old"): (30, 0), ("b10", "old"): (24, 6)}
    pairs = [(a, b, w) for (a, b), (w, _) in won.items()] + [(b, a, n) for (a, b), (_, n) in won.items()]
    assert {m: round(x, 1) for m, x in fit_ratings(pairs).items()} == {"b20": 481.6, "b15": 368.7, "b10": 235.2, "old": 0.0}


def test_sweep_is_finite():
    found = fit_ratings([("A", "B", 30)])
    assert found["B"] == 0 and 0 < found["A"] < 1000
    assert fit_ratings([]) == {}


def test_ratings_fit_rates_every_nation_that_played(spark, sf_dir):
    from kifu_spark.plans.statistics import ratings_fit
    from tests.oracle import duck_rows

    games = """FROM lineitem JOIN supplier s ON s_suppkey = l_suppkey JOIN nation w ON w.n_nationkey = s_nationkey
      JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation l ON l.n_nationkey = c_nationkey WHERE w.n_name <> l.n_name"""
    tally = duck_rows(f"SELECT w.n_name AS a, l.n_name AS b, count(*) AS c {games} GROUP BY ALL", sf_dir)[1]
    expected = fit_ratings([(a, b, float(n)) for a, b, n in tally])
    found = {r.model: r.rating for r in ratings_fit(spark, sf_dir).collect()}
    assert found == pytest.approx(expected) and len(found) > 5


def test_percentile_definitions_differ(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double")
    counts = ranking.value_counts(df, [], "v")
    row = counts.agg(ranking.lower_index("v", 0.9).alias("low"), ranking.rounded_index("v", 0.9).alias("near"), ranking.upper_median("v").alias("mid"), ranking.exclusive_quartile("v", 1).alias("q1")).first()
    linear = df.agg(ranking.linear_percentile("v", 0.9)).first()[0]
    assert (row.low, row.near, row.mid, row.q1, round(linear, 9)) == (4.0, 10.0, 3.0, 1.5, 7.6)


def test_running_sum_takes_the_row_that_crosses(spark):
    df = spark.range(1000).select("id", F.lit(97).alias("n"), ranking.seeded_key(1, F.col("id")).alias("key"))
    assert ranking.running_before(df, "key", F.col("n"), "before").filter("before < 5000").count() == 52


def test_global_rank_is_a_permutation(spark):
    df = spark.range(500).select("id", ranking.seeded_key(3, F.col("id")).alias("key"))
    rows = ranking.rank_before(df, "key", "pos").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(500))
    assert [r.key for r in rows] == sorted(r.key for r in rows)


def test_batches_by_gap_and_count(spark):
    df = spark.createDataFrame([("u", t) for t in (0, 1, 2, 3, 4, 50, 51)], "k string, t int").withColumn("gap", F.col("t") == 50)
    rows = ordered.gap_count_batches(df, ["k"], ["t"], F.col("gap"), 4).orderBy("t").collect()
    assert [(r.burst, r.batch) for r in rows] == [(0, 0)] * 4 + [(0, 1), (1, 0), (1, 0)]


def test_padding(spark):
    rows = spark.range(1, 9).select(ordered.padded_size(F.col("id"), 6).alias("p")).collect()
    assert [r.p for r in rows] == [1, 2, 4, 4, 6, 6, 6, 6]


@given(st.integers(0, 7), st.integers(0, 24))
@settings(max_examples=40, deadline=None)
def test_symmetries_move_points_together(symmetry, place):
    source = grids.source_index(symmetry, 5)
    assert sorted(source) == list(range(25))
    assert source[source.index(place)] == place


def test_eight_symmetries_differ():
    assert len({tuple(grids.source_index(k, 3)) for k in range(8)}) == 8


@pytest.mark.parametrize("bits", [8, 9, 27])
def test_packed_bits(spark, bits):
    flags = [(i * 7) % 3 == 0 for i in range(bits)]
    df = spark.createDataFrame([([int(f) for f in flags],)], "f array<int>")
    packed = bytes.fromhex(df.select(grids.packed_bits(F.col("f"), bits)).first()[0])
    assert len(packed) == -(-bits // 8)
    assert [bool(packed[i // 8] >> (7 - i % 8) & 1) for i in range(bits)] == flags


def test_vertices(spark):
    df = spark.createDataFrame([(3 * 19 + 3,), (9 * 19 + 9,)], "p int").withColumn("v", grids.vertex(F.col("p"), 19))
    rows = df.withColumn("back", grids.place_of_vertex(F.col("v"), 19)).collect()
    assert [(r.v, r.back) for r in rows] == [("D16", 60), ("K10", 180)]
    assert spark.range(1).select(grids.place_of_vertex(F.lit("pass"), 19)).first()[0] is None


def test_softmax_and_entropy(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0],)], "w array<double>")
    row = df.select(grids.softmax(F.col("w")).alias("p")).withColumn("e", grids.entropy(F.col("p"))).first()
    assert row.p == [0.25] * 4 and round(row.e, 9) == 1.386294361


def test_regions():
    import numpy as np

    from kifu_spark.plans.arrays import regions_of

    board = np.array([[[1, 0, 1], [1, 0, 0], [1, 1, 1]]], dtype=bool)
    row = regions_of(board).iloc[0]
    assert (row.regions, row.positive, row.largest) == (3, 2, 5)
    assert len(regions_of(np.zeros((0, 3, 3), dtype=bool))) == 0


def test_ranks_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), (None, 3.0)], "g string, v double")
    rows = {(r.g, r.v): (r.n, r.upto, r.total) for r in ranking.value_counts(df, ["g"], "v").collect()}
    assert rows == {(None, 1.0): (1, 1, 3), (None, 3.0): (2, 3, 3), ("a", 2.0): (1, 1, 1)}
    keyed = df.withColumn("key", ranking.seeded_key(1, F.col("v")))
    assert sorted(r.pos for r in ranking.rank_before(keyed, "key", "pos", ["g"]).filter("g is null").collect()) == [0, 1, 2]
