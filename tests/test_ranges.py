"""A rank over the whole table by ranges of its whole order."""

from pyspark.sql import functions as F

from kifu_spark.operators import ranking


def test_keys_with_one_head_are_dealt_over_ranges(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("1www.example/"), F.md5(F.col("id").cast("string"))).alias("walk"), "id")
    parted = ranking.range_parts(rows, ["walk", "id"], "part")
    sizes = [r["count"] for r in parted.groupBy("part").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000
    found = [r.id for r in ranking.rank_in_order(rows, ["walk", "id"], "place").orderBy("place").collect()]
    assert found == [r.id for r in sorted(rows.collect())]


def test_walk_order_has_no_window_by_a_head_of_the_key(spark, sf_dir):
    from kifu_spark.plans.hygiene import walk_order

    plan = walk_order(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(walk" not in plan and "head" not in plan


def test_one_far_value_moves_no_edge(spark):
    """A hundred thousand values below one and one of 1e9: slices hold about as many values each, ranks stay exact."""
    from pyspark.sql import functions as F

    from kifu_spark.operators import ranking

    df = spark.range(100_000).select(F.when(F.col("id") == 0, F.lit(1e9)).otherwise(F.col("id") / 100_000).alias("v"))
    edges = df.agg(ranking._splitters("v", 256).alias("e")).select(F.explode("e").alias("e"))
    values = df.join(F.broadcast(edges.agg(F.collect_list("e").alias("edges")))).withColumn("slice", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    sizes = [r["count"] for r in values.groupBy("slice").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 3 * 100_000 / 256
    row = ranking.value_counts(df, [], "v").agg(ranking.lower_index("v", 0.5).alias("mid"), ranking.lower_index("v", 1.0).alias("top"), F.max("upto").alias("n")).first()
    assert (row.mid, row.top, row.n) == (0.5, 1e9, 100_000)


def test_prefix_keys_are_those_of_the_steps(spark):
    from pyspark.sql import functions as F

    from kifu_spark.operators.ordered import prefix_keys

    rows = [(1, ["a", "b", None, "c"]), (2, ["a", "b", None, "d"]), (3, ["ab"]), (4, []), (5, ["b", "a"]), (6, ["a", "b", "", "c"])]
    df = spark.createDataFrame(rows, "id int, steps array<string>").select("id", "steps", F.explode(prefix_keys(F.col("steps"), 3)).alias("p"))
    by_key, by_prefix = {}, {}
    for r in df.select("id", "steps", "p.len", "p.key").collect():
        by_key.setdefault(tuple(r.key), set()).add(r.id)
        by_prefix.setdefault(tuple(r.steps[: r.len]), set()).add(r.id)
    assert sorted(map(sorted, by_key.values())) == sorted(map(sorted, by_prefix.values())) and len(by_key) == 7


def test_percentiles_hold_on_large_groups(spark):
    # more distinct values than a sketch holds, in many partitions: its ends differ from run to run, ranks may not
    n = 400_000
    rows = spark.range(n).repartition(16).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    rows = rows.union(spark.range(30).select(F.lit(2), F.col("id").cast("double"))).union(spark.range(3).select(F.lit(3), F.lit(None).cast("double")))
    by_hand = {g: [float(v) for v in range(n) if v % 2 == g] for g in (0, 1)} | {2: [float(v) for v in range(30)]}
    near = ranking.value_counts(rows, ["g"], "v", near=[0.0, 0.5, 0.9, 1.0])
    assert near.filter("g < 2").count() < n / 20
    for counts in (near, ranking.value_counts(rows, ["g"], "v")):
        aggs = [ranking.lower_index("v", 0.9), ranking.upper_median("v"), ranking.linear_index("v", 0.5), ranking.lower_index("v", 0.0), ranking.lower_index("v", 1.0), F.max("total")]
        got = {r[0]: tuple(r)[1:] for r in counts.groupBy("g").agg(*aggs).collect()}
        for g, v in by_hand.items():
            m = len(v)
            assert got[g] == (v[int(0.9 * (m - 1))], v[m // 2], (v[(m - 1) // 2] + v[m // 2]) / 2, v[0], v[-1], m)
        assert set(got) == {0, 1, 2}
