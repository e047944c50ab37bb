"""Waiters, run logs and large rating fits against small results."""

import math

from pyspark.sql import functions as F

from kifu_spark.operators.ratings import ratings
from kifu_spark.streaming import events as stream


def test_waiters_in_any_order(spark):
    rows = "id int, at timestamp"
    asked = spark.sql("SELECT * FROM VALUES (1, 0), (1, 5), (2, 0), (3, 0), (NULL, 0), (5, NULL) t(id, s)").selectExpr("id", "timestamp_seconds(s) AS at").to(spark.createDataFrame([], rows).schema)
    replied = spark.sql("SELECT * FROM VALUES (1, 60), (1, 3), (2, 61), (4, 1) t(id, s)").selectExpr("id", "timestamp_seconds(s) AS at").to(spark.createDataFrame([], rows).schema)
    found = stream.waiters(asked, replied, "id", "at", F.expr("INTERVAL '60' SECOND"))
    assert {r.id: r.outcome for r in found.collect()} == {1: "answered", 2: "timed out", 3: "waiting", 4: "unasked"}


def test_tap_logs_each_batch(spark, tmp_path):
    for part in range(3):
        spark.range(10 * part, 10 * part + 10).withColumn("x", F.when(F.col("id") % 5 > 0, F.col("id"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    source = spark.readStream.schema("id long, x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    out, log = stream.run_tapped(source, {"small": F.col("x") < 21, "known": F.col("x").isNotNull()})
    assert out.count() == 30 and out.columns == ["id", "x"]
    lines = [r.asDict() for r in log.orderBy("batch_id").collect()]
    assert [r["batch_id"] for r in lines] == [0, 1, 2] and [r["rows"] for r in lines] == [10, 10, 10]
    assert sum(r["known"] for r in lines) == 6 and sum(r["small"] for r in lines) == 14


def test_many_ratings_agree_with_few(spark):
    rows = [("A", "B", 6.0), ("B", "A", 4.0), ("A", "C", 7.0), ("C", "A", 5.0), ("B", "C", 6.0), ("C", "B", 5.0), ("A", "A", 3.0), (None, "A", 1.0)]
    tally = spark.createDataFrame(rows, "winner string, loser string, wins double")
    few = {r.model: r.rating for r in ratings(spark, tally).collect()}
    many = {r.model: r.rating for r in ratings(spark, tally, most_pairs=3).collect()}
    assert few.keys() == many.keys() == {"A", "B", "C"}
    assert all(math.isclose(few[m], many[m], abs_tol=0.01) for m in few)
