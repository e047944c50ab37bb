"""State with timers: batches, requests that time out, and what is late, over arrivals whose order is known."""

from pyspark.sql import functions as F

from kifu_spark.streaming import events as stream
from kifu_spark.streaming.runs import run_arrivals, run_closed
from kifu_spark.streaming.stateful import pause_or_count, waiting


START = 1_200_000_000  # a watermark begins in 1970, and drops what lies before


def parts(spark, *lists):
    for rows in lists:
        yield spark.createDataFrame(rows, "id long, s long, is_reply boolean").select("id", F.timestamp_seconds(F.col("s") + START).alias("at"), "is_reply")


def test_requests_time_out_and_leave_state(spark):
    arrivals = parts(
        spark,
        [(1, 0, False), (2, 0, False), (9, 100, False), (None, 5, True)],  # watermark 90: the first two time out
        [(1, 95, True), (3, 95, True), (9, 120, True), (8, 300, False)],  # the first reply is late, the second unasked, the third in time
        [(2, 50, True), (7, 5000, False)],  # behind the watermark: dropped
    )
    run = run_arrivals(spark, arrivals, lambda df: waiting(df.withWatermark("at", "10 seconds"), "id", "at", F.col("is_reply"), 60, 1000))
    got = sorted((r.id, r.outcome, r.asked and r.asked.second, r.replied and r.replied.timestamp() - START) for r in run.rows().collect())
    assert [g[:2] for g in got] == [(1, "late"), (1, "timed out"), (2, "timed out"), (3, "unasked"), (8, "timed out"), (9, "answered")]
    assert [g[3] for g in got] == [95, None, None, 95, None, 120] and got[3][2] is None
    assert run.dropped == 1
    assert run.held == 1  # the last request alone still waits


def test_batches_are_flushed_by_timers(spark):
    rows = lambda *xs: [(1, x, None) for x in xs]
    batches = lambda df: pause_or_count(df.withColumn("row", F.unix_seconds("at") - START).withWatermark("at", "5 seconds"), "id", "at", "row", 10, 3)
    seen = []

    def arrivals():
        for part in parts(spark, rows(0, 4, 2), rows(6, 7, 30), rows(31, 90), [(2, 200, None)]):
            yield part

    run = run_arrivals(spark, arrivals(), batches)
    got = {r.row: (r.burst, r.batch) for r in run.rows().collect() if r.id == 1}
    assert got == {0: (0, 0), 2: (0, 0), 4: (0, 0), 6: (0, 1), 7: (0, 1), 30: (1, 0), 31: (1, 0), 90: (2, 0)}
    assert not seen and run.held >= 2  # a row for where each key's bursts stand


def test_closed_runs_lose_nothing_in_any_order(spark, tmp_path):
    rows = [(k, 97 * i % 1009 + k, bool(i % 2)) for k in range(7) for i in range(30)]
    df = next(parts(spark, rows))
    df.repartition(9).write.parquet(str(tmp_path / "t"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "t"))
    run = run_closed(source.withColumn("row", F.unix_seconds("at") - START), "at", "1100 seconds", lambda s: pause_or_count(s, "id", "at", "row", 40, 4))
    got = {(r.id, r.row): (r.burst, r.batch) for r in run.rows().collect()}
    expected = {}
    for key in range(7):
        burst = n = 0
        before = None
        for at in sorted(s for k, s, _ in rows if k == key):
            if before is not None and at - before > 40:
                burst, n = burst + 1, 0
            expected[key, at], n, before = (burst, n // 4), n + 1, at
    assert got == expected and run.dropped == 0


def test_late_rows_are_dropped_and_counted(spark):
    arrivals = parts(spark, [(1, 0, None), (2, 1000, None)], [(3, 850, None), (4, 950, None), (4, 960, None)], [(5, 899, None), (6, 901, None)])
    run = run_arrivals(spark, arrivals, lambda df: stream.first_seen(df.withColumnRenamed("at", "ts"), "id", "100 seconds"))
    assert sorted(r.id for r in run.rows().collect()) == [1, 2, 4, 6]
    assert run.dropped == 2


def test_requests_of_a_bucket_share_a_state_row(spark):
    asked = [(k, k % 50, False) for k in range(400)]
    replies = [(k, k % 50 + (30 if k % 3 else 70), True) for k in range(0, 400, 2)]
    ways = {}
    for buckets in (1, 7):
        arrivals = parts(spark, asked, [*replies, (1000, 400, False)], [(1001, 5000, False), (1002, 5001, False)])
        run = run_arrivals(spark, arrivals, lambda df: waiting(df.withWatermark("at", "100 seconds"), "id", "at", F.col("is_reply"), 60, 100, buckets))
        ways[buckets] = sorted((r.id, r.outcome) for r in run.rows().collect())
        assert max(n for p in run.progress for n, _ in p["state"]) <= buckets and run.held <= 2
    expected = [(k, "answered" if k % 3 else "timed out") for k in range(0, 400, 2)] + [(k, "late") for k in range(0, 400, 6)]
    assert ways[1] == ways[7] == sorted(expected + [(k, "timed out") for k in range(1, 400, 2)] + [(1000, "timed out")])
