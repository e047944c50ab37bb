"""Streams over the event table: windows with late data, marker sessions, incremental ingest and micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kifu_spark.operators.ordered import in_order, session_number
from kifu_spark.session import checkpoint_dir
from kifu_spark.sources.tables import table


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table's files as a stream; event times get a zone, as watermarks need one."""
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"  # as a pattern, it may be a file or a folder of files
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def run_to_end(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and give what it wrote.

    Every micro-batch goes to a folder of its own, named by the batch, and is overwritten when a batch is repeated:
    with the stream's checkpoint each row arrives exactly once. In update mode the last batch's row of a key counts.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out/*")
    if key:
        latest = F.max_by(F.struct(*[c for c in stream.columns if c not in key]), "batch_id").alias("last")
        return out.groupBy(*key).agg(latest).select(*key, "last.*")
    return out.select(*stream.columns)


def tumbling_counts(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """event_type, began, n, total by tumbling window; with a watermark, rows later than it are dropped.

    Without one every window stays as state: one row for each kind and window, in whatever order files come.
    """
    timed = events.withWatermark("ts", late) if late else events
    counted = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select("event_type", F.col("window.start").alias("began"), "n", "total")


def sliding_counts(events: DataFrame, length: str, slide: str) -> DataFrame:
    """event_type, began, n by overlapping windows; a window is written once the watermark has passed its end."""
    counted = events.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.col("window.start").alias("began"), "n")


def pause_sessions(events: DataFrame, key: str, pause: str) -> DataFrame:
    """key, began, ended, n: sessions that end after a pause, by the engine's own session windows, which merge as rows come."""
    counted = events.groupBy(F.session_window("ts", pause), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def marker_sessions(events: DataFrame, marker: str = "signup") -> DataFrame:
    """user_id, session, n, errors: sessions from one marker to the next, over all rows that a stream has taken in.

    A late row may split a session or move a marker, so rows are numbered in the order of their times once they are
    stored, not as they come.
    """
    number = session_number(F.col("event_type") == marker, in_order(["user_id"], ["ts", "event_id"]))
    return events.withColumn("session", number).groupBy("user_id", "session").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


def first_seen(rows: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """Rows whose key has not been seen, or not within the watermark if there is one: incremental ingest that repeats nothing.

    Without a watermark every key stays as state.
    """
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if late else rows.dropDuplicates([key])


def waiters(requests: DataFrame, replies: DataFrame, key: str, at: str, timeout: Column) -> DataFrame:
    """key, asked, replied, outcome: what became of each request, from a stream of requests and one of replies.

    State is a row for each key with its first request and first reply, in whatever order the two come. A request is
    answered if its reply came before the timeout ran out, timed out if it came later, waiting if it has not come; a
    reply without a request is unasked. Rows without a key or a time are left out. Runs in update mode.
    """
    asked = requests.select(key, F.col(at).alias("asked"), F.lit(None).cast(requests.schema[at].dataType).alias("replied"))
    replied = replies.select(key, F.lit(None).cast(requests.schema[at].dataType).alias("asked"), F.col(at).alias("replied"))
    known = asked.union(replied).filter(F.col(key).isNotNull() & F.coalesce("asked", "replied").isNotNull())
    first = known.groupBy(key).agg(F.min("asked").alias("asked"), F.min("replied").alias("replied"))
    outcome = (
        F.when(F.col("asked").isNull(), "unasked").when(F.col("replied").isNull(), "waiting").when(F.col("replied") <= F.col("asked") + timeout, "answered").otherwise("timed out")
    )
    return first.withColumn("outcome", outcome)


def run_tapped(stream: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Run a stream over all that is there; its rows, and a run log of batch_id, rows and, for each check, the rows that fail it.

    A row fails a check that is false or null. The counts are observed while a micro-batch is written, not read again,
    and logged as one JSON line a batch in a folder of its own, so that a repeated batch replaces its line.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/tap-{uuid.uuid4().hex}"
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()]]
    fields = "batch_id long, rows long" + "".join(f", `{name}` long" for name in checks)

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation(f"tap-{uuid.uuid4().hex}")
        batch.observe(seen, *counts).write.mode("overwrite").parquet(f"{base}/out/batch={number:09d}")
        line = (number, seen.get["rows"], *[seen.get[name] for name in checks])
        spark.createDataFrame([line], fields).coalesce(1).write.mode("overwrite").json(f"{base}/log/batch={number:09d}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*"), spark.read.schema(fields).json(f"{base}/log/*")
