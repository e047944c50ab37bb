"""Streams over a table of many files that do not come in the order of their times."""

import os

import pytest
from pyspark.sql import functions as F

from kifu_spark import catalog
from tests.oracle import duck_rows, spark_rows

FILES = 24


@pytest.fixture(scope="module")
def long_table(spark, sf_dir, tmp_path_factory):
    """The events over some four months, the latest in the first files, as three micro-batches of eight files."""
    base = tmp_path_factory.mktemp("late")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.timestamp_add("DAY", F.col("event_id") % 90, F.col("ts")))
    rows = events.orderBy("ts").toPandas()
    (base / "events.parquet").mkdir()
    for k in range(FILES):
        part = rows.iloc[k * len(rows) // FILES : (k + 1) * len(rows) // FILES]
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(base / f"part{k}"))
        (written,) = (base / f"part{k}").glob("*.parquet")
        found = written.rename(base / "events.parquet" / f"{FILES - k:02d}.parquet")
        os.utime(found, (1_700_000_000 - 60 * k, 1_700_000_000 - 60 * k))  # files come by their time of change
    return str(base)


@pytest.mark.parametrize("name", ["stream_ingest_once", "stream_sessions", "stream_tumbling_counts", "stream_gap_count_batches", "stream_pause_sessions"])
def test_late_files_count(spark, long_table, tmp_path, name):
    sql = catalog.oracle_sql()[name].replace("FROM events", f"FROM read_parquet('{long_table}/events.parquet/*.parquet')")
    assert spark_rows(catalog.queries()[name](spark, long_table)) == duck_rows(sql, str(tmp_path))
