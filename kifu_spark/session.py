"""Session defaults and the shared folder for cut lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every query here expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kifu_spark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that UDF modules import there."""
    sc = spark.sparkContext
    if getattr(sc, "_kifu_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="kifu-"), "kifu_spark_pkg.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("kifu_spark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._kifu_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only for local masters."""
    sc = spark.sparkContext
    if found := sc.getCheckpointDir():
        return found
    if not (chosen := sc.getConf().get("spark.checkpoint.dir")):
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        chosen = tempfile.mkdtemp(prefix="kifu-checkpoint-")
    sc.setCheckpointDir(chosen)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it back: smaller than a checkpoint, with statistics.

    Row groups of 32 MB and Zstandard keep the writers' memory and the folder small where rows hold whole texts.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expect_long_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small where whole texts go through Python, unless the session has a setting of its own."""
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, str(rows))
