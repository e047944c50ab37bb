"""Running a stream to its end, in arrivals or until it is closed, with its rows written exactly once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.session import checkpoint_dir

#: The store that state with timers needs; state beyond memory goes to the executor's disk.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
TICK = "__tick"

Transform = Callable[[DataFrame], DataFrame]


class Run:
    """A stream that is run again and again over what has come since, from its checkpoint.

    Every micro-batch goes to a folder of its own, named by the batch, and is overwritten when a batch is repeated.
    """

    def __init__(self, stream: DataFrame, mode: str = "append") -> None:
        self.stream, self.mode = stream, mode
        self.base = f"{checkpoint_dir(stream.sparkSession)}/run-{uuid.uuid4().hex}"
        self.progress: list[dict] = []

    def go_on(self) -> None:
        """Take in what there is, until nothing is left to do."""
        spark = self.stream.sparkSession
        usual = spark.conf.get(PROVIDER, None)

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.base}/out/batch={number:09d}")

        spark.conf.set(PROVIDER, ROCKS)
        try:
            writer = self.stream.writeStream.outputMode(self.mode).foreachBatch(write).option("checkpointLocation", f"{self.base}/progress")
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()
            self.progress += [{"batch": p.batchId, "rows": p.numInputRows, "state": [(o.numRowsTotal, o.numRowsDroppedByWatermark) for o in p.stateOperators]} for p in query.recentProgress]
        finally:
            spark.conf.unset(PROVIDER) if usual is None else spark.conf.set(PROVIDER, usual)

    def rows(self) -> DataFrame:
        """What the stream has written so far."""
        return self.stream.sparkSession.read.schema(self.stream.schema).parquet(f"{self.base}/out/*")

    @property
    def dropped(self) -> int:
        """Rows that came after the watermark had passed them."""
        return sum(late for p in self.progress for _, late in p["state"])

    @property
    def held(self) -> int:
        """Rows of state after the last batch."""
        return sum(n for n, _ in self.progress[-1]["state"])


def run_closed(rows: DataFrame, at: str, late: str, transform: Transform, closing: datetime = datetime(9000, 1, 1)) -> Run:
    """Run a stream of rows to its end and close it: a tick moves the watermark past everything, so that timers fire.

    ``late`` is how far rows may come behind the latest one. The tick is a row without content in a stream of its own
    that begins once the rows are through; it moves the watermark and reaches no operator. Two of them come, as what
    one sets off may set a timer itself. Rows without a time are left out, and those before 1970 are late from the start,
    as the engine's watermark begins there.
    """
    spark = rows.sparkSession
    ticks = f"{checkpoint_dir(spark)}/ticks-{uuid.uuid4().hex}"
    schema = rows.withColumn(TICK, F.lit(True)).schema
    spark.createDataFrame([], schema).write.parquet(ticks)
    both = rows.withColumn(TICK, F.lit(False)).unionByName(spark.readStream.schema(schema).parquet(ticks)).withWatermark(at, late)
    # what is observed cannot be filtered earlier, so later filters stay above the watermark, which must see the tick
    seen = both.observe(f"ticks-{uuid.uuid4().hex}", F.count_if(F.col(TICK)).alias("ticks"))
    kept = seen.filter(F.when(F.col(TICK), F.lit(False)).otherwise(F.col(at).isNotNull())).drop(TICK)
    run = Run(transform(kept))
    run.go_on()
    for nth in range(2):
        moment = F.lit(closing.replace(microsecond=1000 * nth)).cast(rows.schema[at].dataType)
        one = spark.range(1).select(*[(moment if f.name == at else F.lit(True) if f.name == TICK else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
        one.coalesce(1).write.mode("append").parquet(ticks)
        run.go_on()
    return run


def run_arrivals(spark: SparkSession, parts: Iterable[DataFrame], transform: Transform) -> Run:
    """Run a stream after each arrival of a part, in the order given, so that what is late is late to the parts before."""
    folder, run = f"{checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}", None
    for part in parts:
        part.write.mode("append").parquet(folder)
        run = run or Run(transform(spark.readStream.schema(part.schema).parquet(folder)))
        run.go_on()
    if run is None:
        raise ValueError("nothing arrived")
    return run
