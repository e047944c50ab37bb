"""A manifest that grows by numbered batches, each of which counts exactly once.

A batch is staged as JSON lines in a folder of its own, with a name that no other attempt has, and then committed by a
marker that names the folder. A marker appears as a whole, by a rename, and only once for a number: a batch that is
repeated, by a stream or by a run that was killed before it knew, is ignored, and what was staged without a marker is
never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.sources.records import not_yet_recorded, read_manifest


class ManifestSink:
    """Batches of rows below a folder in any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, number: int):
        return self._paths(f"{self.path}/commits/{number:09d}")

    def committed(self) -> dict[int, str]:
        """Folder names by batch number: one short line for each batch."""
        folder = self._paths(f"{self.path}/commits")
        if not self._files.exists(folder):
            return {}
        found = [s.getPath().getName() for s in self._files.listStatus(folder)]
        if not (names := [n for n in found if n.isdigit()]):
            return {}
        lines = self.spark.read.text([f"{self.path}/commits/{n}" for n in names]).collect()
        return {entry["batch"]: entry["folder"] for entry in (json.loads(line.value) for line in lines)}

    def _staged(self, rows: DataFrame, number: int) -> str:
        folder = f"{number:09d}-{uuid.uuid4().hex}"
        rows.write.option("ignoreNullFields", False).option("compression", "gzip").json(f"{self.path}/rows/{folder}")
        return folder

    def _commit(self, number: int, folder: str) -> bool:
        hidden = self._paths(f"{self.path}/commits/.{folder}")
        out = self._files.create(hidden, True)
        out.write(bytearray((json.dumps({"batch": number, "folder": folder}) + "\n").encode()))
        out.close()
        if self._files.exists(self._marker(number)):
            done = False
        else:
            try:
                done = self._files.rename(hidden, self._marker(number))
            except Py4JJavaError:  # another run made it in the meantime
                done = False
        if not done:
            self._files.delete(hidden, False)
        return done

    def append(self, number: int, rows: DataFrame) -> bool:
        """Write a batch unless one of that number is committed; whether this one counts. Fits foreachBatch."""
        if self._files.exists(self._marker(number)):
            return False
        return self._commit(number, self._staged(rows, number))

    def read(self, schema: str) -> DataFrame:
        """The rows of all committed batches, damaged lines and duplicates of a path left out of none: struct value and damaged."""
        folders = [f"{self.path}/rows/{f}" for _, f in sorted(self.committed().items())]
        if not folders:
            return self.spark.createDataFrame([], f"value struct<{schema}>, damaged boolean")
        return read_manifest(self.spark, folders, schema)

    def resume(self, records: DataFrame, scan: Callable[[DataFrame], DataFrame], schema: str, key: str = "path") -> bool:
        """Scan the records that no committed row lists and append them as the next batch; whether there were any."""
        known = self.read(schema).filter(~F.col("damaged")).select(f"value.{key}").distinct()
        todo = not_yet_recorded(records, known, key)
        if todo.isEmpty():
            return False
        return self.append(max(self.committed(), default=-1) + 1, scan(todo))
