"""Deleting files by a reviewed list, with guards and a log of what became of each.

A list has path, reason and, for a duplicate, the path of the copy that stays. A duplicate goes only while that copy is
there, is not on the list itself, and is equal byte for byte. Each file has an outcome: deleted (or would delete),
already gone, skipped or failed, with its bytes and, where one is due, a detail. Deleting again finds files gone, so
a run that was killed, or a task that was tried twice, is finished by running it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELETE_LIST = "path string, reason string, kept string"
OUTCOME = "path string, reason string, outcome string, bytes long, detail string"
DUPLICATE = "duplicate"
_CHUNK = 1 << 20


def write_delete_list(rows: DataFrame, path: str) -> None:
    """Tab-separated path, reason and, for duplicates, the copy that stays; refuses to overwrite."""
    rows.select("path", "reason", "kept").write.option("sep", "\t").csv(path, mode="errorifexists")


def read_delete_list(spark: SparkSession, path: str) -> DataFrame:
    """A list read back; lines without a path are left out."""
    return spark.read.schema(DELETE_LIST).option("sep", "\t").option("mode", "PERMISSIVE").csv(path).filter(F.col("path").isNotNull())


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _same_bytes(one: str, other: str) -> bool:
    (files, a), (others, b) = _place(one), _place(other)
    info, second = files.get_file_info(a), others.get_file_info(b)
    if not info.is_file or not second.is_file or info.size != second.size:
        return False
    with files.open_input_stream(a) as left, others.open_input_stream(b) as right:
        while True:
            x, y = left.read(_CHUNK), right.read(_CHUNK)
            if x != y:
                return False
            if not x:
                return True


def _outcome(path: str, reason: str | None, kept: str | None, kept_goes: bool, dry: bool) -> tuple[str, int, str | None]:
    files, at = _place(path)
    info = files.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        return "already gone", 0, None
    try:
        if reason == DUPLICATE:
            if kept_goes:
                return "skipped", 0, f"the kept copy is on the list: {kept}"
            if not kept or kept == path or not _same_bytes(path, kept):
                return "skipped", 0, f"kept copy missing or changed: {kept}"
        if not info.is_file:
            return "failed", 0, "not a file"
        if not dry:
            files.delete_file(at)
    except OSError as error:
        return "failed", 0, str(error)
    return ("would delete" if dry else "deleted"), info.size, None


def guarded_delete(plan: DataFrame, log: str, dry: bool = True) -> DataFrame:
    """Carry out a list once, in tasks, and log it as JSON lines in a new folder; the outcomes, read from that log.

    Only with dry=False is anything deleted. Paths are those of stores that the executors reach.
    """
    listed = plan.select(*[c.split()[0] for c in DELETE_LIST.split(", ")]).dropDuplicates(["path"])
    going = listed.select(F.col("path").alias("kept"), F.lit(True).alias("kept_goes"))
    guarded = listed.join(going, "kept", "left").select("path", "reason", "kept", F.coalesce("kept_goes", F.lit(False)).alias("kept_goes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, r, *_outcome(p, r, k, g, dry)) for p, r, k, g in batch.astype(object).where(batch.notna(), None).itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "reason", "outcome", "bytes", "detail"])

    guarded.mapInPandas(run, OUTCOME).write.json(log, mode="errorifexists")
    return plan.sparkSession.read.schema(OUTCOME).json(log)


def summary(outcomes: DataFrame) -> DataFrame:
    """outcome, files and bytes."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
