"""Operators with state of their own and event-time timers: batches by pause or count, and requests that time out.

Rows are settled once the watermark has passed them, in the order of their times, so results do not depend on the order
in which files come, as long as no row is later than the watermark allows. Times in state are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType


def _milliseconds(micros: int) -> int:
    return -(-micros // 1000)


class PauseOrCount(StatefulProcessor):
    """Rows of a key in batches that close after a pause longer than ``gap`` or at ``most`` rows.

    State holds the rows of the open batch and those that the watermark has not passed, and for each key where its
    bursts stand. Each arrival sets a timer for a pause after its last row: when the watermark is there, no row can
    continue the batch any more, and it is flushed.
    """

    def __init__(self, gap: int, most: int) -> None:
        self.gap, self.most = gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row long")
        self.place = handle.getValueState("place", "burst long, batch int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            came = list(zip(frame["micros"].tolist(), frame["row"].tolist()))
            self.waiting.appendList(came)
            latest = max(came)[0] if latest is None else max(latest, max(came)[0])
        if latest is not None:
            self.handle.registerTimer(_milliseconds(latest + self.gap))
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _settled(self, key, now: int) -> Iterator[pd.DataFrame]:
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = sum(at <= now for at, _ in rows)
        if not ready:
            return
        closed = tuple(self.place.get()) if self.place.exists() else (0, 0, None)  # as after the last closed batch
        burst, batch, last = closed
        out: list[tuple] = []
        batch_rows: list[tuple[int, int]] = []

        def close() -> None:
            nonlocal batch, closed
            out.extend((key[0], row, burst, batch) for _, row in batch_rows)
            batch += 1
            closed = (burst, batch, batch_rows[-1][0])
            batch_rows.clear()

        for at, row in rows[:ready]:
            if last is not None and at - last > self.gap:
                if batch_rows:
                    close()
                burst, batch = burst + 1, 0
            batch_rows.append((at, row))
            last = at
            if len(batch_rows) == self.most:
                close()
        if batch_rows and now >= last + self.gap:
            close()
        rest = batch_rows + rows[ready:]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if out:
            self.place.update(closed)
            yield pd.DataFrame(out, columns=["key0", "row", "burst", "batch"])

    def close(self) -> None:
        pass


def pause_or_count(rows: DataFrame, key: str, at: str, row: str, gap_seconds: int, most: int) -> DataFrame:
    """key, row, burst, batch for a watermarked stream of rows with a numeric row identifier that orders equal times."""
    timed = rows.select(F.col(key).alias("key0"), F.col(at).alias("time"), F.unix_micros(at).alias("micros"), F.col(row).cast("long").alias("row"))
    named = StructType([StructField("key0", rows.schema[key].dataType), *StructType.fromDDL("row long, burst long, batch int").fields])
    found = timed.groupBy("key0").transformWithStateInPandas(PauseOrCount(gap_seconds * 1_000_000, most), named, "Append", "EventTime")
    return found.select(F.col("key0").alias(key), F.col("row").alias(row), "burst", "batch")


#: No time yet: later than any, so that the smaller of two times is the known one.
NONE = np.iinfo(np.int64).max
KNOWN = ("asked", "replied", "settled")


class Waiting(StatefulProcessor):
    """What becomes of requests: answered or, at their time, timed out; replies that come later are late, others unasked.

    A state row is a bucket of requests, kept as one Arrow table, so that a call settles whole columns of them and a
    bucket has one timer, for its earliest request. The first request and the first reply of a key count. A settled
    request is remembered for ``keep``, so that a late reply is known as one, and then leaves state; so does a reply that
    nobody asked for, after ``timeout``.
    """

    def __init__(self, timeout: int, keep: int) -> None:
        self.timeout, self.keep = timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "requests binary, timer long")

    def _load(self) -> tuple[pd.DataFrame | None, int | None]:
        if not self.bucket.exists():
            return None, None
        requests, timer = self.bucket.get()
        return pa.ipc.open_stream(requests).read_all().to_pandas().set_index("key0"), timer

    def _due(self, known: pd.DataFrame) -> np.ndarray:
        """When each request is settled or, if it is, forgotten."""
        asked, replied, settled = (known[c].to_numpy() for c in KNOWN)
        return np.where(asked == NONE, replied, asked) + self.timeout + np.where(settled, self.keep, 0)

    def _store(self, known: pd.DataFrame, timer: int | None) -> None:
        due = None if known.empty else _milliseconds(int(self._due(known).min()))
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.bucket.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        table, out = pa.Table.from_pandas(known.reset_index(), preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.bucket.update((out.getvalue().to_pybytes(), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = None
        for frame in rows:
            micros, is_reply = frame["micros"].to_numpy(), frame["is_reply"].to_numpy().astype(bool)
            times = pd.DataFrame({"key0": frame["key0"], "asked": np.where(is_reply, NONE, micros), "replied": np.where(is_reply, micros, NONE)})
            times = times if came is None else pd.concat([came.reset_index(), times])
            came = times.groupby("key0", sort=False).min()
        if came is None:
            return
        known, timer = self._load()
        if known is None:
            self._store(came.assign(settled=False), timer)
            return
        keys = known.index.union(came.index, sort=False)
        asked, replied, settled = (known[c].reindex(keys, fill_value=none).to_numpy() for c, none in zip(KNOWN, (NONE, NONE, False)))
        fresh_asked, fresh_replied = (came[c].reindex(keys, fill_value=NONE).to_numpy() for c in KNOWN[:2])
        late = settled & (replied == NONE) & (fresh_replied != NONE)
        known = pd.DataFrame(
            {
                "asked": np.where(settled, asked, np.minimum(asked, fresh_asked)),
                "replied": np.where(settled & (replied != NONE), replied, np.minimum(replied, fresh_replied)),
                "settled": settled,
            },
            index=keys.rename("key0"),
        )
        self._store(known, timer)
        yield from self._rows([(known[late], "late", True)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self._load()
        if known is None:
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, settled, unasked = self._due(known), known["settled"].to_numpy(), known["asked"].to_numpy() == NONE
        ends = ~settled & (due <= now)
        in_time = known["replied"].to_numpy() <= due
        timed_out = ends & ~unasked & ~in_time
        late = timed_out & (known["replied"].to_numpy() != NONE)
        out = [(known[ends & unasked], "unasked", True), (known[ends & ~unasked & in_time], "answered", True), (known[timed_out], "timed out", False), (known[late], "late", True)]
        gone = np.where(settled, due <= now, ends & (unasked | (due + self.keep <= now)))
        self._store(known.assign(settled=settled | ends)[~gone], None)  # the timer that was has fired
        yield from self._rows(out)

    @staticmethod
    def _rows(parts: list[tuple[pd.DataFrame, str, bool]]) -> Iterator[pd.DataFrame]:
        """Rows of an outcome each, with or without the reply."""
        for known, outcome, with_reply in parts:
            if not known.empty:
                times = {c: known[c].astype("Int64").mask(known[c] == NONE) if c == "asked" or with_reply else pd.array([pd.NA] * len(known), "Int64") for c in KNOWN[:2]}
                yield pd.DataFrame({"key0": known.index, **{c: pd.array(v, "Int64") for c, v in times.items()}, "outcome": outcome})

    def close(self) -> None:
        pass


def waiting(rows: DataFrame, key: str, at: str, is_reply: Column, timeout_seconds: int, keep_seconds: int, buckets: int = 1024) -> DataFrame:
    """key, asked, replied, outcome for a watermarked stream of requests and replies; rows without a key are left out.

    outcome is answered, timed out (no reply in time; replied is null), late (the reply to a request that has timed
    out, a row of its own) or unasked (asked is null). State is dealt over ``buckets`` by the key's hash; the open
    requests of one bucket must fit in a worker.
    """
    known = rows.filter(F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(key).alias("key0"), F.col(at).alias("time"),
        F.unix_micros(at).alias("micros"), F.coalesce(is_reply, F.lit(False)).alias("is_reply"),
    )
    named = StructType([StructField("key0", rows.schema[key].dataType), *StructType.fromDDL("asked long, replied long, outcome string").fields])
    found = known.groupBy("bucket").transformWithStateInPandas(Waiting(timeout_seconds * 1_000_000, keep_seconds * 1_000_000), named, "Append", "EventTime")
    return found.select(F.col("key0").alias(key), F.timestamp_micros("asked").alias("asked"), F.timestamp_micros("replied").alias("replied"), "outcome")
