"""Balanced shards by longest-processing-time scheduling: groups stay together, the largest go first.

A group is all rows with equal texts (compared by SHA-256). The scheduling heap need not know the groups, only how many
there are of each size: the distinct sizes, of which a total of n bytes has fewer than sqrt(2 n), are collected with
their counts, and the groups of a size are dealt in one step, as many to each shard as one by one to the least-loaded
would give. Then the groups are numbered inside their size, in slices, and each takes the shard whose range its number
is in. Loads are those of plain longest-first scheduling, whatever the number of groups.

Places inside a shard (``slot``) come without sorting a shard in one task: its rows are split by a hash of the row's
place into cells of about equal counts, cells get their first slot from a running sum over the cell counts, and rows
are numbered inside their cell.

Only digests, sizes and identifiers are shuffled; copies are summed before the shuffle. What is broadcast has one row
for each cell, bounded by a parameter, or is one of fewer than 1 / share hot keys.

Cases: a null text has no bytes, size 1, checksum 0, and counts as a copy of the empty text. Repeated rows are rows of
their own with slots of their own, however many there are, and so are rows without an identifier. A text of any length
is only measured and hashed. Further columns never matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kifu_spark.llm.skew import join_counted
from kifu_spark.operators.ranking import running_before
from kifu_spark.session import cut, stored

SHARDS = 16
CELLS = 8192
SLICE_DIGITS = 2


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, int]:
    """Item to shard, one by one: the items (item, size), largest first and then by number, each to the least-loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, item in sorted(((size, item) for item, size in sizes), key=lambda x: (-x[0], x[1])):
        load, shard = loads[0]
        placed[item] = shard
        heapq.heapreplace(loads, (load + size, shard))
    return placed


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count items of one size each shard gets, each item going to the least-loaded shard; loads are updated."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    given = [0] * len(loads)

    def one() -> None:
        load, shard = heap[0]
        given[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))

    while count and max(heap)[0] - heap[0][0] >= size:
        one()
        count -= 1
    rounds, rest = divmod(count, len(loads))  # loads within one item of each other: every round gives one to each
    heap = [(load + rounds * size, shard) for load, shard in heap]
    given = [n + rounds for n in given]
    for _ in range(rest):
        one()
    for load, shard in heap:
        loads[shard] = load
    return given


def deal_sizes(counts: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, int, list[int]]]:
    """size, count, upto for the pairs (size, count), largest size first: groups numbered from 0 below upto[0] go to shard 0, and so on."""
    loads, out = [0] * shards, []
    for size, count in sorted(counts, reverse=True):
        out.append((size, count, list(accumulate(deal(loads, size, count)))))
    return out


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, cells: int = CELLS, row_col: str | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, text_sha256 for every row, and ``row`` where a column numbers the rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("")).alias("text_sha256"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        )
    )
    groups = cut(rows.groupBy("text_sha256").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")))
    counts = groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()  # fewer than sqrt(2 * all bytes)
    table = spark.createDataFrame(deal_sizes(((c.bytes, c.n) for c in counts), shards), "bytes long, groups long, upto array<long>")
    numbered = running_before(groups, "text_sha256", F.lit(1).cast("long"), "nth", ["bytes"], SLICE_DIGITS)
    homed = join_counted(numbered, table, "bytes", sum(c.n for c in counts), "groups")
    shard = F.size(F.filter("upto", lambda end: end <= F.col("nth"))).cast("int")
    homes = homed.select("text_sha256", "copies", shard.alias("shard"))
    in_cells = join_counted(rows, cut(homes), "text_sha256", rows.count()).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(max(1, cells // shards))))
    placed = cut(in_cells.drop("copies"))
    firsts = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("rows"))
        .withColumn("first_slot", F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")) - F.col("rows"))
        .select("shard", "cell", "first_slot")
    )
    in_cell = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_sha256", "row")
    return (
        placed.withColumn("nth", F.row_number().over(in_cell))
        .join(F.broadcast(firsts), ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("nth") - 1).alias("slot"), "text_sha256",
            *(["row"] if row_col else []),
        )
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **how) -> None:
    """Write the rows of docs as one folder for each shard, in slot order inside each file; each row once, by its own slot."""
    numbered = stored(docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")))
    rows = numbered.select(F.col("whole").getField(id_col).alias("doc_id"), F.col("whole").getField(text_col).alias("text"), "row")
    placed = shard_documents(rows, row_col="row", **how).select("row", "shard", "slot")
    joined = numbered.join(placed, "row")
    dealt = joined.repartition("shard", F.pmod(F.col("slot"), F.lit(64))).sortWithinPartitions("shard", "slot")
    names = [n for n in docs.columns if n != "shard"]  # the folders name the shard
    dealt.select(*[F.col("whole").getField(n).alias(n) for n in names], "shard").write.partitionBy("shard").parquet(path)
