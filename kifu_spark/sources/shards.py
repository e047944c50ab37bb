"""Shards by position: rows in shuffled order, found, checked and read by place.

A store has a folder for each split with a folder for each shard, ``rows/split=train/shard=12``. A shard holds the keys
of one equal interval of the seeded hash, so a row's shard follows from its key alone, shards follow each other in the
order of the whole shuffle, and they differ in size only by chance. Inside a shard rows are sorted by ``pos``, their
dense place in the split, so that files have narrow minima and maxima of it. One count of keys and one shuffle write it.

``shards`` beside ``rows`` says for each shard where it begins, how many rows it has and what they hold. It is written
last, and a store without it is not complete. Opening and checking a store reads this table alone; reading a slice
lists the folders that hold it, and inside them the pushed filter on ``pos`` skips row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from kifu_spark.session import cut

SHARDS = "split string, shard int, first long, rows long, features string, shape array<int>, seed long"
ROWS_PER_SHARD = 1_000_000


def shard_of(key: Column, shards: Column) -> Column:
    """The interval, of equal ones, that holds a hex digest."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * shards / (1 << 32)).cast("int")


def write_shards(
    rows: DataFrame, path: str, key: str, features: list[str], shape: list[int], seed: int, rows_per_shard: int = ROWS_PER_SHARD, split: str = "split"
) -> None:
    """Write each split of the rows, in the order of the hex digest ``key``, as shards of about that many rows; refuses to overwrite.

    Equal keys follow each other by the other columns. Rows without a split are in none and are not written. Columns
    named shard and pos are the store's own. The rows are read twice, once for their keys alone; what is dear to make
    is stored before.
    """
    others = [c for c in rows.columns if c not in (split, key, "shard", "pos")]
    sizes = rows.groupBy(split).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows_per_shard)).cast("int").alias("__shards"))
    sharded = rows.join(F.broadcast(sizes), split).withColumn("shard", shard_of(F.col(key), F.col("__shards"))).drop("__shards")  # one row for each split
    counted = sharded.groupBy(F.col(split).alias("split"), "shard").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("split").orderBy("shard"))
    described = counted.withColumns(
        {"first": upto - F.col("rows"), "features": F.lit(",".join(features)), "shape": F.array(*[F.lit(s) for s in shape]).cast("array<int>"), "seed": F.lit(seed).cast("long")}
    )
    table = cut(described.select(*[c.split()[0] for c in SHARDS.split(", ")]))  # a row for each shard
    nth = F.row_number().over(Window.partitionBy("split", "shard").orderBy(key, *others))
    placed = (
        sharded.withColumnRenamed(split, "split")
        .withColumn("__nth", nth)
        .join(F.broadcast(table.select("split", "shard", F.col("first").alias("__first"))), ["split", "shard"])
        .select("split", "shard", (F.col("__first") + F.col("__nth") - 1).alias("pos"), key, *others)
    )
    # the window leaves a shard's rows sorted in one task, and writing keeps that order
    placed.write.partitionBy("split", "shard").option("parquet.block.size", 8 << 20).parquet(f"{path}/rows", mode="errorifexists")
    table.coalesce(1).write.json(f"{path}/shards", mode="errorifexists")


def write_converted(
    positions: DataFrame, games: DataFrame, path: str, key: str, splits: list[str], reasons: list[str], features: list[str], shape: list[int], seed: int, rows_per_shard: int = ROWS_PER_SHARD
) -> None:
    """Write shards of the positions without a drop ``reason``, a table of games, and a conversion report.

    Positions have split, game and reason; games have split, game, path, gtype and declared, their stated moves. What
    is dropped is observed while the positions are read for the shards, without another pass. The report has one row a
    split: games, those without positions, positions, declared moves, drops by reason and for all, and the smallest and
    the largest shard.
    """
    seen = Observation()
    here = lambda s, r: (F.col("split") == s) & (F.col("reason") == r)
    counts = [F.count_if(here(s, r)).alias(f"{s}|{r}") for s in splits for r in reasons]
    kept = positions.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).filter(F.col("reason").isNull()).drop("reason")
    write_shards(kept, path, key, features, shape, seed, rows_per_shard)
    spark = positions.sparkSession
    written = spark.read.parquet(f"{path}/rows").groupBy("split", "game").agg(F.count("*").alias("positions"))
    listed = games.join(written, ["split", "game"], "left").withColumn("positions", F.coalesce("positions", F.lit(0)))
    listed = listed.select("game", "path", "gtype", "positions", "split", "declared")
    listed.write.partitionBy("split").option("sep", "\t").option("header", True).csv(f"{path}/games", mode="errorifexists")
    drops = [(s, {r: seen.get[f"{s}|{r}"] for r in reasons}) for s in splits]
    dropped = spark.createDataFrame(drops, "split string, dropped map<string, long>")  # one row for each split
    by_game = spark.read.schema("game string, path string, gtype string, positions long, declared long, split string").option("sep", "\t").option("header", True).csv(f"{path}/games")
    summary = by_game.groupBy("split").agg(
        F.count("*").alias("games"), F.count_if(F.col("positions") == 0).alias("games_without_positions"), F.sum("positions").alias("positions"), F.sum("declared").alias("declared")
    )
    sizes = spark.read.schema(SHARDS).json(f"{path}/shards").groupBy("split").agg(
        F.count("*").alias("shards"), F.min("rows").alias("smallest_shard"), F.max("rows").alias("largest_shard")
    )
    whole = F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda a, n: a + n)
    report = summary.join(F.broadcast(dropped), "split", "left").join(F.broadcast(sizes), "split", "left").withColumn(
        "dropped_percent", F.lit(100.0) * whole / F.greatest(F.col("positions") + whole, F.lit(1))
    )
    report.coalesce(1).write.json(f"{path}/conversion", mode="errorifexists")


REPORT = (
    "split string, games long, games_without_positions long, positions long, declared long, dropped map<string, long>, "
    "dropped_percent double, shards long, smallest_shard long, largest_shard long"
)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The conversion report of a store."""
    return spark.read.schema(REPORT).json(f"{path}/conversion")


@dataclass(frozen=True)
class ShardStore:
    """One split of a store, known by its table of shards alone."""

    path: str
    split: str
    features: list[str]
    shape: list[int]
    total: int
    table: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    def folders(self, low: int, high: int) -> list[str]:
        """The folders that hold places low to high - 1."""
        here = self.table.filter((F.col("first") < high) & (F.col("first") + F.col("rows") > low)).select("shard").orderBy("shard")
        return [f"{self.path}/rows/split={self.split}/shard={r.shard}" for r in here.collect()]

    def read(self, position: int, n: int) -> DataFrame:
        """n rows of the endless stream from position on, with ``at``, their place in it; it goes on at the start again and again."""
        if n < 1:
            return self.read(position, 1).limit(0)
        low = position % self.total
        if low + n <= self.total:
            spans = [(low, low + n)]
        elif n < self.total:
            spans = [(low, self.total), (0, low + n - self.total)]
        else:
            spans = [(0, self.total)]
        folders = sorted({f for span in spans for f in self.folders(*span)})
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*folders)
        wanted = F.lit(False)
        for a, b in spans:
            wanted = wanted | F.col("pos").between(a, b - 1)
        first = F.pmod(F.col("pos") - low, F.lit(self.total))
        laps = F.sequence(first + position, F.lit(position + n - 1).cast("long"), F.lit(self.total).cast("long"))
        return rows.filter(wanted).withColumn("at", F.explode(laps))

    def first(self, n: int) -> DataFrame:
        """The first n places, fewer if there are fewer: a set that is the same at every reading."""
        return self.read(0, min(n, self.total))


def open_shards(spark: SparkSession, path: str, split: str) -> ShardStore:
    """A split of a store, after a check of its table: there are shards, they agree on what they hold, and their places have no gap."""
    table = spark.read.schema(SHARDS).json(f"{path}/shards").filter(F.col("split") == split)
    found = table.agg(
        F.count("*").alias("shards"), F.collect_set(F.struct("features", "shape")).alias("kinds"), F.sum("rows").alias("total"), F.max(F.col("first") + F.col("rows")).alias("end"), F.min("first").alias("begin")
    ).first()  # one kind, or an error
    if not found.shards:
        raise ValueError(f"{path}: no shards of {split}")
    if len(found.kinds) != 1:
        raise ValueError(f"{path}: features or shape differ")
    if found.begin != 0 or found.end != found.total:
        raise ValueError(f"{path}: the places of {split} have gaps")
    (kind,) = found.kinds
    return ShardStore(path, split, kind.features.split(","), list(kind["shape"]), found.total, table)
