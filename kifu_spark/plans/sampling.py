"""Seeded pools, splits, the global shuffle and what is read from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kifu_spark.operators.ranking import SLICE_DIGITS, rank_before, running_before, seeded_key
from kifu_spark.registry import query
from kifu_spark.session import checkpoint_dir
from kifu_spark.sources.shards import open_shards, write_shards
from kifu_spark.sources.tables import table

SEED = 20260922
POOL_SQL = "pool AS (SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 400000 AND o_orderpriority <> '4-NOT SPECIFIED')"
KEYED_SQL = f"keyed AS (SELECT *, md5('{SEED}|' || o_orderkey) AS key FROM pool)"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a closed price range, of a stated priority."""
    orders = table(spark, sf_dir, "orders")
    return orders.filter(F.col("o_totalprice").between(1000, 400000) & (F.col("o_orderpriority") != "4-NOT SPECIFIED"))


@query(f"WITH {POOL_SQL} SELECT o_orderkey, o_orderpriority FROM pool")
def pool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("o_orderkey", "o_orderpriority")


@query(
    f"""WITH {POOL_SQL}, {KEYED_SQL}, r AS (SELECT o_orderkey, o_custkey % 300 AS moves, coalesce(sum(o_custkey % 300) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM keyed)
    SELECT o_orderkey, moves, before FROM r WHERE before < 100000"""
)
def target_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in seeded order until their sum reaches the target; the one that crosses it is taken."""
    keyed = _pool(spark, sf_dir).select("o_orderkey", (F.col("o_custkey") % 300).alias("moves"), seeded_key(SEED, F.col("o_orderkey")).alias("key"))
    return running_before(keyed, "key", F.col("moves"), "before", ties=["o_orderkey"]).filter("before < 100000").select("o_orderkey", "moves", "before")


SPLIT_SQL = f"""WITH {POOL_SQL}, {KEYED_SQL}, r AS (SELECT o_orderkey, o_orderpriority, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY key) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM keyed),
    s AS (SELECT *, CASE WHEN place < round_even(n * 0.93, 0) THEN 'train' WHEN place < round_even(n * 0.93, 0) + round_even(n * 0.05, 0) THEN 'val' ELSE 'test' END AS split FROM r)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validation and test by rank in seeded order, in each stratum; bounds round half to even."""
    pool = _pool(spark, sf_dir).withColumn("key", seeded_key(SEED, F.col("o_orderkey")))
    placed = rank_before(pool, "key", "place", ["o_orderpriority"], ["o_orderkey"])
    sizes = pool.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    part = lambda share: F.bround(F.col("n") * F.lit(share), 0)
    split = F.when(F.col("place") < part(0.93), "train").when(F.col("place") < part(0.93) + part(0.05), "val").otherwise("test")
    return placed.join(F.broadcast(sizes), "o_orderpriority").withColumn("split", split)


@query(f"{SPLIT_SQL} SELECT o_orderkey, o_orderpriority, split FROM s")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("o_orderkey", "o_orderpriority", "split")


@query(
    f"""{SPLIT_SQL} SELECT split, count(*) AS games, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, round(0.97 * sum(o_custkey % 300), 2) AS est_positions FROM s GROUP BY split"""
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the splits and the positions to expect from them."""
    return _split(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("games"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.round(F.lit(0.97) * F.sum(F.col("o_custkey") % 300), 2).alias("est_positions"),
    )


ROW_TEXT = "concat_ws('|', 7, l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_quantity * 100)::BIGINT, (l_extendedprice * 100)::BIGINT, epoch_ms(l_shipdate) // 86400000)"
SHUFFLED_SQL = f"""WITH k AS (SELECT *, md5({ROW_TEXT}) AS key FROM lineitem), sh AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS pos FROM k)"""
SHARD_ROWS = 4096


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the key of their random order, of the seed and the whole row."""
    lines = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100, 0).cast("long")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    key = seeded_key(7, *map(F.col, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]), cents("l_quantity"), cents("l_extendedprice"), day)
    return lines.withColumn("key", key)


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in one global random order: the key and the place it gives."""
    return rank_before(_keyed(spark, sf_dir), "key", "pos")


@query(f"{SHUFFLED_SQL} SELECT key, pos, l_orderkey, l_linenumber FROM sh")
def global_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shuffled(spark, sf_dir).select("key", "pos", "l_orderkey", "l_linenumber")


@query(
    f"""{SHUFFLED_SQL} SELECT (pos // {SHARD_ROWS})::INTEGER AS shard, count(*) AS n, count(DISTINCT l_orderkey) AS games, min(key) AS first_key, max(key) AS last_key FROM sh GROUP BY ALL"""
)
def shard_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of equal row counts along the shuffle, with the keys they span."""
    shard = F.floor(F.col("pos") / SHARD_ROWS).cast("int")
    return _shuffled(spark, sf_dir).groupBy(shard.alias("shard")).agg(
        F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("games"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )


@query(f"{SHUFFLED_SQL}, a AS (SELECT l_orderkey = lag(l_orderkey) OVER (ORDER BY pos) AS same FROM sh) SELECT count(*) AS pairs, count(*) FILTER (same) AS adjacent FROM a WHERE same IS NOT NULL")
def adjacency_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often neighbours in the shuffle come from one order: inside slices of the key, and at the slices' edges."""
    rows = _keyed(spark, sf_dir).select(F.substring("key", 1, SLICE_DIGITS).alias("slice"), "key", "l_orderkey")
    inside = Window.partitionBy("slice").orderBy("key")
    within = rows.withColumn("before", F.lag("l_orderkey").over(inside)).filter("before is not null")
    edges = rows.groupBy("slice").agg(F.min_by("l_orderkey", "key").alias("l_orderkey"), F.max_by("l_orderkey", "key").alias("last"))
    across = edges.withColumn("before", F.lag("last").over(Window.orderBy("slice"))).filter("before is not null")  # 4096 rows at most
    pairs = within.select("l_orderkey", "before").unionByName(across.select("l_orderkey", "before"))
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("l_orderkey") == F.col("before")).alias("adjacent"))


@query(f"{SHUFFLED_SQL}, n AS (SELECT count(*) AS n FROM sh) SELECT (pos - (n - 10)) % n + CASE WHEN pos < n - 10 THEN n ELSE 0 END AS at, l_orderkey, l_linenumber FROM sh, n WHERE (pos - (n - 10) + n) % n < 20")
def stream_slice_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows of the endless stream from ten before its end: it goes on at the start."""
    rows = _keyed(spark, sf_dir).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    upto = F.sum("here").over(Window.orderBy("slice"))  # one row for each slice, 4096 at most
    totals = rows.groupBy("slice").agg(F.count("*").alias("here")).withColumn("first", upto - F.col("here"))
    n = table(spark, sf_dir, "lineitem").count()
    ends = totals.filter((F.col("first") < 10) | (F.col("first") + F.col("here") > n - 10))  # only these slices are ranked
    nth = F.row_number().over(Window.partitionBy("slice").orderBy("key"))
    at = F.pmod(F.col("first") + nth - 1 - (n - 10), F.lit(n))
    return rows.join(F.broadcast(ends), "slice").withColumn("at", at).filter("at < 20").select("at", "l_orderkey", "l_linenumber")


@query(
    f"""{SHUFFLED_SQL} SELECT (pos // 64)::INTEGER AS batch, count(*) AS n, sum(l_linenumber)::BIGINT AS labels,
    min(('0x' || substr(md5('5|' || pos), 1, 8))::BIGINT % 8) AS first_view FROM sh GROUP BY ALL"""
)
def batch_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as a pure function of the place, each row with a seeded choice of one of eight views."""
    view = F.conv(F.substring(seeded_key(5, F.col("pos")), 1, 8), 16, 10).cast("long") % 8
    rows = _shuffled(spark, sf_dir).withColumn("view", view)
    return rows.groupBy(F.floor(F.col("pos") / 64).cast("int").alias("batch")).agg(
        F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("labels"), F.min("view").alias("first_view")
    )


@query(
    "SELECT o_orderpriority, o_orderstatus, count(*) AS positions, count(DISTINCT o_orderkey) AS games FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"
)
def lineage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions traced back to their games."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    games = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    joined = games.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("n").alias("positions"), F.count("*").alias("games"))


@query(f"{SPLIT_SQL} SELECT a.split, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM s b WHERE b.o_orderkey = a.o_orderkey AND b.split <> a.split)) AS shared FROM s a GROUP BY ALL")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split that another one holds too: none."""
    split = _split(spark, sf_dir).select("o_orderkey", "split")
    several = split.groupBy("o_orderkey").agg(F.count_distinct("split").alias("kinds"))
    return split.join(several, "o_orderkey").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("kinds") > 1).alias("shared"))


def _stored_shards(spark: SparkSession, sf_dir: str) -> str:
    """Line items written as shards by position, in a folder of their own."""
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = _keyed(spark, sf_dir).select(F.lit("all").alias("split"), "key", "l_orderkey", "l_linenumber")
    write_shards(rows, path, "key", ["orderkey", "linenumber"], [2], 7, SHARD_ROWS)
    return path


@query(f"{SHUFFLED_SQL}, n AS (SELECT count(*) AS n FROM sh) SELECT CASE WHEN pos < n - 10 THEN pos + n ELSE pos END AS at, pos, l_orderkey, l_linenumber FROM sh, n WHERE (pos - (n - 10) + n) % n < 20")
def shard_store_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty places around the end of the stream, read from stored shards: only the first and the last shard are opened."""
    store = open_shards(spark, _stored_shards(spark, sf_dir), "all")
    return store.read(store.total - 10, 20).select("at", "pos", "l_orderkey", "l_linenumber")


@query(
    f"""{SHUFFLED_SQL}, c AS (SELECT greatest(1, ceil(count(*) / {SHARD_ROWS}))::BIGINT AS shards FROM sh)
    SELECT (('0x' || key[1:8])::BIGINT * shards // 4294967296)::INTEGER AS shard, min(pos) AS first, count(*) AS rows, sum(l_linenumber)::BIGINT AS labels FROM sh, c GROUP BY ALL"""
)
def shard_store_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the stored shards, with what each shard's own rows say beside it."""
    path = _stored_shards(spark, sf_dir)
    told = open_shards(spark, path, "all").table.select("shard", "first", "rows")
    rows = spark.read.parquet(f"{path}/rows").groupBy("shard").agg(F.min("pos").alias("first"), F.count("*").alias("rows"), F.sum("l_linenumber").cast("long").alias("labels"))
    return told.join(rows, ["shard", "first", "rows"])


@query(
    f"""{SHUFFLED_SQL} SELECT pos, l_orderkey, l_linenumber, ('0x' || substr(md5('5|' || pos), 1, 8))::BIGINT % 8 AS view FROM sh WHERE pos < 512"""
)
def validation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 512 places, each with its seeded view: a validation set that is the same at every reading."""
    store = open_shards(spark, _stored_shards(spark, sf_dir), "all")
    view = F.conv(F.substring(seeded_key(5, F.col("pos")), 1, 8), 16, 10).cast("long") % 8
    return store.first(512).select("pos", "l_orderkey", "l_linenumber", view.alias("view"))
