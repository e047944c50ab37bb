"""Games derived from the driver tables: replays, agreement of sampled moves, and reports of lost points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.functions.games import contested, drawn, normalised, with_drops
from kifu_spark.operators.ranking import seeded_key
from kifu_spark.operators.replay import replay
from kifu_spark.registry import query
from kifu_spark.sources.tables import table

SIZE = 5


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in time as a game: sides alternate, and the order number picks the point or a pass."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("game"), n.alias("move_no"), F.when(n % 2 == 1, "B").otherwise("W").alias("color"), (F.col("o_orderkey") % (SIZE * SIZE + 1) - 1).cast("int").alias("place")
    )


@query()
def replay_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every move replayed on a small board: captures, liberties, the point of a ko, and where a game turns illegal."""
    return replay(_moves(spark, sf_dir), SIZE)


@query()
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and replayed moves, passes, captures, and the reasons games are cut."""
    moves = _moves(spark, sf_dir)
    done = replay(moves, SIZE).groupBy("game").agg(
        F.count_if(F.col("problem").isNull()).alias("replayed"), F.sum("captured").alias("captured"), F.max("problem").alias("problem"), F.count_if(F.col("place") < 0).alias("passes")
    )
    declared = moves.groupBy("game").agg(F.count("*").alias("declared"))
    return declared.join(done, "game").groupBy(F.coalesce("problem", F.lit("complete")).alias("ending")).agg(
        F.count("*").alias("games"), F.sum("declared").alias("declared"), F.sum("replayed").alias("replayed"), F.sum("captured").alias("captured"), F.sum("passes").alias("passes")
    )


@query(
    """WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice - lead(o_totalprice, 1) OVER w AS lost, lead(o_totalprice, 2) OVER w - lead(o_totalprice, 1) OVER w AS back FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, o_orderkey, round(lost, 2) AS lost, CASE WHEN back >= 0.7 * lost THEN 'fight' ELSE 'blunder' END AS label FROM l WHERE lost >= 300000"""
)
def labelled_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large falls, told apart by whether most of the loss comes back at once."""
    rows = with_drops(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 300000)
    return rows.filter("label is not null").select("o_custkey", "o_orderkey", F.round("lost", 2).alias("lost"), "label")


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS p FROM embeddings), s AS (SELECT vec_id, p[1] / (p[1] + p[3] + p[5] + p[7]) AS a, p[3] / (p[1] + p[3] + p[5] + p[7]) AS b, p[5] / (p[1] + p[3] + p[5] + p[7]) AS c,
      ('0x' || substr(md5('3|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM e)
    SELECT vec_id, CASE WHEN u < a THEN 0 WHEN u - a < b THEN 1 WHEN u - a - b < c THEN 2 ELSE 3 END AS pick, round(u, 6) AS u FROM s"""
)
def sampled_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded draw from a distribution over allowed candidates."""
    u = F.conv(F.substring(seeded_key(3, F.col("vec_id")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    weights = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    allowed = F.array(*[F.lit(i) for i in (0, 2, 4, 6)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", normalised(weights, allowed).alias("p"), u.alias("u"))
    return rows.select("vec_id", drawn(F.col("p"), F.col("u")).alias("pick"), F.round("u", 6).alias("u"))


@query("SELECT label, count(*) AS n, sum(len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.3 AND abs(x::DOUBLE) < 0.9)))::BIGINT AS contested FROM embeddings GROUP BY ALL")
def contested_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", contested(F.col("embedding").cast("array<double>")).alias("c"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("c").alias("contested"))
