"""Pair tallies and a Bradley-Terry rating fit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.session import cut


def pair_tally(games: DataFrame, winner: str, loser: str) -> DataFrame:
    """winner, loser, wins."""
    return games.groupBy(F.col(winner).alias("winner"), F.col(loser).alias("loser")).agg(F.count("*").alias("wins"))


def fit_ratings(pairs: list[tuple[str, str, float]], prior: float = 0.5, rounds: int = 10_000, tolerance: float = 1e-12) -> dict[str, float]:
    """Rating points above the weakest from (winner, loser, wins): minorisation steps with a virtual half game each way."""
    won: dict[tuple[str, str], float] = {}
    for a, b, n in pairs:
        won[a, b] = won.get((a, b), 0.0) + n
    met = {tuple(sorted(pair)) for pair in won if pair[0] != pair[1]}
    score: dict[str, float] = {}
    games = {}
    for a, b in met:
        ab, ba = won.get((a, b), 0.0) + prior, won.get((b, a), 0.0) + prior
        score[a], score[b] = score.get(a, 0.0) + ab, score.get(b, 0.0) + ba
        games[a, b] = ab + ba
    strength = dict.fromkeys(score, 1.0)
    for _ in range(rounds):
        load = dict.fromkeys(score, 0.0)
        for (a, b), n in games.items():
            part = n / (strength[a] + strength[b])
            load[a] += part
            load[b] += part
        fresh = {m: score[m] / load[m] for m in score}
        middle = math.exp(sum(map(math.log, fresh.values())) / len(fresh)) if fresh else 1.0
        fresh = {m: x / middle for m, x in fresh.items()}
        moved = max((abs(fresh[m] / strength[m] - 1) for m in fresh), default=0.0)
        strength = fresh
        if moved < tolerance:
            break
    points = {m: 400 * math.log10(x) for m, x in strength.items()}
    weakest = min(points.values(), default=0.0)
    return {m: x - weakest for m, x in points.items()}


def ratings(spark: SparkSession, tally: DataFrame, most_pairs: int = 1_000_000) -> DataFrame:
    """model, rating from pair tallies of one row for each ordered pair; pairs with a null model are left out.

    The fit of up to `most_pairs` rows is a bounded model and runs on the driver; a larger one runs in Spark.
    """
    named = tally.select("winner", "loser", F.col("wins").cast("double")).dropna(subset=["winner", "loser"])
    pairs = named.limit(most_pairs + 1).collect()
    if len(pairs) > most_pairs:
        return ratings_of_many(named)
    rows = sorted(fit_ratings([tuple(p) for p in pairs]).items())
    return spark.createDataFrame(rows, "model string, rating double")


def ratings_of_many(tally: DataFrame, prior: float = 0.5, rounds: int = 1_000, tolerance: float = 1e-6, rounds_a_cut: int = 4) -> DataFrame:
    """model, rating as `fit_ratings` has them, each step a join and a sum over the pairs.

    Steps do not change when all strengths are scaled, so they are scaled once, at the end. Every few steps the
    strengths, one row a model, are cut off in the shared checkpoint folder; only the largest change comes to the driver.
    """
    one_way = tally.filter("winner <> loser").select(F.col("winner").alias("model"), F.col("loser").alias("other"), "wins", F.lit(0.0).alias("lost"))
    other_way = one_way.select(F.col("other").alias("model"), F.col("model").alias("other"), F.lit(0.0).alias("wins"), F.col("wins").alias("lost"))
    sides = one_way.union(other_way).groupBy("model", "other").agg((F.sum("wins") + prior).alias("won"), (F.sum("wins") + F.sum("lost") + 2 * prior).alias("games"))
    sides = cut(sides)
    strength = cut(sides.groupBy("model").agg(F.sum("won").alias("won")).withColumn("strength", F.lit(1.0)))
    games = sides.drop("won")
    for _ in range(0, rounds, rounds_a_cut):
        for _ in range(rounds_a_cut):
            theirs = strength.select(F.col("model").alias("other"), F.col("strength").alias("theirs"))
            part = F.col("games") / (F.col("strength") + F.col("theirs"))
            load = games.join(theirs, "other").join(strength, "model").groupBy("model", "won", "strength").agg(F.sum(part).alias("load"))
            strength = load.select("model", "won", (F.col("won") / F.col("load")).alias("strength"), F.col("strength").alias("former"))
        strength = cut(strength)
        moved = strength.agg(F.max(F.abs(F.col("strength") / F.col("former") - 1))).first()[0]
        strength = strength.drop("former")
        if moved is None or moved < tolerance:
            break
    points = strength.select("model", (400 * F.log10("strength")).alias("points"))
    weakest = points.agg(F.min("points").alias("weakest"))
    return points.join(F.broadcast(weakest)).select("model", (F.col("points") - F.col("weakest")).alias("rating"))
