"""Percentiles by their several definitions, latencies, tables of wins and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kifu_spark.operators import ranking
from kifu_spark.operators.ordered import in_order
from kifu_spark.operators.ratings import pair_tally, ratings
from kifu_spark.registry import query
from kifu_spark.sources.tables import table


@query(
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
    round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY ALL"""
)
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles, exact, by ranks inside slices of a group's range."""
    named = {f"p{round(100 * q)}": q for q in (0.1, 0.5, 0.9)}
    found = ranking.linear_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", named)
    return found.select("l_returnflag", "l_linestatus", *[F.round(name, 6).alias(name) for name in named])


@query(
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY ALL)
    SELECT event_type, v[floor(0.9 * (len(v) - 1))::BIGINT + 1] AS p90_lower, v[round_even(0.9 * (len(v) - 1), 0)::BIGINT + 1] AS p90_rounded, v[len(v) // 2 + 1] AS median_upper FROM s"""
)
def percentile_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles that are always one of the values: lower index, rounded index, upper median."""
    counts = ranking.value_counts(table(spark, sf_dir, "events"), ["event_type"], "value", near=[0.5, 0.9])
    return counts.groupBy("event_type").agg(
        ranking.lower_index("value", 0.9).alias("p90_lower"), ranking.rounded_index("value", 0.9).alias("p90_rounded"), ranking.upper_median("value").alias("median_upper")
    )


@query(
    """WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY ALL),
    p AS (SELECT o_orderpriority, v, unnest([1, 2, 3]) AS i FROM s),
    q AS (SELECT *, (len(v) + 1) * i // 4 AS whole, (len(v) + 1) * i % 4 AS rest FROM p)
    SELECT o_orderpriority, i AS quartile, round(v[least(greatest(whole, 1), len(v))] + (v[least(greatest(whole + 1, 1), len(v))] - v[least(greatest(whole, 1), len(v))]) * (rest / 4.0), 6) AS value FROM q"""
)
def quartile_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ranking.value_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", near=[0.25, 0.5, 0.75])
    wide = counts.groupBy("o_orderpriority").agg(*[F.round(ranking.exclusive_quartile("o_totalprice", i), 6).alias(str(i)) for i in (1, 2, 3)])
    return wide.unpivot(["o_orderpriority"], ["1", "2", "3"], "quartile", "value").withColumn("quartile", F.col("quartile").cast("int"))


GAPS_SQL = "SELECT event_type, row_number() OVER w AS nth, date_diff('microsecond', lag(ts) OVER w, ts) / 1000.0 AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds since the user's event before, and the event's place."""
    w = in_order(["user_id"], ["ts", "event_id"])
    ms = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / 1000.0
    return table(spark, sf_dir, "events").select("event_type", F.row_number().over(w).alias("nth"), ms.alias("ms"))


@query(
    f"""WITH g AS ({GAPS_SQL}), s AS (SELECT event_type, list_sort(list(ms)) AS v FROM g WHERE ms IS NOT NULL GROUP BY ALL)
    SELECT event_type, len(v) AS n, round(list_median(v), 3) AS median, v[floor(0.9 * (len(v) - 1))::BIGINT + 1] AS p90, v[-1] AS longest FROM s"""
)
def latency_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, median, lower-index p90 and maximum of the time since the user's event before."""
    gaps = _gaps(spark, sf_dir)
    by_kind = ranking.value_counts(gaps, ["event_type"], "ms", near=[0.5, 0.9]).groupBy("event_type")
    ranked = by_kind.agg(F.round(ranking.linear_index("ms", 0.5), 3).alias("median"), ranking.lower_index("ms", 0.9).alias("p90"))
    rest = gaps.groupBy("event_type").agg(F.count("ms").alias("n"), F.max("ms").alias("longest"))
    return rest.join(ranked, "event_type").select("event_type", "n", "median", "p90", "longest")


@query(f"WITH g AS ({GAPS_SQL}) SELECT ((nth - 1) // 20)::INTEGER AS stage, count(ms) AS n, round(avg(ms), 3) AS mean_ms FROM g GROUP BY ALL")
def latency_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).groupBy(F.floor((F.col("nth") - 1) / 20).cast("int").alias("stage")).agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"))


@query(
    """SELECT c_mktsegment, count(*) FILTER (o_totalprice >= 250000) AS won, count(*) FILTER (o_totalprice < 250000) AS lost,
    format('{}-{} ({}%)', count(*) FILTER (o_totalprice >= 250000), count(*) FILTER (o_totalprice < 250000), round_even(100.0 * count(*) FILTER (o_totalprice >= 250000) / count(*), 0)::BIGINT) AS record
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""
)
def winloss_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins (large orders), losses and a readable record by a key."""
    games = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    won = F.col("o_totalprice") >= 250000
    counts = games.groupBy("c_mktsegment").agg(F.count_if(won).alias("won"), F.count_if(~won).alias("lost"))
    percent = F.bround(F.lit(100.0) * F.col("won") / (F.col("won") + F.col("lost")), 0).cast("long")
    return counts.withColumn("record", F.concat("won", F.lit("-"), "lost", F.lit(" ("), percent, F.lit("%)")))


@query(
    """SELECT n_name, count(*) FILTER (o_totalprice >= 250000) AS won, count(*) AS played, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) FILTER (o_totalprice >= 250000) >= 3"""
)
def opponents_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with distinct attributes, for those with three wins or more."""
    games = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    )  # nations are a fixed table of 25
    counts = games.groupBy("n_name").agg(
        F.count_if(F.col("o_totalprice") >= 250000).alias("won"), F.count("*").alias("played"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments")
    )
    return counts.filter("won >= 3").withColumn("segments", F.array_join("segments", ","))


@query(
    """WITH l AS (SELECT l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R')
    SELECT l_linenumber, count(*) AS n, round(median(l_quantity), 6) AS median_quantity, round(avg(l_discount), 6) AS mean_discount FROM l GROUP BY ALL"""
)
def losses_by_handicap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and means over the lost rows, by a small key."""
    lost = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    medians = ranking.linear_percentiles(lost, ["l_linenumber"], "l_quantity", {"middle": 0.5})
    means = lost.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))
    return means.join(medians, "l_linenumber").select("l_linenumber", "n", F.round("middle", 6).alias("median_quantity"), "mean_discount")


PAIRS_SQL = """SELECT w.n_name AS winner, l.n_name AS loser FROM lineitem
  JOIN supplier s ON s_suppkey = l_suppkey JOIN nation w ON w.n_nationkey = s.s_nationkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation l ON l.n_nationkey = c_nationkey
  WHERE w.n_regionkey = 0 AND l.n_regionkey = 0 AND w.n_name <> l.n_name"""


def _pairs(spark: SparkSession, sf_dir: str, region: int | None = None) -> DataFrame:
    """A game for each line item: the supplier's nation wins against the customer's, both of one region if it is given."""
    nation = table(spark, sf_dir, "nation")
    if region is not None:
        nation = nation.filter(F.col("n_regionkey") == region)
    winner = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("winner"))
    loser = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("loser"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(winner), "s_nationkey").select("s_suppkey", "winner")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(loser), "c_nationkey").select("c_custkey", "loser")
    bought = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "loser")
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "winner")
    return lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).filter("winner != loser").select("winner", "loser")


@query(f"SELECT winner, loser, count(*) AS wins FROM ({PAIRS_SQL}) GROUP BY ALL")
def pair_tally_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins between the nations of region 0, the games of the SQL."""
    return pair_tally(_pairs(spark, sf_dir, region=0), "winner", "loser")


@query(
    f"""WITH t AS ({PAIRS_SQL}), n AS (SELECT DISTINCT winner AS model FROM t UNION SELECT DISTINCT loser FROM t),
    s AS (SELECT model, count(*) FILTER (winner = model) AS won, count(*) FILTER (loser = model) AS lost FROM n, t GROUP BY ALL)
    SELECT model, won, lost, round(100.0 * won / (won + lost), 6) AS percent FROM s"""
)
def crosstab_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row totals of the pair table of region 0 with percent won."""
    tally = pair_tally(_pairs(spark, sf_dir, region=0), "winner", "loser")
    sides = tally.select(F.col("winner").alias("model"), F.col("wins").alias("won"), F.lit(0).alias("lost")).union(
        tally.select(F.col("loser").alias("model"), F.lit(0).alias("won"), F.col("wins").alias("lost"))
    )
    totals = sides.groupBy("model").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    return totals.withColumn("percent", F.round(F.lit(100.0) * F.col("won") / (F.col("won") + F.col("lost")), 6))


@query(
    """SELECT n_name, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R"
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL"""
)
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one key by another, as columns."""
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("n_name").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0)


@query()
def ratings_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry ratings from the pair tally of all nations."""
    return ratings(spark, pair_tally(_pairs(spark, sf_dir), "winner", "loser"))


@query(
    """SELECT coalesce(event_type, 'all') AS kind, count(*) AS n, round(avg((value < 50)::INT), 6) AS right_share, list_sort(list(value))[count(*) // 2 + 1] AS upper_median
    FROM events GROUP BY ROLLUP (event_type)"""
)
def kind_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and upper median by kind and over all."""
    kinds = table(spark, sf_dir, "events").select(F.explode(F.array("event_type", F.lit("all"))).alias("kind"), "value")
    medians = ranking.value_counts(kinds, ["kind"], "value", near=[0.5]).groupBy("kind").agg(ranking.upper_median("value").alias("upper_median"))
    shares = kinds.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") < 50).cast("int")), 6).alias("right_share"))
    return shares.join(medians, "kind")


@query(
    """WITH o AS (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
    SELECT user_id, count(*) AS n, round(avg(greatest(value - after, 0)), 6) AS mean_lost, round(median(greatest(value - after, 0)), 6) AS median_lost, count(*) FILTER (value - after >= 5) AS big
    FROM o WHERE after IS NOT NULL GROUP BY ALL"""
)
def points_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses to the next value, gains counted as none: mean, median and the number of large ones."""
    w = in_order(["user_id"], ["ts", "event_id"])
    lost = table(spark, sf_dir, "events").select("user_id", (F.col("value") - F.lead("value").over(w)).alias("lost")).filter("lost is not null")
    clipped = F.greatest(F.col("lost"), F.lit(0.0))
    lost = lost.withColumn("clipped", clipped)
    sums = lost.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("clipped"), 6).alias("mean_lost"), F.count_if(F.col("lost") >= 5).alias("big"))
    found = ranking.with_percentiles(sums, lost, ["user_id"], "clipped", {"middle": 0.5})
    return found.select("user_id", "n", "mean_lost", F.round("middle", 6).alias("median_lost"), "big")


@query(
    """SELECT s_nationkey, p_size, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS endings
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size <= 5 GROUP BY ALL"""
)
def record_by_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").filter("p_size <= 5"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return lines.groupBy("s_nationkey", "p_size").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("endings")
    )


@query("SELECT user_id, bit_xor(hash64) AS h, count(*) AS n FROM (SELECT user_id, ('0x' || substr(md5(event_type || '|' || event_id), 1, 15))::BIGINT AS hash64 FROM events) GROUP BY ALL")
def xor_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free hash of a group's rows."""
    hashed = F.conv(F.substring(F.md5(F.concat("event_type", F.lit("|"), "event_id")), 1, 15), 16, 10).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bit_xor(hashed).alias("h"), F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, round(-sum(p * ln(greatest(p, 1e-12))), 6) AS entropy FROM s GROUP BY ALL"""
)
def entropy_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    p = F.greatest(F.col("p"), F.lit(1e-12))
    return counts.select("user_id", share.alias("p")).groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.ln(p)), 6).alias("entropy"))
