"""Reports on a corpus: records written from orders and their lines, scanned again as text, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.functions.records import manifest
from kifu_spark.operators.corpus_report import account_games, manifest_report, opponent_report, sample_positions, with_shares
from kifu_spark.operators.ordered import plateau
from kifu_spark.registry import query
from kifu_spark.sources.tables import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: an order as a record and its lines as moves, some annotated; customers of even number play Kifu as White."""
    one = lambda value: F.coalesce(value, F.lit(""))
    visits = F.concat(F.lit("v="), (F.col("l_quantity") * 100).cast("int"))
    rv = F.when(F.col("l_tax") == 0, " rv=900")
    weight = F.when(F.col("l_returnflag") != "A", F.concat(F.lit(" weight="), F.round(F.col("l_discount") * 100) / 5))
    note = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("C[0.40 0.60 0.00 -1.5 "), visits, one(rv), one(weight), F.lit("]")))
    color = F.when(F.col("l_linenumber") % 2 == 1, "B").otherwise("W")
    point = F.when(F.col("l_returnflag") == "R", "tt").otherwise("dd")
    node = F.concat(F.lit(";"), color, F.lit("["), point, F.lit("]"), one(note))
    nodes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", node.alias("node"))))["node"], "").alias("nodes")
    )
    orders = table(spark, sf_dir, "orders")
    priority, status, key, customer = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")
    even = customer % 2 == 0
    name, rank = F.concat(F.lit("c"), customer % 40), F.concat(customer % 9, F.lit("d"))
    players = F.when(even, F.concat(F.lit("PB["), name, F.lit("]BR["), rank, F.lit("]PW[Kifu"), customer % 3, F.lit("]"))).otherwise(
        F.concat(F.lit("PB[Kifu"), customer % 3, F.lit("]PW["), name, F.lit("]WR["), rank, F.lit("]"))
    )
    points = F.floor(F.col("o_totalprice") / 10000).cast("int")
    tail = F.when(key % 5 == 0, F.lit("R")).when(key % 5 == 1, F.lit("Time")).when(key % 5 == 2, F.lit("")).otherwise(F.concat(points, F.lit(".5")))
    result = F.when(key % 11 == 0, "0").otherwise(F.concat(F.when(key % 2 == 0, "B+").otherwise("W+"), tail))
    rules = F.when(priority == "3-MEDIUM", "Japanese").otherwise(
        F.concat(
            F.lit("ko"), F.when(priority == "1-URGENT", "SIMPLE").otherwise("POSITIONAL"), F.lit("scoreAREAtaxNONEsui"), F.when(status == "F", "1").otherwise("0"),
            F.when(priority == "2-HIGH", "button").otherwise(""),
        )
    )
    text = F.concat(
        F.lit("(;GM[1]SZ["), F.when(priority == "5-LOW", "9").otherwise("19"), F.lit("]"), players, F.lit("KM["), F.month("o_orderdate"), F.lit(".5]"),
        one(F.when(customer % 4 > 0, F.concat(F.lit("HA["), customer % 4, F.lit("]")))), F.lit("RE["), result, F.lit("]RU["), rules, F.lit("]"),
        F.when(priority == "1-URGENT", "AB[aa][bb]").when(priority == "2-HIGH", "AW[cc]").otherwise(""), F.lit("C[startTurnIdx="), key % 3, F.lit(",gtype="),
        F.when(status == "O", "normal").when(status == "F", "handicap").otherwise("asym"), F.lit("]"), one("nodes"), F.when(status == "P", ";N[end]").otherwise(""), F.lit(")"),
    )
    return orders.join(nodes.hint("merge"), "o_orderkey", "left").select(key.cast("string").alias("path"), text.alias("text"))


REPORT_SQL = """WITH l AS (SELECT l_orderkey AS o_orderkey, l_returnflag = 'R' AS pass, l_linestatus = 'O' AS noted, l_linestatus = 'O' AND l_returnflag <> 'A' AS weighted,
      l_linestatus = 'O' AND l_tax = 0 AS again, (l_quantity * 100)::INT AS visits, round(l_discount * 100) / 5 AS weight FROM lineitem),
    s AS (SELECT o_orderkey, count(*) AS moves, count(*) FILTER (pass) AS passes, count(*) FILTER (noted) AS annotated, count(*) FILTER (weighted) AS weighted,
      count(*) FILTER (again) AS reanalyzed, count(*) FILTER (weighted AND weight = 0) AS weight_zero FROM l GROUP BY ALL),
    o AS (SELECT o.*, o_orderpriority <> '5-LOW' AS ok, left(o_orderpriority, 1)::INT AS p, o_orderstatus AS t FROM orders o),
    r AS (SELECT o.*, CASE WHEN ok THEN coalesce(moves, 0) ELSE 0 END AS moves, CASE WHEN ok THEN coalesce(passes, 0) ELSE 0 END AS passes,
      CASE WHEN ok THEN coalesce(annotated, 0) ELSE 0 END AS annotated, CASE WHEN ok THEN coalesce(weighted, 0) ELSE 0 END AS weighted,
      CASE WHEN ok THEN coalesce(reanalyzed, 0) ELSE 0 END AS reanalyzed, CASE WHEN ok THEN coalesce(weight_zero, 0) ELSE 0 END AS weight_zero,
      CASE WHEN ok AND p = 1 THEN 2 ELSE 0 END AS ab, CASE WHEN ok AND p = 2 THEN 1 ELSE 0 END AS aw FROM o LEFT JOIN s USING (o_orderkey)),
    h AS (SELECT 'size' AS counter, CASE WHEN ok THEN '19' ELSE '9' END AS value, 1 AS n FROM r
      UNION ALL SELECT 'gtype', CASE WHEN ok THEN CASE t WHEN 'O' THEN 'normal' WHEN 'F' THEN 'handicap' ELSE 'asym' END END, 1 FROM r
      UNION ALL SELECT 'komi', CASE WHEN ok THEN month(o_orderdate) || '.5' END, 1 FROM r
      UNION ALL SELECT 'ko', CASE WHEN ok AND p <> 3 THEN CASE p WHEN 1 THEN 'SIMPLE' ELSE 'POSITIONAL' END END, 1 FROM r
      UNION ALL SELECT 'score', CASE WHEN ok AND p <> 3 THEN 'AREA' END, 1 FROM r UNION ALL SELECT 'tax', CASE WHEN ok AND p <> 3 THEN 'NONE' END, 1 FROM r
      UNION ALL SELECT 'sui', CASE WHEN ok AND p <> 3 THEN CASE t WHEN 'F' THEN '1' ELSE '0' END END, 1 FROM r
      UNION ALL SELECT 'rules_extra', CASE WHEN ok AND p = 2 THEN 'button' END, 1 FROM r
      UNION ALL SELECT 'handicap', CASE WHEN ok AND o_custkey % 4 > 0 THEN (o_custkey % 4)::VARCHAR END, 1 FROM r
      UNION ALL SELECT 'start_turn_idx', CASE WHEN ok THEN (o_orderkey % 3)::VARCHAR END, 1 FROM r
      UNION ALL SELECT 'n_moves', CASE WHEN moves < 50 THEN '<50' WHEN moves < 100 THEN '50-100' ELSE '100-200' END, 1 FROM r
      UNION ALL SELECT 'n_passes', least(passes, 20)::VARCHAR, 1 FROM r UNION ALL SELECT 'n_ab', ab::VARCHAR, 1 FROM r UNION ALL SELECT 'n_aw', aw::VARCHAR, 1 FROM r
      UNION ALL SELECT 'visits', CASE WHEN visits < 100 THEN '<100' WHEN visits < 200 THEN '100-200' WHEN visits < 300 THEN '200-300' WHEN visits < 500 THEN '300-500' WHEN visits < 1000 THEN '500-1000'
        WHEN visits < 2000 THEN '1000-2000' WHEN visits < 4000 THEN '2000-4000' ELSE '>=4000' END, 1 FROM l JOIN o USING (o_orderkey) WHERE ok AND noted
      UNION ALL SELECT 'weights', CASE WHEN weight < 0.001 THEN '<0.001' WHEN weight < 0.1 THEN '0.001-0.1' WHEN weight < 0.5 THEN '0.1-0.5' WHEN weight < 1 THEN '0.5-1.0'
        WHEN weight < 2 THEN '1.0-2.0' ELSE '>=2.0' END, 1 FROM l JOIN o USING (o_orderkey) WHERE ok AND weighted),
    f AS (SELECT 'not_19x19' AS value FROM r WHERE NOT ok UNION ALL SELECT 'suspect_gtype:asym' FROM r WHERE ok AND t = 'P' UNION ALL SELECT 'has_setup_stones' FROM r WHERE ab + aw > 0
      UNION ALL SELECT 'suicide_allowed' FROM r WHERE ok AND t = 'F' AND p <> 3 UNION ALL SELECT 'unparsed_ruleset' FROM r WHERE ok AND p = 3
      UNION ALL SELECT 'no_moves' FROM r WHERE ok AND moves = 0 UNION ALL SELECT 'moveless_node' FROM r WHERE ok AND t = 'P'
      UNION ALL SELECT 'no_training_weights' FROM r WHERE annotated > 0 AND weighted = 0 UNION ALL SELECT 'no_move_annotations' FROM r WHERE annotated = 0 AND moves > 0),
    c AS (SELECT 'files' AS counter, count(*) AS n FROM r UNION ALL SELECT 'moves', sum(moves) FROM r UNION ALL SELECT 'passes', sum(passes) FROM r UNION ALL SELECT 'annotated', sum(annotated) FROM r
      UNION ALL SELECT 'weighted', sum(weighted) FROM r UNION ALL SELECT 'reanalyzed', sum(reanalyzed) FROM r UNION ALL SELECT 'weight_zero', sum(weight_zero) FROM r
      UNION ALL SELECT 'weight_pos', sum(weighted - weight_zero) FROM r UNION ALL SELECT 'moveless_nodes', count(*) FILTER (ok AND t = 'P') FROM r UNION ALL SELECT 'setup_stones', sum(ab + aw) FROM r)"""


@query(
    f"""{REPORT_SQL} SELECT 'histogram' AS section, counter, value, count(*)::BIGINT AS n FROM h GROUP BY ALL
    UNION ALL SELECT 'flag', 'reason', value, count(*) FROM f GROUP BY value UNION ALL SELECT 'total', counter, NULL, n::BIGINT FROM c WHERE n > 0"""
)
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms, totals and flags of all records in one pass over their texts."""
    return manifest_report(manifest(_records(spark, sf_dir), with_bins=True))


@query(
    f"""{REPORT_SQL}, k AS (SELECT counter, value, count(*) AS n FROM h GROUP BY ALL),
    q AS (SELECT *, row_number() OVER (PARTITION BY counter ORDER BY n DESC, value NULLS FIRST) AS nth, count(*) OVER (PARTITION BY counter) AS kinds FROM k)
    SELECT counter, value, n, round(100.0 * n / (SELECT c.n FROM c WHERE c.counter = CASE WHEN q.counter IN ('visits', 'weights') THEN 'annotated' ELSE 'files' END), 6) AS percent, nth, greatest(kinds - 4, 0) AS more
    FROM q WHERE nth <= 4"""
)
def corpus_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest values of each of the corpus's histograms, with their shares and how many others there are."""
    return with_shares(manifest_report(manifest(_records(spark, sf_dir), with_bins=True)), 4)


@query(
    """WITH l AS (SELECT l_orderkey AS o_orderkey, l_linenumber, l_returnflag = 'R' AS pass, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
        CASE WHEN l_returnflag = 'R' THEN 'tt' ELSE 'dd' END) AS i, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem),
    s AS (SELECT o_orderkey, count(*) AS moves FROM l GROUP BY ALL),
    g AS (SELECT o.o_orderkey, 'c' || o_custkey % 40 AS opponent, 'HA' || o_custkey % 4 || ' komi ' || month(o_orderdate) || '.5' AS record, floor(o_totalprice / 10000)::INT + 0.5 AS points,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN (o_orderkey % 2 = 0) = (o_custkey % 2 = 1) THEN 'account won' ELSE 'opponent won' END AS who,
      CASE o_orderkey % 5 WHEN 0 THEN 'resign' WHEN 1 THEN 'time' WHEN 2 THEN '?' ELSE 'score' END AS how, o_custkey % 2 = 0 AS black, o_custkey % 9 || 'd' AS rank, 'Kifu' || o_custkey % 3 AS account,
      coalesce(moves, 0) >= 3 AND o_orderkey % 11 <> 0 AS done FROM orders o LEFT JOIN s USING (o_orderkey)),
    e AS (SELECT opponent, 'record' AS section, who AS counter, record AS value FROM g WHERE done UNION ALL SELECT opponent, 'margin', who, points::DOUBLE::VARCHAR FROM g WHERE done AND how = 'score'
      UNION ALL SELECT opponent, 'ending', who, how FROM g WHERE done UNION ALL SELECT opponent, 'rank', '', rank FROM g UNION ALL SELECT opponent, 'account', '', account FROM g
      UNION ALL SELECT opponent, 'pass', '', i::VARCHAR FROM g JOIN l USING (o_orderkey) WHERE done AND pass AND i < size AND (l_linenumber % 2 = 1) = black)
    SELECT opponent, section, counter, value, count(*) AS n FROM e GROUP BY ALL"""
)
def opponent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of one player's accounts read from record texts: by opponent, who won at which handicap, by how much, and how games ended."""
    return opponent_report(account_games(_records(spark, sf_dir), "Kifu"), least=3)


@query(
    """WITH RECURSIVE d AS (SELECT user_id, ts::DATE AS day, round(avg(value), 6) AS loss, CASE WHEN 8 * count(*) FILTER (event_type = 'error') > count(*) THEN 0.001 ELSE 0.01 END AS rate FROM events GROUP BY ALL),
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d WHERE loss IS NOT NULL),
    f AS (SELECT user_id, 0::BIGINT AS i, 1e300::DOUBLE AS best, 0 AS waited, 0 AS cooling, 0 AS cuts FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, i, CASE WHEN better THEN loss ELSE best END, CASE WHEN better OR cool > 0 OR cut THEN CASE WHEN cool > 0 AND NOT better THEN waited ELSE 0 END ELSE waited + 1 END,
        CASE WHEN cut THEN 3 ELSE cool END, cuts + cut::INT
      FROM (SELECT *, NOT better AND cool = 0 AND waited + 1 >= 2 AND rate > 0.001 AS cut FROM (
        SELECT f.user_id, e.i, e.loss, e.rate, f.best, f.cuts, CASE WHEN f.cooling > 0 THEN 0 ELSE f.waited END AS waited, greatest(f.cooling - 1, 0) AS cool, e.loss < f.best - 0.5 AS better
        FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
    SELECT user_id, i::INTEGER AS epochs, best, waited, cooling, cuts FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""
)
def plateau_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days as the epochs of a run: best loss, epochs waited, cooldown left, and how often the rate was cut."""
    by_day = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.round(F.avg("value"), 6).alias("loss"), F.when(8 * F.count_if(F.col("event_type") == "error") > F.count("*"), 0.001).otherwise(0.01).alias("rate")
    )
    epoch = F.struct("day", "loss", "rate")
    runs = by_day.filter("loss is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(epoch)).alias("epochs"))  # an entry a day
    state = plateau(F.col("epochs"), patience=2, cooldown=3, min_rate=0.001, min_delta=0.5)
    return runs.select("user_id", F.size("epochs").alias("epochs"), state.alias("s")).select("user_id", "epochs", "s.*")


@query(
    """WITH e AS (SELECT l_orderkey, l_returnflag, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag)),
    g AS (SELECT l_orderkey FROM e WHERE size >= 6 GROUP BY l_orderkey ORDER BY l_orderkey LIMIT 500),
    t AS (SELECT unnest([2, 4, 7, 9]) AS move_number)
    SELECT l_orderkey || '@' || move_number AS id, move_number, string_agg(l_returnflag, ',' ORDER BY i) FILTER (i < move_number) AS moves, max(l_returnflag) FILTER (i = move_number) AS to_move
    FROM e JOIN g USING (l_orderkey) JOIN t ON move_number < size GROUP BY l_orderkey, move_number"""
)
def position_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at given moves of the first 500 orders that have enough lines, each a move."""
    step = F.struct("l_linenumber", F.col("l_returnflag").alias("color"))
    games = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("line"))  # an order has few lines
    return sample_positions(games, [2, 4, 7, 9], 500, "l_orderkey", 6).withColumn("moves", F.array_join(F.transform("moves", lambda m: m["color"]), ","))
