"""Round trips of records and literals, pairs of models, schedules, checks and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.functions import trees
from kifu_spark.functions.games import scored_tactics, tactics_set
from kifu_spark.functions.text import escaped, quoted, unescaped, unquoted
from kifu_spark.operators import ranking
from kifu_spark.operators.grids import SYMMETRIES, packed_bits, source_index
from kifu_spark.operators.ordered import in_order
from kifu_spark.operators.record_trees import record_nodes
from kifu_spark.registry import query
from kifu_spark.sources.tables import table

VALUES = "list_transform(embedding, lambda x: x::DOUBLE)"


@query("SELECT doc_id, coalesce(n_chars, 0)::VARCHAR AS komi, md5(coalesce(text, '')) AS comment, coalesce(source, '') AS place, 5 AS properties FROM documents")
def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts written as escaped comments of records, and read back from the first node."""
    docs = table(spark, sf_dir, "documents")
    value = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    record = F.concat(
        F.lit("( ;SZ[19]C["), value("text"), F.lit("] AB[aa]\n[bb]KM["), F.coalesce("n_chars", F.lit(0)), F.lit("]PC["), value("source"), F.lit("];B[cc]KM[0]C[KM[1\\]])")
    )
    read = docs.select("doc_id", record.alias("record")).withColumn("root", trees.root_properties(F.col("record")))
    return read.select(
        "doc_id", trees.property_text(F.regexp_replace("record", r"(?s)^.*?\] AB\[aa\]\n\[bb\]", ""), "KM").alias("komi"), F.md5(F.col("root")["C"][0]).alias("comment"),
        F.col("root")["PC"][0].alias("place"), F.size("root").alias("properties"),
    )


@query("SELECT doc_id, md5(text) AS text FROM documents WHERE text IS NOT NULL")
def literal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as quoted literals of a log, and back."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(unquoted(quoted(F.col("text")))).alias("text"))


@query("SELECT doc_id, doc_id % 6 <> 0 AS cut FROM documents")
def cut_off_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that end too early, by as many characters as the identifier says."""
    whole = F.lit("(;SZ[19];B[dd];W[pq])")
    return table(spark, sf_dir, "documents").select("doc_id", trees.cut_off(F.substring(whole, F.lit(1), F.length(whole) - F.pmod("doc_id", F.lit(6)).cast("int"))).alias("cut"))


@query(
    f"""WITH g AS (SELECT vec_id, list_position({VALUES}, list_max({VALUES})) - 1 AS place FROM embeddings)
    SELECT vec_id, chr((97 + place % 8)::INTEGER) || chr((97 + place // 8)::INTEGER) AS point, place::INTEGER AS back FROM g"""
)
def point_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top point as two letters, and the place read back from them in capitals."""
    place = (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int")
    named = table(spark, sf_dir, "embeddings").select("vec_id", trees.point(place, 8).alias("point"))
    return named.withColumn("back", trees.place_of_point(F.upper("point"), 8).cast("int"))


@query(
    f"""WITH g AS (SELECT vec_id, list_transform({VALUES}, lambda x: (x > 0)::INT) AS b FROM embeddings)
    SELECT vec_id, list_sum(b)::BIGINT AS ones, array_to_string(b, '') AS flags FROM g"""
)
def packed_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits packed to bytes and unpacked again."""
    packed = packed_bits(F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)), 64)
    read = table(spark, sf_dir, "embeddings").select("vec_id", trees.unpacked_bits(packed, 64).alias("flags"))
    return read.select("vec_id", F.aggregate("flags", F.lit(0), lambda a, x: a + x).cast("long").alias("ones"), F.array_join("flags", "").alias("flags"))


@query(
    f"""WITH g AS (SELECT vec_id, {VALUES} AS grid FROM embeddings),
    w AS (SELECT list_transform(range(0, 64), lambda p: (
      ((p // 8) * 8 + p % 8) + ((p // 8) * 8 + 7 - p % 8) + ((7 - p // 8) * 8 + p % 8) + ((7 - p // 8) * 8 + 7 - p % 8)
      + ((p % 8) * 8 + p // 8) + ((p % 8) * 8 + 7 - p // 8) + ((7 - p % 8) * 8 + p // 8) + ((7 - p % 8) * 8 + 7 - p // 8) + 8) / 512.0) AS share)
    SELECT vec_id, round(grid[1] * share[1], 6) AS first, round(grid[11] * share[11], 6) AS inner_point,
      round(list_sum(list_transform(range(1, 65), lambda i: grid[i] * share[i])) / 64, 6) AS mean FROM g, w"""
)
def view_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the eight views is scored by a rule that sees its own places, mapped back and averaged."""
    views = []
    for k in range(SYMMETRIES):
        source = source_index(k, 8)
        places = F.array(*[F.lit(i) for i in source])
        scored = F.transform(places, lambda at, i: F.element_at("grid", at + 1) * (i + 1) / 64)  # the score of a view hangs on its places
        views.append((scored, F.array(*[F.lit(source.index(p)) for p in range(64)])))
    board = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("grid"))
    board = board.select("vec_id", *[scored.alias(f"view{k}") for k, (scored, _) in enumerate(views)])
    total = None
    for k, (_, back) in enumerate(views):
        mapped = F.transform(back, _element_of(F.col(f"view{k}")))
        total = mapped if total is None else F.zip_with(total, mapped, lambda a, b: a + b)
    mean = board.select("vec_id", F.transform(total, lambda x: x / SYMMETRIES).alias("mean"))
    whole = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x) / 64
    return mean.select("vec_id", F.round(F.col("mean")[0], 6).alias("first"), F.round(F.col("mean")[10], 6).alias("inner_point"), F.round(whole, 6).alias("mean"))


def _element_of(values):
    return lambda at: F.element_at(values, at + 1)


TALLY_SQL = """SELECT w.n_name AS winner, l.n_name AS loser, count(*) AS games FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation w ON w.n_nationkey = s_nationkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation l ON l.n_nationkey = c_nationkey WHERE w.n_nationkey <> l.n_nationkey GROUP BY ALL"""


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items between two nations: the supplier's has won."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    won = F.broadcast(nation.toDF("s_nationkey", "winner"))  # a fixed table of 25
    lost = F.broadcast(nation.toDF("c_nationkey", "loser"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return sold.filter("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("games")).join(won, "s_nationkey").join(lost, "c_nationkey")


@query(TALLY_SQL)
def pair_tally_all_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tally(spark, sf_dir).select("winner", "loser", "games")


@query(
    f"""WITH t AS ({TALLY_SQL}) SELECT a.n_name AS first, b.n_name AS second, coalesce(x.games, 0)::BIGINT AS won, coalesce(y.games, 0)::BIGINT AS lost
    FROM nation a JOIN nation b ON a.n_name < b.n_name LEFT JOIN t x ON x.winner = a.n_name AND x.loser = b.n_name LEFT JOIN t y ON y.winner = b.n_name AND y.loser = a.n_name"""
)
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all unordered pairs of a small table of models, with the games they have played."""
    names = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_set("n_name")).alias("names"))  # a fixed table of 25
    second = F.expr("explode(slice(names, at + 2, size(names)))").alias("second")
    pairs = names.select("names", F.posexplode("names").alias("at", "first")).select("first", second)
    games = _tally(spark, sf_dir)
    first = F.least("winner", "loser")
    sums = games.groupBy(first.alias("first"), F.greatest("winner", "loser").alias("second")).agg(
        F.sum(F.when(F.col("winner") == first, F.col("games")).otherwise(0)).alias("won"), F.sum(F.when(F.col("winner") == first, 0).otherwise(F.col("games"))).alias("lost")
    )
    return pairs.join(sums, ["first", "second"], "left").fillna(0, ["won", "lost"])


@query(
    """SELECT coalesce(kind, 'not in pages') AS kind, count(*) AS games, sum((o_orderstatus = 'F')::INT)::BIGINT AS won FROM orders
    LEFT JOIN (SELECT c_custkey, c_mktsegment AS kind FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey GROUP BY ALL"""
)
def games_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with the type that pages give them, or the default for those that no page lists."""
    types = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("kind"))
    typed = table(spark, sf_dir, "orders").join(types, "o_custkey", "left").fillna("not in pages", ["kind"])
    return typed.groupBy("kind").agg(F.count("*").alias("games"), F.count_if(F.col("o_orderstatus") == "F").alias("won"))


@query(
    """WITH s AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)
    SELECT event_id, step, round(CASE WHEN step > 10 THEN 0.1 ELSE 0.001 + 0.099 * step / 10 END, 9) AS warm,
      round(CASE WHEN step <= 5 THEN 0.0001 + 0.0009 * step / 5 ELSE 0.001 * pow(1000.0, least(1.0, (step - 5) / 40.0)) END, 9) AS swept,
      round(CASE WHEN step < 10 THEN 0.001 + 0.099 * step / 10 ELSE 0.05 * (1 + cos(pi() * least(1.0, (step - 10) / 50.0))) END, 9) AS cosine FROM s"""
)
def schedule_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by the step of a sequence: warm-up, exponential sweep, warm-up and half a cosine."""
    steps = table(spark, sf_dir, "events").select("event_id", (F.row_number().over(in_order(["user_id"], ["ts", "event_id"])) - 1).alias("step"))
    step = F.col("step")
    rates = {"warm": trees.warm_up(step, 0.001, 0.1, 10), "swept": trees.sweep(step, 0.0001, 0.001, 1.0, 5, 40), "cosine": trees.cosine(step, 0.001, 0.1, 10, 60)}
    return steps.select("event_id", "step", *[F.round(c, 9).alias(n) for n, c in rates.items()])


@query(
    """WITH l AS (SELECT event_id, value * 0.3719 - 18.3137 AS lead, (event_id % 17)::BIGINT AS contested, (event_id % 7)::BIGINT AS open, (event_id % 30)::BIGINT AS border FROM events)
    SELECT event_id, CASE WHEN abs(lead) < 0.25 THEN '0' ELSE (CASE WHEN lead > 0 THEN 'B+' ELSE 'W+' END) || printf('%.1f', abs(lead)) END AS score,
      CASE WHEN contested > 10 THEN 'play on' WHEN open > 4 AND border < 20 THEN 'close the border' ELSE 'own rule' END AS answer FROM l"""
)
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final scores as text, and the answer to a pass."""
    part = lambda n: F.pmod("event_id", F.lit(n))
    lead = F.col("value") * 0.3719 - 18.3137
    return table(spark, sf_dir, "events").select("event_id", trees.score_text(lead).alias("score"), trees.pass_back(part(17), part(7), part(30)).alias("answer"))


@query(
    """WITH g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS own, (value / 500) * greatest(value - 40, 0) AS excess FROM events)
    SELECT user_id, ((own - 1) // 5)::INTEGER AS part, count(*) AS moves, round(sum(excess), 6) AS excess FROM g GROUP BY ALL"""
)
def excess_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected loss over windows of five own moves."""
    own = F.row_number().over(in_order(["user_id"], ["ts", "event_id"]))
    rows = table(spark, sf_dir, "events").select("user_id", own.alias("own"), (F.col("value") / 500 * F.greatest(F.col("value") - 40, F.lit(0.0))).alias("excess"))
    part = F.floor((F.col("own") - 1) / 5).cast("int")
    return rows.groupBy("user_id", part.alias("part")).agg(F.count("*").alias("moves"), F.round(F.sum("excess"), 6).alias("excess"))


@query(
    """WITH g AS (SELECT event_id, user_id, (value / 500) * greatest(value - 40, 0) AS excess FROM events)
    SELECT event_id, user_id, round(excess, 6) AS excess FROM g ORDER BY g.excess DESC, event_id LIMIT 8"""
)
def riskiest_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight moves of the largest expected loss."""
    excess = F.col("value") / 500 * F.greatest(F.col("value") - 40, F.lit(0.0))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", excess.alias("raw")).orderBy(F.desc("raw"), "event_id").limit(8)
    return rows.select("event_id", "user_id", F.round("raw", 6).alias("excess"))


@query(
    """WITH r AS (SELECT l_linenumber, l_extendedprice::DOUBLE AS total, (l_extendedprice * l_tax)::DOUBLE AS decode, (l_extendedprice * l_discount)::DOUBLE AS queued FROM lineitem)
    SELECT l_linenumber, count(*) AS n, round(median(total), 4) AS total, round(median(decode), 4) AS decode, round(median(total - decode - queued), 4) AS other FROM r GROUP BY ALL"""
)
def round_trip_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of a round trip's parts by stage, and of what none of the parts explains."""
    price = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", price.cast("double").alias("whole"), (price * F.col("l_tax")).cast("double").alias("decode"), (price * F.col("l_discount")).cast("double").alias("queued")
    ).withColumn("other", F.col("whole") - F.col("decode") - F.col("queued"))
    parts = {"total": "whole", "decode": "decode", "other": "other"}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("part"), F.col(value).alias("value")) for name, value in parts.items()]))
    middles = ranking.linear_percentiles(rows.select("l_linenumber", each.alias("e")).select("l_linenumber", "e.*"), ["l_linenumber", "part"], "value", {"middle": 0.5})
    wide = middles.groupBy("l_linenumber").agg(*[F.round(F.max(F.when(F.col("part") == name, F.col("middle"))), 4).alias(name) for name in parts])
    counts = rows.groupBy("l_linenumber").agg(F.count("*").alias("n"))
    other = wide.withColumnRenamed("l_linenumber", "number")
    return counts.join(other, F.col("l_linenumber").eqNullSafe(F.col("number")), "left").select("l_linenumber", "n", *parts)


COUNTERS = {
    "status": "o_orderstatus", "priority": "o_orderpriority", "year": "year(o_orderdate)", "quarter": "quarter(o_orderdate)", "month": "month(o_orderdate)",
    "day": "day(o_orderdate)", "customer": "o_custkey % 20", "key": "o_orderkey % 32", "urgent": "left(o_orderpriority, 1)", "price": "CAST(o_totalprice >= 250000 AS INT)",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS counter, ({sql})::VARCHAR AS bucket, count(*) AS n FROM orders GROUP BY ({sql})" for name, sql in COUNTERS.items()))
def merged_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of many columns counted by file as maps, then merged by adding the maps' entries."""
    orders = table(spark, sf_dir, "orders").withColumn("file", F.pmod(F.xxhash64("o_orderkey"), F.lit(16)))
    counters = F.array(*[F.struct(F.lit(name).alias("counter"), F.expr(sql).cast("string").alias("bucket")) for name, sql in COUNTERS.items()])
    by_file = orders.select("file", F.explode(counters).alias("one")).groupBy("file", "one.counter", "one.bucket").agg(F.count("*").alias("n"))
    maps = by_file.groupBy("file", "counter").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("histogram"))  # a few buckets each
    return maps.select("counter", F.explode("histogram").alias("bucket", "n")).groupBy("counter", "bucket").agg(F.sum("n").alias("n"))


@query(
    f"""WITH g AS (SELECT vec_id, {VALUES} AS a, list_transform({VALUES}, lambda x: round(x, 2)) AS b FROM embeddings),
    d AS (SELECT list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS most, list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS total,
      list_position(a, list_max(a)) = list_position(b, list_max(b)) AS top1, list_sort(list_grade_up(a, 'DESC')[1:5]) = list_sort(list_grade_up(b, 'DESC')[1:5]) AS top5 FROM g)
    SELECT count(*) AS n, round(max(most), 6) AS max_diff, round(sum(total) / count(*) / 64, 6) AS mean_diff, count(*) FILTER (top1) AS top1,
      CASE WHEN max(most) <= 0.006 AND bool_and(top1) AND bool_and(top5) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM d"""
)
def output_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs compared: largest and mean difference, agreement of the best place and of the set of the best five."""
    both = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("a"))
    both = both.withColumn("b", F.transform("a", lambda x: F.round(x, 2)))
    diff = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    five = lambda c: F.array_sort(F.transform(F.slice(F.sort_array(F.transform(c, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))), False), 1, 5), lambda s: s["i"]))
    best = lambda c: F.array_position(c, F.array_max(c))
    rows = both.select(
        F.array_max(diff).alias("most"), F.aggregate(diff, F.lit(0.0), lambda s, x: s + x).alias("total"), (best(F.col("a")) == best(F.col("b"))).alias("top1"), (five(F.col("a")) == five(F.col("b"))).alias("top5")
    )
    passed = (F.max("most") <= 0.006) & F.bool_and("top1") & F.bool_and("top5")
    return rows.agg(
        F.count("*").alias("n"), F.round(F.max("most"), 6).alias("max_diff"), F.round(F.sum("total") / F.count("*") / 64, 6).alias("mean_diff"), F.count_if(F.col("top1")).alias("top1"),
        F.when(passed, "PASS").otherwise("FAIL").alias("verdict"),
    )


@query(
    """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 7) || '-31' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T10:00' END AS stamp FROM orders)
    SELECT substr(stamp, 1, 7) AS month, count(*) AS n, count(*) FILTER (try_cast(substr(stamp, 1, 10) AS DATE) IS NOT NULL) AS valid FROM d GROUP BY ALL"""
)
def date_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps by the month they start with, and how many of their dates exist."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.concat(F.substring(day, 1, 7), F.lit("-31"))).otherwise(F.concat(day, F.lit("T10:00")))
    rows = table(spark, sf_dir, "orders").select(stamp.alias("stamp"))
    return rows.groupBy(F.substring("stamp", 1, 7).alias("month")).agg(F.count("*").alias("n"), F.count(F.substring("stamp", 1, 10).try_cast("date")).alias("valid"))


TACTICS_SQL = """WITH m AS (SELECT o_custkey, o_orderkey, l_partkey::VARCHAR AS move, sum(l_quantity) AS visits, max(l_extendedprice) AS lead, max(l_discount) AS share
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    l AS (SELECT o_orderkey, min(move) AS played FROM m GROUP BY o_orderkey),
    d AS (SELECT o_custkey, o_orderkey, o_totalprice AS lost, played, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS by_loss
      FROM orders JOIN l USING (o_orderkey)),
    b AS (SELECT o_orderkey, move, lead, max(lead) OVER (PARTITION BY o_orderkey) AS best FROM m WHERE visits >= 5),
    a AS (SELECT o_orderkey, list(move ORDER BY move) AS accepted FROM b WHERE lead >= best - 20000 GROUP BY o_orderkey),
    f AS (SELECT d.*, accepted, row_number() OVER (PARTITION BY o_custkey ORDER BY by_loss) AS nth FROM d JOIN a USING (o_orderkey)
      WHERE by_loss <= 4 AND len(accepted) <= 5 AND NOT list_contains(accepted, played)),
    k AS (SELECT * FROM f WHERE nth <= 2)"""


def _tactics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as games, orders as turns and parts as moves: the set, and the moves with visits, lead and share."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("turn"), F.col("o_totalprice").alias("lost"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("turn"), F.col("l_partkey").cast("string").alias("move"))
    moves = lines.agg(F.sum("l_quantity").alias("visits"), F.max("l_extendedprice").alias("lead"), F.max("l_discount").alias("share"))
    moves = moves.join(orders.select("o_custkey", "turn"), "turn")
    drops = orders.join(moves.groupBy("turn").agg(F.min("move").alias("played")), "turn")
    return tactics_set(drops, moves, ["o_custkey"], "lost", tolerance=20000.0), moves


@query(f"{TACTICS_SQL} SELECT o_custkey, o_orderkey, lost, played, array_to_string(accepted, ',') AS accepted, nth FROM k")
def tactics_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two positions a game where much was lost and few moves were right."""
    positions, _ = _tactics(spark, sf_dir)
    return positions.select("o_custkey", F.col("turn").alias("o_orderkey"), "lost", "played", F.array_join("accepted", ",").alias("accepted"), "nth")


@query(
    f"""{TACTICS_SQL}, p AS (SELECT o_orderkey, list(move ORDER BY share DESC, move) AS tried FROM m GROUP BY o_orderkey),
    r AS (SELECT o_orderkey, list_min(list_transform(accepted, lambda x: list_position(tried, x))) AS best_rank FROM k JOIN p USING (o_orderkey))
    SELECT o_orderkey, best_rank = 1 AS top_right, best_rank::BIGINT AS best_rank FROM r"""
)
def tactics_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a policy, here the discounts, does on those positions."""
    positions, moves = _tactics(spark, sf_dir)
    return scored_tactics(positions, moves, ["o_custkey"]).select(F.col("turn").alias("o_orderkey"), "top_right", "best_rank")


@query(
    """WITH c AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, 0 AS node, NULL::BIGINT AS parent, 0 AS depth, 1 AS branch, TRUE AS played, 3 * count(*) AS below, NULL AS said FROM c GROUP BY conv_id
    UNION ALL SELECT conv_id, t, t - 1, t, 1, TRUE, 3 * (n - t), said FROM c
    UNION ALL SELECT conv_id, n + 2 * (n - t) + 1, t - 1, t, 2, FALSE, 1, md5('aside ' || turn || ']') FROM c
    UNION ALL SELECT conv_id, n + 2 * (n - t) + 2, n + 2 * (n - t) + 1, t + 1, 1, FALSE, 0, NULL FROM c"""
)
def record_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as records, a variation of two nodes beside every turn, and read as trees with all branches."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    comment = lambda text: F.concat(F.lit("C ["), escaped(text), F.lit("]"))
    aside = F.concat(F.lit(")\n(;"), comment(F.concat(F.lit("aside "), F.col("turn"), F.lit("]"))), F.lit(";N[)(;])"))
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("(;"), comment(F.col("text"))).alias("opens"), aside.alias("closes")))).alias("t"))
    text = F.concat(
        F.lit("a note (;GM[1]"), F.array_join(F.transform("t", lambda x: x["opens"]), ""), F.array_join(F.transform(F.reverse("t"), lambda x: x["closes"]), ""), F.lit(")")
    )
    nodes = record_nodes(nested.select("conv_id", text.alias("text")), "conv_id")
    said = F.regexp_extract("properties", r"(?s)^C \[(.*)\]\s*$", 1)
    return nodes.select(
        "conv_id", "node", "parent", "depth", (F.col("branch") + 1).alias("branch"), "played", (F.col("last") - F.col("node")).alias("below"),
        F.when(F.col("properties").startswith("C "), F.md5(unescaped(said))).alias("said"),
    )


@query(
    """WITH r AS (SELECT doc_id, rtrim('(;SZ[19]C[' || replace(replace(coalesce(text, ''), '\\', '\\\\'), ']', '\\]') || '];B[dd];W[pq])', chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS whole FROM documents),
    c AS (SELECT doc_id, whole, left(whole, length(whole) - length(whole) % 7) AS kept FROM r),
    t AS (SELECT *, rtrim(kept, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM c)
    SELECT doc_id, length(kept) AS chars, NOT (suffix(tail, ')')) OR regexp_matches(rtrim(tail, ')'), '[BW]\\[[a-s]?$') AS cut FROM t"""
)
def cut_off_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of whole texts, each cut by as many characters as its length leaves by seven: which of them end too early."""
    whole = F.concat(F.lit("(;SZ[19]C["), escaped(F.coalesce("text", F.lit(""))), F.lit("];B[dd];W[pq])"))
    cut = table(spark, sf_dir, "documents").select("doc_id", whole.alias("whole")).withColumn("kept", F.expr("left(whole, length(whole) - length(whole) % 7)"))
    return cut.select("doc_id", F.length("kept").cast("long").alias("chars"), trees.cut_off(F.col("kept")).alias("cut"))
