"""Queries over ordered rows: losses, patterns, sessions, pairs, batches, prefixes and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kifu_spark.operators.ordered import carried, gap_count_batches, in_order, loss_to_next, ordered_list, padded_size, prefix_keys, prefixes, request_pairs, session_number
from kifu_spark.operators.ranking import top_by_group, with_percentiles
from kifu_spark.registry import query
from kifu_spark.sources.tables import table

#: A value counts as annotated unless the event is an error; the share of the largest value stands for a win rate.
KNOWN = "CASE WHEN event_type <> 'error' THEN value / 500 END"
BY_USER = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
USER_ORDER = (["user_id"], ["ts", "event_id"])


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("event_type") != "error", F.col("value") / 500)
    return table(spark, sf_dir, "events").withColumn("rate", rate)


@query(
    f"""WITH r AS (SELECT *, {KNOWN} AS rate FROM events), l AS (SELECT user_id, event_id, rate, rate - lead(rate IGNORE NULLS) OVER w AS loss FROM r {BY_USER})
    SELECT user_id, event_id, round(loss, 9) AS loss FROM l WHERE rate IS NOT NULL"""
)
def next_annotated_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the next annotated value of the user lies below each annotated one."""
    w = in_order(*USER_ORDER)
    return (
        _known(spark, sf_dir)
        .select("user_id", "event_id", "rate", F.round(loss_to_next(F.col("rate"), w), 9).alias("loss"))
        .filter("rate is not null")
        .drop("rate")
    )


@query(
    f"""WITH r AS (SELECT *, {KNOWN} AS rate FROM events WHERE event_type <> 'error'),
    l AS (SELECT user_id, value, rate, rate - lead(rate) OVER w AS loss, first_value(rate) OVER w AS first_rate FROM r {BY_USER})
    SELECT user_id, count(*) AS n_annotated, round(any_value(first_rate), 9) AS first_rate,
      round(quantile_cont(value, 0.1), 6) AS value_p10, round(quantile_cont(value, 0.5), 6) AS value_median,
      count(*) FILTER (rate < 0.1 OR rate > 0.9) AS n_decided, count(*) FILTER (loss > 0.05) AS n_over05, count(*) FILTER (loss > 0.10) AS n_over10, count(*) FILTER (loss > 0.20) AS n_over20
    FROM l GROUP BY user_id"""
)
def move_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sequence: first rate, percentiles, decided rows and drops over three thresholds."""
    w = in_order(*USER_ORDER)
    rows = _known(spark, sf_dir).filter("rate is not null").select(
        "user_id", "value", "rate", F.lead("rate").over(w).alias("after"), F.struct("ts", "event_id").alias("at")
    )
    loss = F.col("rate") - F.col("after")
    sums = rows.groupBy("user_id").agg(
        F.count("*").alias("n_annotated"),
        F.round(F.min_by("rate", "at"), 9).alias("first_rate"),
        F.count_if((F.col("rate") < 0.1) | (F.col("rate") > 0.9)).alias("n_decided"),
        *[F.count_if(loss > t / 100).alias(f"n_over{t:02d}") for t in (5, 10, 20)],
    )
    named = {"value_p10": 0.1, "value_median": 0.5}
    return with_percentiles(sums, rows, ["user_id"], "value", named).withColumns({name: F.round(name, 6) for name in named})


@query(
    f"""WITH l AS (SELECT user_id, event_id, value, lag(value) OVER w AS before, lead(value) OVER w AS after FROM events {BY_USER})
    SELECT user_id, event_id, round(value - after, 6) AS fall FROM l WHERE value - after >= 300"""
)
def big_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after which the value falls by the threshold or more."""
    fall = F.col("value") - F.lead("value").over(in_order(*USER_ORDER))
    return table(spark, sf_dir, "events").withColumn("fall", fall).filter("fall >= 300").select("user_id", "event_id", F.round("fall", 6).alias("fall"))


@query(
    f"""WITH l AS (SELECT user_id, event_id, value, lag(value) OVER w AS before, lead(value) OVER w AS after FROM events {BY_USER})
    SELECT user_id, event_id, round(before - value, 6) AS fall, round(after - value, 6) AS rise FROM l WHERE before - value >= 100 AND after - value >= 100"""
)
def fall_and_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fall and then a rise, both large: a three-row pattern."""
    w = in_order(*USER_ORDER)
    near = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.lag("value").over(w) - F.col("value")).alias("fall"), (F.lead("value").over(w) - F.col("value")).alias("rise")
    )
    return near.filter("fall >= 100 and rise >= 100").withColumns({"fall": F.round("fall", 6), "rise": F.round("rise", 6)})


@query(
    f"""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER w AS nth, lag(event_type) OVER w AS before FROM events {BY_USER})
    SELECT user_id, event_id, nth FROM l WHERE event_type = 'view' AND before = 'view' AND nth > 10"""
)
def double_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of a kind in a row, past an opening."""
    w = in_order(*USER_ORDER)
    rows = table(spark, sf_dir, "events").withColumns({"nth": F.row_number().over(w), "before": F.lag("event_type").over(w)})
    return rows.filter("event_type = 'view' and before = 'view' and nth > 10").select("user_id", "event_id", "nth")


@query(
    f"""WITH s AS (SELECT *, sum((event_type = 'signup')::INT) OVER w AS session FROM events {BY_USER})
    SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY ALL"""
)
def sessions_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from one marker row to the next."""
    number = session_number(F.col("event_type") == "signup", in_order(*USER_ORDER))
    return table(spark, sf_dir, "events").withColumn("session", number).groupBy("user_id", "session").agg(
        F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


@query(
    f"""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS setting FROM events"""
)
def locf_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last setting in force at each row."""
    setting = carried(F.when(F.col("event_type") == "purchase", F.col("props")), in_order(*USER_ORDER))
    return table(spark, sf_dir, "events").select("event_id", "user_id", setting.alias("setting"))


@query(
    """WITH l AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations)
    SELECT conv_id, turn, CASE WHEN next_role = 'assistant' THEN next_turn ELSE -1 END AS reply_turn FROM l WHERE role = 'user'"""
)
def request_reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with the turn that answers it, if the next turn does, else -1."""
    paired = request_pairs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", F.col("role") == "assistant")
    return paired.select("conv_id", "turn", F.coalesce("reply.turn", F.lit(-1)).alias("reply_turn"))


@query(
    """WITH l AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
    SELECT conv_id, count(*) FILTER (role = 'user') AS requests, count(*) FILTER (role = 'user' AND next_role IS DISTINCT FROM 'assistant') AS unanswered FROM l GROUP BY ALL"""
)
def unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("role").over(in_order(["conv_id"], ["turn"]))
    rows = table(spark, sf_dir, "conversations").withColumn("after", after)
    asks = F.col("role") == "user"
    return rows.groupBy("conv_id").agg(F.count_if(asks).alias("requests"), F.count_if(asks & ~F.col("after").eqNullSafe("assistant")).alias("unanswered"))


BATCHES_SQL = """WITH g AS (SELECT user_id, event_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) > 3600000000, FALSE)::INT AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, burst ORDER BY ts, event_id) AS nth FROM b)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts without an hour's pause, cut every four rows."""
    w = in_order(*USER_ORDER)
    pause = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) > 3_600_000_000, F.lit(False))
    rows = table(spark, sf_dir, "events").withColumn("pause", pause)
    return gap_count_batches(rows, ["user_id"], ["ts", "event_id"], F.col("pause"), 4)


@query(f"{BATCHES_SQL} SELECT user_id, event_id, burst::BIGINT AS burst, ((nth - 1) // 4)::INTEGER AS batch FROM n")
def gap_count_batches_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("user_id", "event_id", "burst", "batch")


@query(
    f"""{BATCHES_SQL}, c AS (SELECT user_id, burst, (nth - 1) // 4 AS batch, count(*) AS n FROM n GROUP BY ALL)
    SELECT n, CASE WHEN n <= 1 THEN 1 WHEN n <= 2 THEN 2 ELSE 4 END AS padded, count(*) AS batches FROM c GROUP BY ALL"""
)
def padded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by size and the power of two that holds them."""
    sizes = _batches(spark, sf_dir).groupBy("user_id", "burst", "batch").agg(F.count("*").alias("n"))
    return sizes.groupBy("n", padded_size(F.col("n"), 4).alias("padded")).agg(F.count("*").alias("batches"))


LINES_SQL = "WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS steps FROM conversations GROUP BY ALL)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's roles in order; a conversation is short, as a game is."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered_list(["turn"], "role").alias("steps"))


@query(
    f"""{LINES_SQL}, p AS (SELECT conv_id, unnest(range(1, least(len(steps), 6) + 1)) AS len, steps FROM s)
    SELECT len::INTEGER AS len, array_to_string(steps[1:len], ' ') AS key, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2"""
)
def repeated_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings that occur more than once."""
    opened = _lines(spark, sf_dir).select(F.explode(prefixes(F.col("steps"), 6)).alias("p"))
    return opened.groupBy("p.len", "p.key").agg(F.count("*").alias("n")).filter("n >= 2")


@query(
    f"""{LINES_SQL}, p AS (SELECT conv_id, unnest(range(1, least(len(steps) - 1, 6) + 1)) AS len, steps FROM s)
    SELECT array_to_string(steps[1:len], ' ') AS key, count(*) AS n, count(DISTINCT steps[len + 1]) = 1 AS same_reply FROM p GROUP BY ALL HAVING count(*) >= 2"""
)
def prefix_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the step after a repeated opening is always the same."""
    before_last = F.slice("steps", F.lit(1), F.greatest(F.size("steps") - 1, F.lit(0)))
    opened = _lines(spark, sf_dir).select("steps", F.explode(prefixes(before_last, 6)).alias("p"))
    replied = opened.select("p.key", F.element_at("steps", F.col("p.len") + 1).alias("reply"))
    return replied.groupBy("key").agg(F.count("*").alias("n"), (F.count_distinct("reply") == 1).alias("same_reply")).filter("n >= 2")


@query(
    f"""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id)[1:6] AS steps FROM events GROUP BY ALL),
    p AS (SELECT user_id, unnest(range(1, len(steps) + 1)) AS len, steps FROM s),
    k AS (SELECT user_id, len, array_to_string(steps[1:len], ' ') AS key FROM p)
    SELECT a.user_id, max(a.len)::INTEGER AS shared FROM k a WHERE EXISTS (SELECT 1 FROM k b WHERE b.key = a.key AND b.user_id < a.user_id) GROUP BY ALL HAVING max(a.len) >= 2"""
)
def longest_shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest opening that an earlier sequence shares: by hashed prefixes, not by comparing pairs."""
    firsts = top_by_group(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 6)
    lines = firsts.groupBy("user_id").agg(ordered_list(["ts", "event_id"], "event_type").alias("steps"))
    opened = lines.select("user_id", F.explode(prefixes(F.col("steps"), 6)).alias("p")).select("user_id", "p.*")
    earliest = opened.groupBy("key").agg(F.min("user_id").alias("first"))
    return opened.join(earliest, "key").filter("first < user_id").groupBy("user_id").agg(F.max("len").alias("shared")).filter("shared >= 2")


@query(
    f"""WITH l AS (SELECT user_id, event_id, lag(value) OVER w - value AS spent FROM events {BY_USER}) SELECT user_id, count(*) AS n, round(sum(spent), 6) AS spent FROM l WHERE spent >= 0 GROUP BY ALL"""
)
def clock_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time spent between clock readings; a reading that rises is a reset and counts as nothing."""
    spent = F.lag("value").over(in_order(*USER_ORDER)) - F.col("value")
    return table(spark, sf_dir, "events").withColumn("spent", spent).filter("spent >= 0").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("spent"), 6).alias("spent"))


@query(
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth, ((row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) // 5)::INTEGER AS bin FROM events"
)
def own_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place among its own kind, and its bin of five."""
    nth = F.row_number().over(in_order(["user_id", "event_type"], ["ts", "event_id"]))
    return table(spark, sf_dir, "events").select("event_id", nth.alias("nth"), F.floor((nth - 1) / 5).cast("int").alias("bin"))


@query(
    f"""WITH n AS (SELECT user_id, event_type, row_number() OVER w AS nth, count(*) OVER (PARTITION BY user_id) AS total FROM events {BY_USER})
    SELECT user_id, event_type, least(any_value(total) - max(nth), 7) AS age FROM n GROUP BY user_id, event_type"""
)
def age_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps since each kind's newest row, capped at seven."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(in_order(*USER_ORDER)).alias("nth"))
    newest = rows.groupBy("user_id", "event_type").agg(F.max("nth").alias("newest"))
    total = F.max("newest").over(Window.partitionBy("user_id"))
    return newest.select("user_id", "event_type", F.least(total - F.col("newest"), F.lit(7)).cast("long").alias("age"))


@query(
    """WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'system')
    SELECT conv_id, count(*) AS n, count(*) FILTER (role = before OR (before IS NULL AND role <> 'user')) AS out_of_turn FROM l GROUP BY ALL"""
)
def out_of_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose side does not alternate; the first must be the user's."""
    rows = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    before = F.lag("role").over(in_order(["conv_id"], ["turn"]))
    wrong = F.coalesce(F.col("role") == F.col("before"), F.col("role") != "user")
    return rows.withColumn("before", before).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("out_of_turn"))


@query(
    f"""WITH n AS (SELECT user_id, event_type, row_number() OVER w AS nth FROM events {BY_USER}), p AS (SELECT user_id, min(nth) AS problem FROM n WHERE event_type = 'error' GROUP BY ALL)
    SELECT n.user_id, count(*) AS kept FROM n LEFT JOIN p USING (user_id) WHERE problem IS NULL OR nth < problem GROUP BY ALL"""
)
def first_problem_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows stand before a sequence's first problem."""
    errors = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(in_order(*USER_ORDER).rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").withColumn("errors", errors).filter("errors = 0").groupBy("user_id").agg(F.count("*").alias("kept"))


EPOCHS_SQL = "WITH e AS (SELECT (ts::DATE)::VARCHAR AS day, round(avg(value), 6) AS loss FROM events GROUP BY ALL)"


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query(f"{EPOCHS_SQL} SELECT day, loss FROM e ORDER BY loss, day LIMIT 1")
def best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch of the lowest loss, the earliest of equal ones."""
    best = F.min(F.struct("loss", "day"))
    return _epochs(spark, sf_dir).agg(best.alias("b")).select("b.day", "b.loss")


@query(
    f"""WITH RECURSIVE {EPOCHS_SQL.removeprefix('WITH ')}, o AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM e),
    f AS (SELECT 0::BIGINT AS i, 1e300::DOUBLE AS best, 0 AS waited, 0 AS drops
      UNION ALL SELECT o.i, CASE WHEN loss < best - 0.5 THEN loss ELSE best END,
        CASE WHEN loss < best - 0.5 THEN 0 WHEN waited + 1 >= 4 THEN 0 ELSE waited + 1 END,
        CASE WHEN loss < best - 0.5 THEN drops WHEN waited + 1 >= 4 THEN drops + 1 ELSE drops END
      FROM f JOIN o ON o.i = f.i + 1)
    SELECT i::INTEGER AS epochs, best, waited, drops FROM f ORDER BY i DESC LIMIT 1"""
)
def plateau_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best loss, epochs waited and rate drops after a fold over the epochs in order (a row for each day)."""
    ordered = _epochs(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("day", "loss"))).alias("epochs"))
    start = F.struct(F.lit(1e300).alias("best"), F.lit(0).alias("waited"), F.lit(0).alias("drops"))

    def step(state, epoch):
        better = epoch["loss"] < state["best"] - 0.5
        patience = state["waited"] + 1 >= 4
        return F.struct(
            F.when(better, epoch["loss"]).otherwise(state["best"]).alias("best"),
            F.when(better | patience, 0).otherwise(state["waited"] + 1).alias("waited"),
            F.when(better | ~patience, state["drops"]).otherwise(state["drops"] + 1).alias("drops"),
        )

    return ordered.select(F.size("epochs").alias("epochs"), F.aggregate("epochs", start, step).alias("f")).select("epochs", "f.*")


@query(
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate) AS nth FROM lineitem)
    SELECT l_suppkey, nth, l_extendedprice FROM r WHERE nth <= 3"""
)
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest rows of each group."""
    order = [F.desc("l_extendedprice"), *map(F.col, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"])]
    return top_by_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "nth", "l_extendedprice")


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY nth) AS kept FROM r WHERE nth <= 6 AND o_orderstatus <> 'P')
    SELECT o_custkey, o_orderkey, kept FROM k WHERE kept <= 3"""
)
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the wanted number by size, then the first of those that pass a test."""
    first = top_by_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 6)
    return top_by_group(first.filter("o_orderstatus <> 'P'"), ["o_custkey"], [F.col("nth")], 3, "kept").select("o_custkey", "o_orderkey", "kept")


LONG = 300
LONG_SQL = f"""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id)[1:{LONG}] AS steps FROM events GROUP BY ALL),
    p AS (SELECT user_id, unnest(range(1, len(steps) + 1)) AS len, steps FROM s), k AS (SELECT user_id, len, md5(array_to_string(steps[1:len], ' ')) AS key, steps[len + 1] AS reply FROM p)"""


def _long_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, len, key and reply (the step after it) of each user's prefixes of up to 300 steps."""
    firsts = top_by_group(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], LONG)
    lines = firsts.groupBy("user_id").agg(ordered_list(["ts", "event_id"], "event_type").alias("steps"))
    opened = lines.select("user_id", "steps", F.explode(prefix_keys(F.col("steps"), LONG)).alias("p"))
    return opened.select("user_id", "p.len", "p.key", F.get("steps", F.col("p.len")).alias("reply"))


@query(f"{LONG_SQL}, f AS (SELECT *, min(user_id) OVER (PARTITION BY key) AS first FROM k) SELECT user_id, max(len)::INTEGER AS shared FROM f WHERE first < user_id GROUP BY ALL HAVING max(len) >= 2")
def longest_shared_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest opening of up to 300 steps that an earlier sequence shares, by keys of fixed size."""
    opened = _long_prefixes(spark, sf_dir)
    earliest = opened.groupBy("key").agg(F.min("user_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return opened.join(earliest, "key").filter("first < user_id").groupBy("user_id").agg(F.max("len").alias("shared")).filter("shared >= 2")


@query(
    f"""{LONG_SQL} SELECT len::INTEGER AS len, min(user_id) AS first_user, count(*) AS n, count(reply) AS replied, count(DISTINCT reply) AS replies
    FROM k GROUP BY len, key HAVING count(*) >= 2"""
)
def repeated_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of up to 300 steps that occur more than once, how often a step follows, and how many different ones do."""
    counted = _long_prefixes(spark, sf_dir).groupBy("len", "key").agg(
        F.min("user_id").alias("first_user"), F.count("*").alias("n"), F.count("reply").alias("replied"), F.count_distinct("reply").alias("replies")
    )
    return counted.filter("n >= 2").select("len", "first_user", "n", "replied", "replies")
