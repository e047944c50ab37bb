"""Registered streams: each runs over the whole table and has SQL for what it must have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.plans.sequences import BATCHES_SQL
from kifu_spark.registry import query
from kifu_spark.sources.tables import table
from kifu_spark.streaming import events as stream
from kifu_spark.streaming.runs import run_arrivals, run_closed
from kifu_spark.streaming.stateful import pause_or_count, waiting


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS began, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by kind over a stream; updates replace earlier counts of a window."""
    counts = stream.tumbling_counts(stream.stream_table(spark, sf_dir, "events"), "1 day")
    return stream.run_to_end(counts, "update", ["event_type", "began"]).withColumn("began", F.col("began").cast("timestamp_ntz"))


@query(
    """WITH s AS (SELECT user_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY ALL"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker sessions of what a stream has taken in."""
    rows = stream.stream_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return stream.marker_sessions(stream.run_to_end(rows))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that meets every row twice and takes it once."""
    rows = stream.stream_table(spark, sf_dir, "events")
    twice = rows.union(stream.stream_table(spark, sf_dir, "events"))
    return stream.run_to_end(stream.first_seen(twice, "event_id")).select("event_id", "user_id", "event_type")


@query(
    """WITH r AS (SELECT l_orderkey, min(l_shipdate) AS replied FROM lineitem GROUP BY l_orderkey),
    q AS (SELECT o_orderkey, min(o_orderdate) AS asked FROM orders GROUP BY o_orderkey)
    SELECT coalesce(o_orderkey, l_orderkey) AS request, asked, replied, CASE WHEN asked IS NULL THEN 'unasked' WHEN replied IS NULL THEN 'waiting'
      WHEN replied <= asked + INTERVAL 30 DAY THEN 'answered' ELSE 'timed out' END AS outcome FROM q FULL JOIN r ON o_orderkey = l_orderkey"""
)
def stream_waiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests and shipments as replies, with a timeout of 30 days."""
    asked = stream.stream_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderdate").alias("at"))
    replied = stream.stream_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_shipdate").alias("at"))
    return stream.run_to_end(stream.waiters(asked, replied, "request", "at", F.expr("INTERVAL '30' DAY")), "update", ["request"])


@query(
    """SELECT unnest(['quantity_in_range', 'discount_in_range', 'price_is_positive']) AS name, count(*) AS n, unnest([
      count(*) FILTER (NOT coalesce(l_quantity BETWEEN 5 AND 50, FALSE)), count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 0.08, FALSE)),
      count(*) FILTER (NOT coalesce(l_extendedprice > 0, FALSE))]) AS failed FROM lineitem"""
)
def stream_quality_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and failures of each check, from the run log of a stream over line items."""
    checks = {
        "quantity_in_range": F.col("l_quantity").between(5, 50),
        "discount_in_range": F.col("l_discount").between(0, 0.08),
        "price_is_positive": F.col("l_extendedprice") > 0,
    }
    _, log = stream.run_tapped(stream.stream_table(spark, sf_dir, "lineitem"), checks)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col("rows").alias("n"), F.col(name).alias("failed")) for name in checks]))
    return log.select(each.alias("c")).groupBy("c.name").agg(F.sum("c.n").alias("n"), F.sum("c.failed").alias("failed"))


def _span(spark: SparkSession, sf_dir: str, *columns: tuple[str, str]) -> str:
    """How far apart the times of some tables lie: a lateness under which no row is late, in whatever order files come."""
    ends = [table(spark, sf_dir, name).agg(F.min(c).alias("low"), F.max(c).alias("high")).first() for name, c in columns]
    low, high = (min(e.low for e in ends if e.low), max(e.high for e in ends if e.high)) if any(e.low for e in ends) else (0, 0)
    return f"{int((high - low).total_seconds()) + 1 if low else 0} seconds"


@query(f"{BATCHES_SQL} SELECT user_id, event_id, burst::BIGINT AS burst, ((nth - 1) // 4)::INTEGER AS batch FROM n")
def stream_gap_count_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that close after an hour's pause, at four rows or by a timer, as rows of a stream."""
    rows = stream.stream_table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    batches = lambda df: pause_or_count(df, "user_id", "ts", "event_id", 3600, 4)
    return run_closed(rows, "ts", _span(spark, sf_dir, ("events", "ts")), batches).rows()


WAITING_SQL = """WITH r AS (SELECT l_orderkey, min(l_shipdate) AS replied FROM lineitem GROUP BY l_orderkey),
    q AS (SELECT o_orderkey, min(o_orderdate) AS asked FROM orders GROUP BY o_orderkey),
    b AS (SELECT coalesce(o_orderkey, l_orderkey) AS request, asked, replied, replied <= asked + INTERVAL 30 DAY AS good FROM q FULL JOIN r ON o_orderkey = l_orderkey)
    SELECT request, asked, CASE WHEN asked IS NULL OR good THEN replied END AS replied, CASE WHEN asked IS NULL THEN 'unasked' WHEN good THEN 'answered' ELSE 'timed out' END AS outcome FROM b
    UNION ALL SELECT request, asked, replied, 'late' FROM b WHERE asked IS NOT NULL AND NOT good"""


@query(WAITING_SQL)
def stream_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests that time out after 30 days without a shipment; a later shipment is a late reply. No state is left."""
    one = lambda name, key, at, reply: stream.stream_table(spark, sf_dir, name).select(
        F.col(key).alias("request"), F.col(at).cast("timestamp").alias("at"), F.lit(reply).alias("is_reply")
    )
    both = one("orders", "o_orderkey", "o_orderdate", False).unionByName(one("lineitem", "l_orderkey", "l_shipdate", True))
    late = _span(spark, sf_dir, ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    run = run_closed(both, "at", late, lambda df: waiting(df, "request", "at", F.col("is_reply"), 30 * 86400, 365 * 86400))
    if run.held:
        raise RuntimeError(f"{run.held} requests are left in state")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("asked", "replied")}
    return run.rows().withColumns(times)


@query(
    """WITH p AS (SELECT *, ts - lag(ts) OVER w >= INTERVAL 6 HOUR AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(coalesce(pause, FALSE)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM p)
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, session"""
)
def stream_pause_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six hours without a row, by native session state, closed by a tick."""
    rows = stream.stream_table(spark, sf_dir, "events").select("user_id", "ts")
    run = run_closed(rows, "ts", _span(spark, sf_dir, ("events", "ts")), lambda df: stream.pause_sessions(df, "user_id", "6 hours"))
    return run.rows().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})


#: Five-day parts of the events arrive in a fixed wrong order; of a part what lies more than two days before the latest earlier time is late.
ARRIVALS = 6
ARRIVAL_SQL = f"""WITH a AS (SELECT *, (epoch_us(ts) // 432000000000) * 5 % {ARRIVALS} AS part FROM events),
    m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM a GROUP BY part)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    part = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 432_000_000_000) * 5, F.lit(ARRIVALS))
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return [rows.filter(part == nth) for nth in range(ARRIVALS)]


@query(f"{ARRIVAL_SQL} SELECT event_id, event_type FROM a JOIN m USING (part) WHERE mark IS NULL OR ts > mark")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of parts that arrive in a wrong order, without those that the watermark had passed."""
    fresh = lambda df: stream.first_seen(df, "event_id", "2 days")
    return run_arrivals(spark, _arrivals(spark, sf_dir), fresh).rows().select("event_id", "event_type")


@query(
    f"""{ARRIVAL_SQL}, w AS (SELECT event_type, mark, part, time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * unnest([0, 1]) AS began FROM a JOIN m USING (part)),
    e AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM a)
    SELECT event_type, began, count(*) AS n FROM w WHERE (mark IS NULL OR began + INTERVAL 2 DAY > mark) AND began + INTERVAL 2 DAY <= (SELECT mark FROM e) GROUP BY ALL"""
)
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-day windows, a new one each day, over the same arrivals: each is written once, when it ends, without late rows."""
    counts = lambda df: stream.sliding_counts(df.withWatermark("ts", "2 days"), "2 days", "1 day")
    return run_arrivals(spark, _arrivals(spark, sf_dir), counts).rows().withColumn("began", F.col("began").cast("timestamp_ntz"))
