"""Links, properties, tokens, settings and set operations over text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifu_spark.functions.text import key_values, matched, parsed_or_damaged, unescaped
from kifu_spark.registry import query
from kifu_spark.sources.tables import table

LINK = '<a href="([^"]+)">([^<]*)</a>'


@query(
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{LINK}', 2)) AS label FROM pages)
    SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages, max(label) AS label FROM l GROUP BY ALL"""
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of saved pages: target, label and how often."""
    pair = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), 1).alias("href"), F.regexp_extract_all("html", F.lit(LINK), 2).alias("label"))
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(pair).alias("l")).select("page_id", "l.*")
    return links.groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.max("label").alias("label"))


@query(
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
    CASE WHEN regexp_matches(url, '[?&]page=([0-9]+)') THEN regexp_extract(url, '[?&]page=([0-9]+)', 1) END AS page FROM pages"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a name by pattern; a pattern that does not match gives null, not an empty text."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        matched(F.col("url"), "[?&]page=([0-9]+)").alias("page"),
    )


@query("SELECT (props::JSON ->> '$.k')::INTEGER AS k, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").groupBy(props["k"].alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(
    """WITH d AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN left(props, 4) ELSE props END AS line FROM events)
    SELECT count(*) AS n, count(*) FILTER (NOT json_valid(line)) AS damaged, sum(CASE WHEN json_valid(line) THEN (line::JSON ->> '$.k')::INTEGER END)::BIGINT AS total FROM d"""
)
def damaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that do not parse are counted and left out, and cost nothing else (every tenth is cut short here)."""
    cut_short = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(parsed_or_damaged(cut_short, "k int").alias("row"))
    return rows.agg(F.count("*").alias("n"), F.count_if("row.damaged").alias("damaged"), F.sum("row.value.k").alias("total"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS token FROM documents), c AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY ALL) SELECT * FROM c WHERE docs >= 5"""
)
def regex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by pattern, with their counts in all and by text."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)).alias("token"))
    per_doc = tokens.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).filter("docs >= 5")


@query(
    r"""SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#0*([0-9]+)(.*)$', 1) AS kind, regexp_extract(c_name, '^([A-Za-z]+)#0*([0-9]+)(.*)$', 2) AS number,
    nullif(regexp_extract(c_name, '^([A-Za-z]+)#0*([0-9]+)(.*)$', 3), '') AS rest FROM customer"""
)
def rule_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One anchored pattern read into its groups; an empty rest is null."""
    pattern = "^([A-Za-z]+)#0*([0-9]+)(.*)$"
    part = lambda i: F.regexp_extract("c_name", pattern, i)
    return table(spark, sf_dir, "customer").select("c_custkey", part(1).alias("kind"), part(2).alias("number"), F.nullif(part(3), F.lit("")).alias("rest"))


@query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)
    UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)"""
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    counted = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    parts = [counted("union", a.union(b).distinct()), counted("union_all", a.union(b)), counted("intersect", a.intersect(b)), counted("except", a.subtract(b))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    """WITH l AS (SELECT user_id, event_id, props, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, count(*) FILTER (before IS NOT NULL AND props <> before) AS changed, count(*) FILTER (props = before) AS same FROM l GROUP BY ALL"""
)
def settings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often settings differ from the ones before, compared key by key."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    settings = F.from_json("props", "map<string,string>")
    rows = table(spark, sf_dir, "events").withColumn("now", F.array_sort(F.map_entries(settings))).withColumn("before", F.lag("now").over(w))
    return rows.groupBy("user_id").agg(F.count_if(F.col("now") != F.col("before")).alias("changed"), F.count_if(F.col("now") == F.col("before")).alias("same"))


@query(
    """WITH k AS (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS part FROM pages), p AS (SELECT * FROM k WHERE contains(part, '='))
    SELECT split_part(part, '=', 1) AS key, count(*) AS n, count(DISTINCT substr(part, strpos(part, '=') + 1)) AS kinds FROM p GROUP BY ALL"""
)
def key_value_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key=value lists read to maps: parts without a sign are dropped, and only the first sign splits."""
    settings = key_values(F.regexp_extract("url", "[?]([^#]*)", 1), "&", "=")
    pairs = table(spark, sf_dir, "pages").select(F.explode(F.map_entries(settings)).alias("e")).select("e.key", "e.value")
    return pairs.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"))


@query(r"SELECT doc_id, sha256(text) AS digest, length(text)::INTEGER AS chars, strlen(text)::INTEGER AS bytes, length(replace(replace(text, '\', '\\'), ']', '\]'))::INTEGER AS escaped_chars FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, and sizes in characters and bytes, of whole texts; escaping and reading back changes nothing."""
    from kifu_spark.functions.text import escaped

    rows = table(spark, sf_dir, "documents").withColumn("e", escaped(F.col("text")))
    return rows.select(
        "doc_id",
        F.sha2(unescaped(F.col("e")), 256).alias("digest"),
        F.length("text").alias("chars"),
        F.octet_length("text").alias("bytes"),
        F.length("e").alias("escaped_chars"),
    )
