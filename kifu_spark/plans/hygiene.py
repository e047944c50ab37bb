"""Corpus hygiene: classify, deduplicate, plan deletions, flag and count."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kifu_spark.functions.classify import all_that_apply, binned, first_that_applies
from kifu_spark.operators.dedup import keep_first, walk_key
from kifu_spark.operators.ranking import rank_in_order, top_by_group
from kifu_spark.registry import query
from kifu_spark.session import checkpoint_dir
from kifu_spark.sources.manifest import ManifestSink
from kifu_spark.sources.tables import table

def reasons() -> list[tuple[str, Column]]:
    return [
        ("empty", F.trim("text") == ""),
        ("no_words", ~F.col("text").rlike("[A-Za-z]")),
        ("short", F.length("text") < 200),
        ("long", F.length("text") > 20000),
    ]
REASON_CASE = (
    "CASE WHEN trim(text) = '' THEN 'empty' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no_words' "
    "WHEN length(text) < 200 THEN 'short' WHEN length(text) > 20000 THEN 'long' ELSE 'kept' END"
)


@query(
    f"""SELECT coalesce(reason, 'total') AS reason, count(*) AS n, sum(bytes)::BIGINT AS bytes
    FROM (SELECT {REASON_CASE} AS reason, strlen(text) AS bytes FROM documents) GROUP BY ROLLUP (reason)"""
)
def cull_reason_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that applies to each text, with counts, bytes and a total row."""
    docs = table(spark, sf_dir, "documents").select(first_that_applies(reasons(), "kept").alias("reason"), F.octet_length("text").alias("bytes"))
    return docs.rollup("reason").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).withColumn("reason", F.coalesce("reason", F.lit("total")))


@query(
    """SELECT doc_id, first_value(doc_id) OVER w AS first_id, row_number() OVER w > 1 AS duplicate
    FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)"""
)
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by digest; the first in order stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return keep_first(docs, "digest", "doc_id").select("doc_id", "first_id", "duplicate")


@query(
    """WITH h AS (SELECT doc_id, md5(left(text, 64)) AS weak, md5(text) AS strong FROM documents),
    r AS (SELECT *, first_value(doc_id) OVER w AS first_id, first_value(strong) OVER w AS first_strong FROM h WINDOW w AS (PARTITION BY weak ORDER BY doc_id))
    SELECT doc_id, first_id, CASE WHEN doc_id = first_id THEN 'first' WHEN strong = first_strong THEN 'duplicate' ELSE 'conflict' END AS status
    FROM r WHERE doc_id <> first_id"""
)
def hash_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a weak key with an earlier one: copies of it, or conflicts, which never become representatives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.left("text", F.lit(64))).alias("weak"), F.md5("text").alias("strong"))
    firsts = docs.groupBy("weak").agg(F.min(F.struct("doc_id", "strong")).alias("first"))
    status = F.when(F.col("strong") == F.col("first.strong"), "duplicate").otherwise("conflict")
    return docs.join(firsts, "weak").filter(F.col("doc_id") != F.col("first.doc_id")).select("doc_id", F.col("first.doc_id").alias("first_id"), status.alias("status"))


@query(
    """WITH d AS (SELECT doc_id, md5(text) AS digest, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents)
    SELECT d.doc_id, d.first_id FROM d JOIN documents k ON k.doc_id = d.first_id AND md5(k.text) = d.digest WHERE d.doc_id <> d.first_id"""
)
def guarded_delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that may go: only those whose kept row is still there and still equal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    copies = keep_first(docs, "digest", "doc_id").filter("duplicate")
    there = docs.select(F.col("doc_id").alias("first_id"), "digest")
    return copies.join(there, ["first_id", "digest"], "left_semi").select("doc_id", "first_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an earlier run has not recorded."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def flags() -> list[tuple[str, Column]]:
    return [
        ("has_digit", F.col("text").rlike("[0-9]")),
        ("has_mail", F.col("text").rlike("[A-Za-z0-9.]+@[A-Za-z0-9.]+")),
        ("many_lines", F.length("text") - F.length(F.regexp_replace("text", "\n", "")) >= 20),
        ("not_english", F.col("lang") != "en"),
    ]
FLAG_LIST = """list_filter([CASE WHEN regexp_matches(text, '[0-9]') THEN 'has_digit' END,
    CASE WHEN regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') THEN 'has_mail' END,
    CASE WHEN length(text) - length(replace(text, chr(10), '')) >= 20 THEN 'many_lines' END,
    CASE WHEN lang <> 'en' THEN 'not_english' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT doc_id, array_to_string({FLAG_LIST}, ',') AS flags FROM documents")
def advisory_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag that applies, in a fixed order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(all_that_apply(flags()), ",").alias("flags"))


@query(
    f"""WITH f AS (SELECT doc_id, unnest({FLAG_LIST}) AS flag FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY flag) AS n FROM f)
    SELECT flag, any_value(n) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM r WHERE nth <= 5 GROUP BY flag"""
)
def flag_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flag's count and its first five rows."""
    flagged = table(spark, sf_dir, "documents").select("doc_id", F.explode(all_that_apply(flags())).alias("flag"))
    firsts = top_by_group(flagged, ["flag"], [F.col("doc_id")], 5).groupBy("flag").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    counts = flagged.groupBy("flag").agg(F.count("*").alias("n"))
    return counts.join(firsts, "flag").select("flag", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("examples"))


EDGES = [1.0, 10.0, 50.0, 100.0, 250.0]


@query(
    """SELECT event_type, CASE WHEN value < 1 THEN '<1' WHEN value < 10 THEN '1-10' WHEN value < 50 THEN '10-50' WHEN value < 100 THEN '50-100'
    WHEN value < 250 THEN '100-250' ELSE '>=250' END AS bin, count(*) AS n FROM events GROUP BY ALL"""
)
def value_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open labelled bins."""
    return table(spark, sf_dir, "events").groupBy("event_type", binned(F.col("value"), EDGES).alias("bin")).agg(F.count("*").alias("n"))


@query(
    """WITH long AS (
      SELECT 'lang' AS counter, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents
      UNION ALL SELECT 'length_k', least(length(text) // 1000, 20)::VARCHAR FROM documents),
    c AS (SELECT counter, value, count(*) AS n FROM long GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY counter ORDER BY n DESC, value) AS nth, sum(n) OVER (PARTITION BY counter) AS total, count(*) OVER (PARTITION BY counter) AS kinds FROM c)
    SELECT counter, value, n, round(100.0 * n / total, 6) AS percent, greatest(kinds - 5, 0) AS more FROM r WHERE nth <= 5"""
)
def long_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several histograms in one pass: the five most common values of each, their share, and how many more there are."""
    docs = table(spark, sf_dir, "documents").select(
        "lang", "source", F.least(F.floor(F.length("text") / 1000), F.lit(20)).cast("string").alias("length_k")
    )
    counts = docs.unpivot([], ["lang", "source", "length_k"], "counter", "value").groupBy("counter", "value").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("counter")
    ranked = counts.withColumns(
        {
            "nth": F.row_number().over(whole.orderBy(F.desc("n"), "value")),
            "total": F.sum("n").over(whole),
            "kinds": F.count("*").over(whole),
        }
    ).filter("nth <= 5")
    return ranked.select(
        "counter", "value", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6).alias("percent"), F.greatest(F.col("kinds") - 5, F.lit(0)).alias("more")
    )


@query(
    """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages),
    k AS (SELECT page_id, parts, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i = len(parts) THEN '0' ELSE '1' END || parts[i]), '/') AS walk FROM p)
    SELECT page_id, len(parts)::INTEGER AS depth, row_number() OVER (ORDER BY walk, page_id) AS place FROM k"""
)
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the order of a directory walk: a folder's files come before its folders."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    keyed = table(spark, sf_dir, "pages").select("page_id", F.size(parts).alias("depth"), walk_key(parts).alias("walk"))
    return rank_in_order(keyed, ["walk", "page_id"], "place").select("page_id", "depth", "place")


@query(
    """WITH s AS (SELECT counter, status, n FROM (
      SELECT 'size' AS counter, CASE WHEN p_size = 15 THEN 'right' ELSE 'other' END AS status, count(*) AS n FROM part GROUP BY ALL))
    SELECT p.p_partkey, p.p_size = 15 AS size_ok, CASE WHEN p.p_size = 15 THEN p.p_brand END AS brand, CASE WHEN p.p_size = 15 THEN round(p.p_retailprice, 2) END AS price, s.n AS of_kind
    FROM part p JOIN s ON s.status = CASE WHEN p.p_size = 15 THEN 'right' ELSE 'other' END"""
)
def short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that stay null where a first test fails, with the count of each outcome."""
    tested = table(spark, sf_dir, "part").withColumn("size_ok", F.col("p_size") == 15)
    counts = tested.groupBy("size_ok").agg(F.count("*").alias("of_kind"))
    return tested.join(F.broadcast(counts), "size_ok").select(
        "p_partkey", "size_ok", F.when(F.col("size_ok"), F.col("p_brand")).alias("brand"), F.when(F.col("size_ok"), F.round("p_retailprice", 2)).alias("price"), "of_kind"
    )


@query(f"SELECT doc_id::VARCHAR AS path, strlen(text)::BIGINT AS bytes, {REASON_CASE} AS reason FROM documents")
def manifest_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all texts in numbered batches: one is repeated, one was staged without being committed, the rest resumes."""
    sink = ManifestSink(spark, f"{checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}")
    schema = "path string, bytes long, reason string"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    scan = lambda df: df.select("path", F.octet_length("text").cast("long").alias("bytes"), first_that_applies(reasons(), "kept").alias("reason"))
    first = scan(docs.filter(F.crc32("path") % 3 == 0))
    sink.append(0, first)
    sink.append(0, first)  # the same batch again
    sink._staged(first, 1)  # a run that was killed before it committed
    sink.resume(docs, scan, schema)
    return sink.read(schema).filter(~F.col("damaged")).select("value.path", "value.bytes", "value.reason")
