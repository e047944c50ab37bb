"""Exact dedup decides by its sort at test scale; sliced groups give the same rows."""

import pytest
from pyspark.sql import functions as F

from kifu_spark.llm import exact_dedup, queries
from tests.llm.test_exact_and_mix import ODD, SCHEMA, dedup_by_hand
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("hot_rows, share", [(1000, 1 / 512), (0, 0.0), (0, 0.2)])
def test_both_paths(spark, sf_dir, hot_rows, share):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = exact_dedup.exact_dedup(docs, hot_rows=hot_rows, hot_share=share, hot_slices=5)
    assert spark_rows(got) == duck_rows(queries.OP9_SQL, sf_dir)
    odd = spark.createDataFrame(ODD, SCHEMA).withColumn("norm", F.lit("clash"))
    rows = exact_dedup.exact_dedup(odd, hot_rows=hot_rows, hot_share=share, hot_slices=3, carry=True).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows], key=str) == dedup_by_hand(ODD)
    assert all(r.row.norm == "clash" for r in rows)


def test_sort_decides_on_the_test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert docs.groupBy("text").count().agg(F.max("count")).first()[0] <= exact_dedup.HOT_ROWS
