"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters of the normalised text, sorted inside each partition
(the sort spills), and neighbours are compared in full: a run of equal texts is one window group.

The splitters are a short head of the text plus a 64-bit hash of all of it, so what the driver samples stays
small however long the texts are; the sort and the comparison use the whole text. A text is normalised and hashed
once and written with its hashes; where a row is carried along, the normalised text beside it is only written if it
differs.

A group of copies that holds more than ``hot_share`` of all rows, and more than ``hot_rows``, would be one run in one
task. There are fewer than 1 / hot_share such groups; they are found by a pre-aggregated count per SHA-256, broadcast
(a few hundred rows of fixed size), and their runs are cut into ``hot_slices`` slices by identifier. Their smallest
identifier and size come from the count.

Cases: null text counts as empty and joins the group of empty texts. A null identifier sorts after all others,
so it stays only where its group has no other. Rows that repeat an identifier and a text are one group, of which
one row stays. A text of any length is compared whole. An empty table gives an empty result. Further columns never
matter: names are bound before use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kifu_spark.llm.text import one_space
from kifu_spark.session import stored

HEAD = 32
HOT_ROWS = 1000


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_share: float = 1 / 512,
    hot_slices: int = 64,
    carry: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; with carry also the input row as struct ``row``."""
    norm = one_space(F.col(text_col))
    base = docs.select(
        F.col(id_col).alias("doc_id"), norm.alias("norm"), *([F.struct("*").alias("row")] if carry else [])
    ).withColumns({"sha": F.coalesce(F.sha2("norm", 256), F.lit("")), "head": F.substring("norm", 1, HEAD), "hash": F.xxhash64("norm")})
    text = F.coalesce(F.col("row").getField(text_col), F.lit("")) if carry else None
    if carry:
        base = base.withColumn("norm", F.when(F.col("norm") != text, F.col("norm")))
    base = stored(base)

    least = max(hot_rows, int(base.count() * hot_share))
    hot = (
        base.groupBy("sha")
        .agg(F.count("*").alias("hot_size"), F.min("doc_id").alias("hot_keep"))
        .filter(F.col("hot_size") > least)
        .withColumnRenamed("sha", "hot_sha")
    )
    # fewer than 1 / hot_share groups can each hold more than that share
    marked = base.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left").withColumn(
        "slice",
        F.when(F.col("hot_size").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(hot_slices))).otherwise(F.lit(0)),
    )
    splitter = ["head", "hash", "slice"]
    placed = marked.repartitionByRange(*splitter)
    if carry:
        placed = placed.withColumn("norm", F.coalesce("norm", text))
    run = Window.partitionBy(*splitter, "norm")
    in_order = run.orderBy(F.col("doc_id").asc_nulls_last())
    return (
        placed.select(
            "doc_id",
            F.row_number().over(in_order).alias("nth"),
            F.first("doc_id").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("run_keep"),
            F.count("*").over(run).alias("run_size"),
            "hot_keep",
            "hot_size",
            "sha",
            *(["row"] if carry else []),
        )
        .withColumns(
            {
                "keep_id": F.when(F.col("hot_size").isNotNull(), F.col("hot_keep")).otherwise(F.col("run_keep")),
                "group_size": F.coalesce("hot_size", "run_size"),
            }
        )
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
            *(["row"] if carry else []),
        )
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    kept = exact_dedup(docs, id_col, text_col, carry=True, **how).filter("kept")
    return kept.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])
